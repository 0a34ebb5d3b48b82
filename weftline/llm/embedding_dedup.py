"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Each unit vector u is held as s * q with q of int8 and the error e = |u - s q| measured in double precision.
For two vectors |u.w - s_u s_w (q_u.q_w)| <= e_u + e_w + e_u e_w, so a tile of int8 products decides every
pair outside a narrow band around the threshold; only pairs in the band are computed again in full, in the
tile, where both vectors are at hand. Sums of int8 products over up to 1,040 dimensions stay below 2**24, so
32-bit matrix products give them exactly; longer vectors are summed over blocks of as many, in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import components, table
from weftline.session import cut

#: Vectors of a tile's side; a task holds two sides and one strip of products.
TILE = 4096
STRIP = 512
#: Dimensions whose products of int8 values, at most 127 * 127 each, 32-bit floats add exactly.
EXACT = (1 << 24) // (127 * 127)
#: Pairs in the band that are computed in full at a time.
PAIRS = 1 << 14
#: Rounding of double precision itself, far above what sums of some thousand terms can lose.
SLACK = 1e-9


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(batch.num_rows, -1).astype(np.float64)


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms of the unit vectors along ``vectors`` (rows, finite, not zero)."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    unit = scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))
    scales = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scales[:, None]).astype(np.int8)
    errors = np.sqrt(((unit - scales[:, None] * codes) ** 2).sum(axis=1))
    return codes, scales, errors


def _quantised(classes: DataFrame) -> DataFrame:
    """``(id, size, codes, scale, error, vector)`` for rows ``(id, vector, size)``; vectors of a batch may differ in length."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array(batch.column(2).to_numpy())
            for dim in np.unique(lengths):
                some = batch.filter(pa.array(lengths == dim))
                codes, scales, errors = quantise(_matrix(some))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(3), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scales), pa.array(errors), some.column(1)], names=["id", "size", "codes", "scale", "error", "vector"])

    return classes.select("id", "vector", F.size("vector").alias("dim"), "size").mapInArrow(of_partition, f"id long, size long, codes binary, scale double, error double, vector {classes.schema['vector'].dataType.simpleString()}")


class _Forest:
    """Union-find over positions; ``join`` tells whether two trees became one."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        return self.parent

    def find(self, a: int) -> int:
        while self.parent[a] != a:
            self.parent[a] = a = self.parent[self.parent[a]]
        return a


def _products_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact products of codes: in 32 bits where these hold their sums, else by blocks of dimensions."""
    if left.shape[1] <= EXACT:
        return left @ right.T
    return sum((left[:, k : k + EXACT] @ right[:, k : k + EXACT].T).astype(np.float64) for k in range(0, left.shape[1], EXACT))


def _cosines(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, in double precision."""
    u, w = (v / np.abs(v).max(axis=1, keepdims=True) for v in (u, w))  # no square overflows or vanishes
    return (u * w).sum(axis=1) / np.sqrt((u * u).sum(axis=1) * (w * w).sum(axis=1))


def _tile(left: pa.Table, right: pa.Table, same: bool, threshold: float) -> Iterator[dict]:
    """Links of one tile: spanned, and counted by vector. Bounds decide most pairs, full precision those in the band."""
    ids = [np.asarray(t.column("id")) for t in (left, right)]
    sizes = [np.asarray(t.column("size")) for t in (left, right)]
    codes = [np.frombuffer(b"".join(t.column("codes").to_pylist()), dtype=np.int8).reshape(len(t), -1).astype(np.float32) for t in (left, right)]
    full = [t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for t in (left, right)]  # as stored
    scales = [np.asarray(t.column("scale")) for t in (left, right)]
    errors = [np.asarray(t.column("error")) for t in (left, right)]
    n, m = len(left), len(right)
    counts = [np.zeros(n, np.int64), np.zeros(m, np.int64)]
    forest = _Forest(n if same else n + m)
    base = 0 if same else n
    for at in range(0, n, STRIP):
        rows = slice(at, min(n, at + STRIP))
        # in units of the left scale, and in 32 bits: a coarse pass finds the few pairs that bounds must decide
        products = _products_of(codes[0][rows], codes[1])
        floor = (threshold - SLACK - errors[0][rows][:, None] - (1 + errors[0][rows][:, None]) * errors[1][None, :].max()) / scales[0][rows][:, None]
        i, j = np.nonzero(products * scales[1].astype(np.float32)[None, :] >= (floor - np.abs(floor) * 1e-5 - 1e-5).astype(np.float32))
        if same:
            above = j > i + at
            i, j = i[above], j[above]
        if not len(i):
            continue
        value = products[i, j].astype(np.float64) * scales[0][i + at] * scales[1][j]
        bound = errors[0][i + at] + errors[1][j] + errors[0][i + at] * errors[1][j] + SLACK
        linked = value - bound >= threshold
        band = np.flatnonzero(~linked & (np.abs(value - threshold) <= bound))
        for k in range(0, len(band), PAIRS):
            some = band[k : k + PAIRS]
            linked[some] = _cosines(full[0][i[some] + at].astype(np.float64), full[1][j[some]].astype(np.float64)) >= threshold
        a, b = i[linked] + at, j[linked]
        np.add.at(counts[0], a, sizes[1][b])
        np.add.at(counts[1], b, sizes[0][a])
        # links inside one tree of the forest add nothing to components
        while len(a):
            root = forest.roots()
            apart = root[a] != root[b + base]
            a, b = a[apart], b[apart]
            if not len(a):
                break
            x, y = root[a], root[b + base]
            low, high = np.minimum(x, y), np.maximum(x, y)
            last = np.unique(high, return_index=True)[1]  # one step up for each tree; the others wait for the next turn
            forest.parent[high[last]] = low[last]
            yield {"a": ids[0][a[last]], "b": ids[1][b[last]], "n": np.zeros(len(last), np.int64), "kind": np.full(len(last), 1, np.int8)}
    for side, count in zip(ids, counts):
        some = count > 0
        yield {"a": side[some], "b": side[some], "n": count[some], "kind": np.zeros(some.sum(), np.int8)}


def _products(quantised: DataFrame, n: int, threshold: float, tile: int) -> DataFrame:
    """``(a, b, n, kind)``: 0 counts n links of a in a tile, 1 is a link that joins two parts of a tile."""
    blocks = max(1, -(-n // tile))
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    others = F.sequence(F.lit(0), F.lit(blocks - 1))
    # each block meets each block at or after it, itself included, in one group of two blocks at most
    met = quantised.withColumn("block", own).withColumn("other", F.explode(others)).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other"), "dim": F.length("codes")})

    def of_group(group: pa.Table) -> pa.Table:
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        block = np.asarray(group.column("block"))
        left = group.filter(pa.array(block == x))
        right = left if x == y else group.filter(pa.array(block == y))
        empty = {"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "kind": np.zeros(0, np.int8)}
        found = [empty, *(_tile(left, right, x == y, threshold) if len(left) and len(right) else ())]
        return pa.table({key: np.concatenate([part[key] for part in found]) for key in empty})

    return met.groupBy("dim", "x", "y").applyInArrow(of_group, "a long, b long, n long, kind byte")


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Two vectors of equal length are linked when their cosine, in double precision, is at least ``threshold``
    (above 0). Vectors that are null, empty, zero or hold a null or non-finite component link with nothing.
    Identical vectors are one class with its size until the end, so copies are never paired. Repeated ids
    are vertices of their own rows' classes and share a component; null ids link with nothing, have a null
    component and are kept. An empty table gives an empty table.

    All classes meet all classes, in blocks of ``tile``: that is what an exact join of this kind costs. Groups
    are two blocks at most, of hashed ids, so that neither copies nor clusters make one larger. Pairs never
    leave their tile; what does are counts, and links that join parts of it, fewer than its vectors.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    # components of four bytes stay so until cosines are computed: their cast to double is exact
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    usable = F.coalesce((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one value to a comparison but not to a key
    keyed = rows.withColumn("vector", F.when(usable & F.col("vec_id").isNotNull(), F.transform("vector", lambda x: x + F.lit(0.0)).cast(kind)))
    keyed = keyed.select("vec_id", "vector", F.xxhash64("vector").alias("hash"), F.md5(F.to_json(F.struct("vector"))).alias("key"))
    keyed = cut(keyed.withColumn("key", F.when(F.col("vector").isNotNull(), F.concat("key", F.hex("hash")))).drop("hash"))
    classes = cut(keyed.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"), F.first("vector").alias("vector")))
    n = classes.count()
    found = cut(_products(_quantised(classes), n, threshold, tile))

    links = found.filter("kind = 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    parts = cut(components(found.filter("kind = 1").select("a", "b")))
    of_class = classes.select("key", "id", "size").join(links, "id", "left").join(parts, "id", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    linked = keyed.filter("key is not null").select("vec_id", "key").join(of_class, "key").select("vec_id", "n_links", "component_id")
    alone = keyed.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs: for small tables only.
ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
lengths AS MATERIALIZED (SELECT vec_id, e, len(e) AS dim, sqrt(list_dot_product(e, e)) AS l FROM v),
ways AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM lengths a JOIN lengths b USING (dim) WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.9),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, w.y FROM reach r JOIN ways w ON w.x = r.y),
least AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x), counts AS (SELECT x AS vec_id, count(*) AS n FROM ways GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM least LEFT JOIN counts USING (vec_id)
"""
