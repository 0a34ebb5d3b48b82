"""Exact integer k-means with Drake's adaptive bounds.

Every vector stores its centroid with an upper bound of the distance, lower bounds of several more near centroids,
and one lower bound that holds for all the rest. When centroids move, bounds widen by how far; a vector is
compared again only where they no longer certify the order: first with its own centroid, then with the stored
ones, and with all of them if the bound of the rest fails as well. How many bounds are stored follows from
how many were needed the round before. Distances are integers; bounds are floating-point with room for rounding,
and certify by strict inequality alone, so ties always come to an exact comparison.
"""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import table
from weftline.session import remove, written

DIMENSIONS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Components beyond this would let 64-bit squares overflow.
LARGEST = 1 << 27
#: Room for rounding in bounds.
ROOM = 1e-9

STATE = "vec_id long, v array<int>, a int, upper double, near array<int>, lower array<double>, rest double"
#: Rows of sums come last in what a task writes: of a cluster's vectors, and of what was compared.
SUMS = "n long, sums array<long>, needed int, compared long"


@dataclasses.dataclass
class Vectors:
    """Vectors of a batch with their bounds. ``near`` are stored centroids other than ``a``, ``lower`` their bounds."""

    v: np.ndarray
    a: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    rest: np.ndarray
    needed: int = 0  # stored bounds that a vector of these had to look at
    compared: int = 0  # distances computed


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    out = np.empty((len(v), len(centroids)), dtype=np.int64)
    for k, c in enumerate(centroids):
        d = v - c
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def _room(x: np.ndarray, sign: int) -> np.ndarray:
    return x + sign * ROOM * (np.minimum(np.abs(x), 1e300) + 1)  # infinite bounds stay so


def scan(v: np.ndarray, centroids: np.ndarray, stored: int) -> Vectors:
    """Compare with all centroids and store bounds of the nearest ones; ties go to the smaller number."""
    d = squared(v, centroids)
    order = np.argsort(d, axis=1, kind="stable")
    length = np.sqrt(np.take_along_axis(d, order, axis=1).astype(np.float64))
    near = order[:, 1 : 1 + stored].astype(np.int32)
    rest = _room(length[:, 1 + stored], -1) if length.shape[1] > 1 + stored else np.full(len(v), np.inf)
    return Vectors(v, order[:, 0].astype(np.int32), _room(length[:, 0], 1), near, _room(length[:, 1 : 1 + stored], -1), rest, stored, d.size)


def moved(x: Vectors, centroids: np.ndarray, drift: np.ndarray, stored: int) -> Vectors:
    """The same vectors when the centroids have moved by at most ``drift``, to ``centroids``."""
    if x.near.shape[1] > stored:  # bounds that are stored no longer are part of the rest's
        x.rest = np.minimum(x.rest, x.lower[:, stored:].min(axis=1))
        x.near, x.lower = x.near[:, :stored], x.lower[:, :stored]
    x.upper = _room(x.upper + drift[x.a], 1)
    x.lower = _room(x.lower - drift[x.near], -1)
    x.rest = _room(x.rest - (drift.max() if len(drift) else 0.0), -1)
    least = np.minimum(x.rest, x.lower.min(axis=1, initial=np.inf))
    x.needed, x.compared = 0, 0
    open_ = np.flatnonzero(x.upper >= least)
    if not len(open_):
        return x
    # the distance to the own centroid may be enough
    d = x.v[open_] - centroids[x.a[open_]]
    own = np.einsum("ij,ij->i", d, d)
    x.upper[open_] = _room(np.sqrt(own.astype(np.float64)), 1)
    x.compared += len(open_)
    still = x.upper[open_] >= least[open_]
    open_, own = open_[still], own[still]
    # stored centroids that could be as near, where the rest cannot
    some = x.rest[open_] > x.upper[open_]
    asked, own = open_[some], own[some]
    if len(asked):
        ids, bounds = np.concatenate([x.a[asked][:, None], x.near[asked]], axis=1), x.lower[asked]
        exact = np.full(ids.shape, np.iinfo(np.int64).max)
        exact[:, 0] = own
        close = bounds <= x.upper[asked][:, None]
        x.needed = int(close.sum(axis=1).max())
        x.compared += int(close.sum())
        for k in range(close.shape[1]):
            rows = close[:, k]
            d = x.v[asked[rows]] - centroids[ids[rows, k + 1]]
            exact[rows, k + 1] = np.einsum("ij,ij->i", d, d)
        best = np.lexsort((ids, exact), axis=1)[:, 0]
        length = np.where(exact < np.iinfo(np.int64).max, np.sqrt(exact.astype(np.float64)), np.inf)
        known = np.concatenate([_room(length[:, :1], -1), np.where(close, _room(length[:, 1:], -1), bounds)], axis=1)
        row = np.arange(len(asked))
        x.a[asked], x.upper[asked] = ids[row, best], _room(length[row, best], 1)
        others = np.ones(ids.shape, dtype=bool)
        others[row, best] = False
        ids, known = ids[others].reshape(len(asked), -1), known[others].reshape(len(asked), -1)
        order = np.argsort(known, axis=1, kind="stable")
        x.near[asked], x.lower[asked] = np.take_along_axis(ids, order, axis=1), np.take_along_axis(known, order, axis=1)
    if len(all_ := open_[~some]):
        whole = scan(x.v[all_], centroids, x.near.shape[1])
        for name in ("a", "upper", "near", "lower", "rest"):
            getattr(x, name)[all_] = getattr(whole, name)
        x.needed, x.compared = stored, x.compared + whole.compared
    return x


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32), x.reshape(-1))


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _round(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, drift: np.ndarray | None, stored: int) -> Iterator[pa.RecordBatch]:
    """State rows of one assignment, and at the end a row of sums for each cluster met."""
    k, width = centroids.shape
    counts, sums, needed, compared = np.zeros(k, np.int64), np.zeros((k, width), np.int64), 0, 0
    types = [pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64()]
    names = _names(f"{STATE}, {SUMS}")
    for batch in batches:
        if not batch.num_rows:
            continue
        v = _matrix(batch.column("v"), width, np.int64)
        if drift is None:
            x = scan(v, centroids, stored)
        else:
            had = len(batch.column("near")[0])
            bounds = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("a", "upper", "rest")]
            x = Vectors(v, bounds[0], bounds[1], _matrix(batch.column("near"), had, np.int32), _matrix(batch.column("lower"), had, np.float64), bounds[2])
            x = moved(x, centroids, drift, min(stored, had))
        needed, compared = max(needed, x.needed), compared + x.compared
        counts += np.bincount(x.a, minlength=k)
        for c in np.unique(x.a):
            sums[c] += v[x.a == c].sum(axis=0)
        none = [pa.nulls(batch.num_rows, t) for t in types[7:]]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(x.a), pa.array(x.upper), _lists(x.near), _lists(x.lower), pa.array(x.rest), *none], names=names)
    if some := np.flatnonzero(counts).tolist():
        rows = {"a": some, "n": counts[some].tolist(), "sums": sums[some].tolist(), "needed": [needed] * len(some), "compared": [compared, *[0] * (len(some) - 1)]}
        yield pa.RecordBatch.from_arrays([pa.array(rows.get(n, [None] * len(some)), t) for n, t in zip(names, types)], names=names)


def _collected(state: DataFrame, k: int, width: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Counts and sums of all tasks by cluster, the most bounds needed, and distances computed."""
    own = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    counts, sums, needed, compared = np.zeros(k, np.int64), np.zeros((k, width), dtype=object), 0, 0
    for r in state.filter("n is not null").groupBy("a").agg(F.sum("n").alias("n"), F.max("needed").alias("needed"), F.sum("compared").alias("compared"), *own).collect():
        counts[r["a"]], sums[r["a"]] = r["n"], [r[f"s{i}"] for i in range(width)]
        needed, compared = max(needed, r["needed"]), compared + r["compared"]
    return counts, sums, needed, compared


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """``(vec_id, v)`` of the vectors with exactly ``dimensions`` finite components, as integers floor(scale * x)."""
    x = F.col("x")
    usable = x.isNotNull() & (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c).cast("int"))
    v = F.when(F.forall(x, lambda c: F.abs(c) <= LARGEST / scale), whole).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST / scale:g}")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x")).filter(usable).select("vec_id", v.alias("v"))


def _order(seed: int) -> list[Column]:
    return [F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256), F.col("v")]


@dataclasses.dataclass
class Clustering:
    assigned: DataFrame  # vec_id, v, cluster
    centroids: list[list[int]]
    compared: list[int]  # distances computed in each assignment


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, stored: int | None = None) -> Clustering:
    """Assign ``vectors(vec_id, v)`` to ``k`` centroids after ``rounds`` updates.

    Centroids start as the ``k`` vectors whose id has the least sha256 (of equal ids the least vectors); with fewer
    vectors there are fewer. Each assignment is one pass without a shuffle: it reads the state that the one
    before wrote in the shared folder, and writes its own with a row of sums for each task and cluster, which
    alone are gathered. A state is deleted once the next is written.
    """
    spark = vectors.sparkSession
    first = vectors.withColumn("at", F.struct(*_order(seed))).orderBy("at").limit(k).select("v").collect()
    if not first:
        return Clustering(vectors.withColumn("cluster", F.lit(0)), [], [])
    now = np.array([r["v"] for r in first], dtype=np.int64)
    k, width = now.shape
    most = min(k - 1, max(2, k // 2)) if stored is None else min(stored, k - 1)
    stored, drift, state, old, compared = most, None, vectors, None, []
    for turn in range(rounds + 1):
        made = state.mapInArrow(lambda batches, c=now, d=drift, s=stored: _round(batches, c, d, s), f"{STATE}, {SUMS}")
        path, rows = written(made)
        if old:
            remove(spark, old)
        old, state = path, rows.filter("n is null").select(*_names(STATE))
        counts, sums, needed, n = _collected(rows, k, width)
        compared.append(n)
        if turn == rounds:
            break
        after = now.copy()
        for c in np.flatnonzero(counts):
            after[c] = [int(s) // int(counts[c]) for s in sums[c]]
        drift = _room(np.sqrt(((after - now) ** 2).sum(axis=1).astype(np.float64)), 1)
        now = after
        if turn:
            stored = min(stored, max(1, needed)) if k > 1 else 0
    return Clustering(state.select("vec_id", "v", F.col("a").alias("cluster")), now.tolist(), compared)


def cluster_report(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, **parameters: int) -> DataFrame:
    """Per usable vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or hold null or non-finite components are left out. Rows may
    repeat and ids may be null (they seed by the text after the colon, which is empty): each row is one vector. An empty
    table, or one without usable vectors, gives an empty table. A component beyond ``LARGEST / scale`` is refused,
    since squared distances would not fit 64 bits.
    """
    spark = rows.sparkSession
    made = cluster(whole_vectors(rows, id_col, vector_col, dimensions, scale), **parameters)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in made.centroids]
    shared = spark.sparkContext.broadcast(np.array(made.centroids, dtype=np.int64).reshape(-1, dimensions))

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("cluster").to_numpy()
            d = _matrix(batch.column("v"), dimensions, np.int64) - shared.value[a] if batch.num_rows else np.zeros((0, dimensions), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(np.einsum("ij,ij->i", d, d))], names=["vec_id", "cluster", "distance"])

    found = made.assigned.mapInArrow(distances, "vec_id long, cluster int, distance long")
    inertia = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # one row for each centroid
    centroids = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    known = inertia.join(F.broadcast(centroids), "cluster").withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """Ten rounds unrolled, each a table of assignments and one of centroids by component."""
    parts = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})""",
        f"parts AS (SELECT r, i, v[i] AS x FROM kept, (SELECT unnest(range(1, {DIMENSIONS + 1})) AS i))",
        f"seeds AS (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), v) - 1 AS c, v FROM kept ORDER BY sha256('{SEED}:' || vec_id), v LIMIT {CLUSTERS})",
        f"c0 AS (SELECT c, i, v[i] AS m FROM seeds, (SELECT unnest(range(1, {DIMENSIONS + 1})) AS i))",
    ]
    for t in range(ROUNDS + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, arg_min(c, d) AS c, min(d) AS d FROM (SELECT r, c, sum((x - m) * (x - m)) * {CLUSTERS} + c AS d FROM parts JOIN c{t} USING (i) GROUP BY r, c) GROUP BY r)")
        if t < ROUNDS:
            means = f"SELECT c, i, CAST(sum(x) // count(*) - CASE WHEN sum(x) % count(*) < 0 THEN 1 ELSE 0 END AS BIGINT) AS m FROM parts JOIN a{t} USING (r) GROUP BY c, i"
            parts.append(f"c{t + 1} AS MATERIALIZED ({means} UNION ALL SELECT c, i, m FROM c{t} WHERE c NOT IN (SELECT c FROM a{t}))")
    last = f"SELECT r, c, (d - c) // {CLUSTERS} AS distance FROM a{ROUNDS}"
    return f"""WITH {", ".join(parts)}, found AS ({last}), named AS (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM found JOIN kept USING (r) JOIN named USING (c)"""


ORACLE = _oracle()
