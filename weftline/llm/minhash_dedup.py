"""Near-duplicate documents by a chosen-path set similarity join.

A set of word shingles is represented by minwise values. Each of several independent trees starts with one
coordinate: documents with the same minwise value there share a node. Nodes of more than ``leaf`` documents
branch again, on one or two coordinates that the node's own hash selects, until they are small or ``depth``
is reached. Pairs inside leaves are compared; a pair of similarity s stays together with chance s for each
child, and a node has 1/s children on average, so that a pair at the threshold does not die out on the way.
Repeated trees bring the recall to what is wanted: where nodes branched, classes of large nodes get as many
more trees as the deepest branching asks for (``trees_for``).

No group is expanded into all its pairs, and no link between components is lost:

1. Documents with equal sets are one class, merged before any tree.
2. Each leaf proposes a star around one of its members; the best proposal of each document is confirmed on
   full sets, and confirmed links give components. Leaves that lie inside one component have nothing to add;
   the others propose again, around other members, to the members that are in other components.
3. Leaves that then still hold several components compare all pairs between different components, and only
   those: by sketch first, which leaves the members that may have a link, then on full sets. A leaf meets in
   one place, in tiles of bounded size, so each member's text moves once a tile however many pairs it is in,
   and only links leave.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import components, table
from weftline.llm.shingles import WORDS, shingle_sets
from weftline.session import cut

#: Minwise values that trees choose from, and bytes of a sketch (one for each of as many minwise values).
COORDINATES, SKETCH = 64, 128
_FACTORS = np.random.default_rng(11).integers(1 << 62, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Pairs whose estimate is further below the threshold are dropped before full sets are compared. An
#: estimate from 128 values has a standard deviation of 0.04 at most near 0.75, so this is over four of them.
MARGIN = 0.17
#: Wanted chance that a pair at the threshold meets in a leaf.
RECALL = 0.999
#: Ids of candidates that are broadcast at most (16 bytes each); beyond, ids and texts meet by a shuffle.
BROADCAST_IDS = 1_000_000
#: Nodes that are broadcast at most (some 40 bytes each), and parts of a node's rows where even large nodes are more.
BROADCAST_NODES, SALTS = 100_000, 8


def twice(similarity: float) -> float:
    """Share of nodes that branch on two coordinates, for 1/similarity children on average (in 1024ths, rounded up)."""
    return min(1024, math.ceil(1024 * (1 / similarity - 1))) / 1024


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The least image of the set under each of SKETCH hash functions."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(least, (shingles[at : at + 512, None] * _FACTORS).min(axis=0), out=least)
    return least >> np.uint64(32)


def describe(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, set_key, minwise, sketch)`` for rows ``(doc_id, text)``; set_key is null for empty sets."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                texts = some.column(1).cast(pa.binary()).to_pylist()
                sizes, keys, values, sketches = [], [], [], []
                for shingles in shingle_sets(texts, words):
                    sizes.append(len(shingles))
                    if not len(shingles):
                        keys.append(None), values.append(None), sketches.append(None)
                        continue
                    least = minwise(shingles)
                    keys.append(hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest())
                    values.append(least[:COORDINATES].astype(np.uint32).view(np.int32))
                    sketches.append((least & np.uint64(255)).astype(np.uint8).tobytes())
                columns = [some.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(values, pa.list_(pa.int32())), pa.array(sketches, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_key", "minwise", "sketch"])

    return docs.mapInArrow(of_partition, "doc_id long, n_shingles long, set_key binary, minwise array<int>, sketch binary")


def trees_for(similarity: float, branchings: int, recall: float = RECALL) -> int:
    """Trees with which a pair meets in a leaf with chance ``recall``, when its nodes branch ``branchings`` times.

    Trees choose from the same COORDINATES values, of which a pair agrees on a binomial number.
    """

    two = twice(similarity)

    def missed(share: float) -> float:
        below = 0.0
        for _ in range(branchings):
            child = 1 - share + share * below
            below = (1 - two) * child + two * child**2
        return 1 - share + share * below

    chances = [math.comb(COORDINATES, k) * similarity**k * (1 - similarity) ** (COORDINATES - k) for k in range(COORDINATES + 1)]
    misses = [missed(k / COORDINATES) for k in range(COORDINATES + 1)]
    trees = 1
    while sum(c * m**trees for c, m in zip(chances, misses)) > 1 - recall:
        trees += 1
    return trees


def _at_nodes(rows: DataFrame, nodes: DataFrame, leaf: int) -> DataFrame:
    """``rows`` with what ``nodes(node, size, ...)``, materialised, says of their node; rows of other nodes go.

    No node's rows need to meet in one task. A checked number of nodes is broadcast. Where there are more, it
    is the nodes of more than ``leaf`` rows, and only rows of small ones are shuffled; where even these are
    many, rows are dealt over SALTS parts of each node.
    """
    if nodes.count() <= BROADCAST_NODES:
        return rows.join(F.broadcast(nodes), "node")
    large, small = nodes.filter(F.col("size") > leaf), nodes.filter(F.col("size") <= leaf)
    if large.count() <= BROADCAST_NODES:
        return rows.join(F.broadcast(large), "node").unionByName(rows.join(F.broadcast(large.select("node")), "node", "left_anti").join(small, "node"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    return salted.join(nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["node", "salt"]).drop("salt")


def _in_shared_nodes(rows: DataFrame, leaf: int) -> DataFrame:
    """Rows ``(node, class, rep)``, or ``(node, class, rep, part)``, whose node has other reps (parts), with the node's size; combined before the shuffle."""
    what = "part" if "part" in rows.columns else "rep"
    sizes = cut(rows.groupBy("node").agg(F.count("*").alias("size"), F.min(what).alias("low"), F.max(what).alias("high")).filter("low < high").drop("low", "high"))
    return cut(_at_nodes(rows, sizes, leaf))


def leaves(classes: DataFrame, trees: range, leaf: int, depth: int, similarity: float = 0.75) -> tuple[DataFrame, int, DataFrame]:
    """``(node, rep)``: the leaves of ``trees`` that hold classes of more than one rep of ``classes(class, rep, minwise)``.

    With a column ``part``, those that hold more than one part. Also how often nodes branched one below the
    other, and ``(rep)`` of the classes in roots that branched.
    """
    labels = [c for c in classes.columns if c == "part"]
    coordinates = np.random.default_rng(3).permutation(COORDINATES)
    roots = [F.xxhash64(F.lit(tree), F.element_at("minwise", int(coordinates[tree % COORDINATES]) + 1)) for tree in trees]
    rows = classes.select(F.explode(F.array(*roots)).alias("node"), "class", "rep", *labels)
    found = crowded = None
    for level in range(1, depth + 1):
        shared = _in_shared_nodes(rows, leaf)
        small = shared.filter(F.col("size") <= leaf) if level < depth else shared
        found = small.select("node", "rep") if found is None else found.union(small.select("node", "rep"))
        large = shared.filter(F.col("size") > leaf)
        crowded = large.select("rep").distinct() if crowded is None else crowded
        if level == depth or large.isEmpty():
            break
        choice = F.xxhash64("node", F.lit("choice"))
        first, second = F.pmod(choice, F.lit(COORDINATES)), F.pmod(F.shiftright(choice, 20), F.lit(COORDINATES))
        child = lambda c: F.xxhash64("node", c, F.element_at("minwise", (c + 1).cast("int")))
        both = F.when((F.pmod(F.shiftright(choice, 45), F.lit(1024)) < round(1024 * twice(similarity))) & (first != second), F.array(child(first), child(second))).otherwise(F.array(child(first)))
        rows = large.select("node", "class").join(classes, "class").select(F.explode(both).alias("node"), "class", "rep", *labels)
    # levels add partitions up; what follows needs no more of them than a shuffle has
    return found.coalesce(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), level - 1, crowded


def _mixed(nodes: DataFrame, parts: DataFrame, leaf: int) -> DataFrame:
    """``(node, rep, part)`` of the nodes that hold several components."""
    labelled = cut(nodes.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("node", "rep", F.coalesce("component_id", "rep").alias("part")))
    several = cut(labelled.groupBy("node").agg(F.count("*").alias("size"), F.min("part").alias("low"), F.max("part").alias("high")).filter("low < high").select("node", "size"))
    return cut(_at_nodes(labelled, several, leaf))


def _estimated(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """``(a, b, to, similarity)`` of the distinct pairs ``(a, b, to)`` whose sketches agree enough."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH) for k in (3, 4))
            share = (x == y).mean(axis=1)
            similarity = (share - 1 / 256) / (1 - 1 / 256)
            near = similarity >= least
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(pa.array(near)) for k in range(3)), pa.array(similarity[near])], names=["a", "b", "to", "similarity"])

    of_a = classes.select(F.col("rep").alias("a"), F.col("sketch").alias("x"))
    of_b = classes.select(F.col("rep").alias("b"), F.col("sketch").alias("y"))
    return pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "to", "x", "y").mapInArrow(of_partition, "a long, b long, to long, similarity double")


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one of ``ids(doc_id)``: most documents have no candidate, and need not move.

    Up to a checked number of ids, texts are filtered where they are read.
    """
    wanted = cut(ids.distinct())
    return cut(docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "doc_id", "left_semi"))


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs ``(a, b)`` with 100 * intersection >= percent * union on full sets. ``pairs`` must be materialised."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                left, right = some.column(0).to_pylist(), some.column(1).to_pylist()
                x, y = some.column(2).cast(pa.binary()).to_pylist(), some.column(3).cast(pa.binary()).to_pylist()
                texts = dict.fromkeys([*x, *y])
                sets = dict(zip(texts, shingle_sets(list(texts), words)))
                kept = []
                for k, (s, t) in enumerate(zip(x, y)):
                    common = len(np.intersect1d(sets[s], sets[t], assume_unique=True))
                    kept.append(common > 0 and 100 * common >= percent * (len(sets[s]) + len(sets[t]) - common))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, k in zip(left, kept) if k], pa.int64()), pa.array([b for b, k in zip(right, kept) if k], pa.int64())], names=["a", "b"])

    texts = _wanted(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")))
    of_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    of_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return cut(pairs.select("a", "b").join(of_a, "a").join(of_b, "b").select("a", "b", "x", "y").mapInArrow(of_partition, "a long, b long").distinct())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows that share their first column, whatever batches they come in."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        keys = rows.column(0).to_numpy()
        bounds = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1)) if len(keys) else np.zeros(0, np.int64)
        for first, end in zip(bounds, bounds[1:]):
            yield rows.slice(first, end - first)
        held = rows.slice(bounds[-1]) if len(bounds) else None
    if held is not None:
        yield held


def _tiles(mixed: DataFrame, tile: int) -> DataFrame:
    """``(tile, rep, part)``: nodes ``(node, size, rep, part)`` as they are, larger ones as pairs of blocks of hashed members."""
    blocks = F.ceil(2 * F.col("size") / tile)
    small = mixed.filter(F.col("size") <= tile).select(F.col("node").alias("tile"), "rep", "part")
    large = mixed.filter(F.col("size") > tile).withColumn("own", F.pmod(F.xxhash64("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return small.union(large.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), "rep", "part"))


def _hopeful(tiles: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Rows of ``tiles`` whose sketch agrees enough with one of another component in the tile."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            parts = group.column(2).to_numpy()
            sketches = np.frombuffer(b"".join(group.column(3).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            good = np.zeros(len(parts), dtype=bool)
            for at in range(0, len(parts), 128):
                share = (sketches[at : at + 128, None, :] == sketches[None, :, :]).mean(axis=2)
                near = ((share - 1 / 256) / (1 - 1 / 256) >= least) & (parts[at : at + 128, None] != parts[None, :])
                good[at : at + 128] = near.any(axis=1)
            if good.any():
                # once for each rep: all texts of its id come along
                yield from group.select([0, 1, 2]).filter(pa.array(good)).group_by(["tile", "rep", "part"]).aggregate([]).to_batches()

    rows = tiles.join(classes.select("rep", "sketch"), "rep").select("tile", "rep", "part", "sketch")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(of_partition, "tile long, rep long, part long")


def _links_in_tiles(rows: DataFrame, docs: DataFrame, percent: int, words: int, least: float) -> DataFrame:
    """Links ``(a, b)`` that join components of a tile, all pairs of which are settled on full sets."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            reps = group.column(1).to_pylist()
            parent = {part: part for part in group.column(2).to_pylist()}
            parts = group.column(2).to_pylist()
            sets = list(shingle_sets(group.column(3).cast(pa.binary()).to_pylist(), words))
            values = np.stack([minwise(x) for x in sets])

            def root(part: int) -> int:
                while parent[part] != part:
                    parent[part] = part = parent[parent[part]]
                return part

            found = []
            for i in range(len(reps) - 1):
                near = np.flatnonzero((values[i + 1 :] == values[i]).mean(axis=1) >= least) + i + 1
                for j in near.tolist():
                    if (x := root(parts[i])) != (y := root(parts[j])):
                        small, large = sorted((sets[i], sets[j]), key=len)
                        if 100 * len(small) < percent * len(large):
                            continue
                        at = np.searchsorted(large, small)
                        common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                        if 100 * common >= percent * (len(small) + len(large) - common):
                            parent[x] = y
                            found.append((min(reps[i], reps[j]), max(reps[i], reps[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*found)], names=["a", "b"])

    texts = _wanted(docs, rows.select(F.col("rep").alias("doc_id")))
    full = rows.join(texts.withColumnRenamed("doc_id", "rep"), "rep").select("tile", "rep", "part", "text")
    return cut(full.repartition("tile").sortWithinPartitions("tile").mapInArrow(of_partition, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, words: int = WORDS, trees: int = 8, leaf: int = 2048, depth: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts are linked when 100 * |intersection| >= percent * |union| of their distinct shingles of ``words``
    words, whole texts read; every link is confirmed on full sets. Texts without words, and null texts, have
    empty sets and link with nothing. Rows of one id are one document: they share a component, and each of
    its texts may link it. ``trees`` are the first ones; deep branching adds more until RECALL is held at
    ``percent``. Rows with a null id link with nothing, have a null component and are kept. An
    empty table gives an empty table. Columns beside id and text are not read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    described = cut(describe(texts, words))
    of_class = described.filter("set_key is not null and doc_id is not null")
    ids = of_class.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    classes = cut(of_class.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("minwise").alias("minwise"), F.first("sketch").alias("sketch")).drop("set_key").withColumn("class", F.monotonically_increasing_id()))  # several of one rep, if its id has several texts
    nodes, branchings, crowded = leaves(classes.select("class", "rep", "minwise"), range(trees), leaf, depth, percent / 100)
    least = percent / 100 - MARGIN

    # centres follow one order of all documents, so that nodes of a group agree on few of them
    centres = cut(nodes.groupBy("node").agg(F.count("*").alias("size"), F.min_by("rep", F.xxhash64("rep")).alias("centre")))
    star = _at_nodes(nodes, centres, leaf).filter("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b"), F.col("rep").alias("to")).dropDuplicates(["a", "b"])
    likely = F.struct((F.col("similarity") < percent / 100 + 0.05).alias("doubtful"), F.xxhash64(F.col("a") + F.col("b") - F.col("to")).alias("order"), "a", "b")
    best = cut(_estimated(star, classes, least).groupBy("to").agg(F.min(likely).alias("best")).select("best.a", "best.b").distinct())
    links = _confirmed(best, texts, percent, words)
    parts = cut(components(links))
    while (wanted := trees_for(percent / 100, branchings)) > trees:
        # only classes that shared large nodes lack trees, and only nodes of several components can add links
        labelled = classes.join(crowded, "rep", "left_semi").join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("class", "rep", "minwise", F.coalesce("component_id", "rep").alias("part"))
        again, deeper, _ = leaves(cut(labelled), range(trees, wanted), leaf, depth, percent / 100)
        nodes, branchings, trees = nodes.union(again), max(branchings, deeper), wanted
    mixed = _mixed(nodes, parts, leaf)
    more = _links_in_tiles(cut(_hopeful(_tiles(mixed, leaf), classes, least)), texts, percent, words, least)

    # Rows of one id with different sets, of which one class is not named after it, still are one document.
    same = of_class.select("doc_id", "set_key").join(ids, "set_key").filter("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    repeated = of_class.groupBy("doc_id").agg(F.min("set_key").alias("low"), F.max("set_key").alias("high")).filter("low < high")
    links_of_ids = same.join(repeated.select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")
    final = cut(components(links.union(more).union(links_of_ids)))

    of_rep = ids.join(final.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    known = of_class.select("doc_id", "n_shingles", "set_key").join(of_rep, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = described.filter("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs that share a shingle, by a join on shingles: for small tables only.
ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF w <> ''] AS w FROM documents),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM words),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM common JOIN sizes m ON m.doc_id = x JOIN sizes n ON n.doc_id = y WHERE 100 * c >= 75 * (m.n + n.n - c)),
ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, w.y FROM reach r JOIN ways w ON w.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""
