"""Table access, free names and connected components shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that are broadcast at most; beyond, rows and keys meet by a shuffle.
BROADCAST_KEYS = 1_000_000


def fresh(name: str, rows: DataFrame) -> str:
    """A column name like ``name`` that ``rows`` does not have in any letter case."""
    taken = {column.lower() for column in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(rows: DataFrame, gone: DataFrame, key: list[Column], kind: str = "left_anti") -> DataFrame:
    """Rows whose ``key`` (expressions over ``rows``) is no row of ``gone``; as ``left_semi``, only those that are.

    Nulls match nulls. Keys are materialised, and broadcast only when few.
    """
    names = [fresh(f"key_{k}", rows) for k in range(len(key))]
    keys = cut(gone.distinct().toDF(*names))
    same = key[0].eqNullSafe(keys[names[0]])
    for column, name in zip(key[1:], names[1:]):
        same &= column.eqNullSafe(keys[name])
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, same, kind)


def _larger_to_smaller(edges: DataFrame) -> DataFrame:
    """One round of large-star: every larger neighbour of a vertex is linked to the smallest one it knows."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _smaller_to_smallest(edges: DataFrame) -> DataFrame:
    """One round of small-star over edges held as (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    kept = edges.join(least, "a")
    moved = kept.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


#: Edges that one task settles at most (16 bytes each); more are settled by rounds of joins.
EDGES_AT_ONCE = 1_000_000


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(id, component_id)`` of all edges of one task: least labels, passed along edges and halved on the way."""
    tables = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches if batch.num_rows]
    if not tables:
        return
    ids, ends = np.unique(np.concatenate(tables, axis=1), return_inverse=True)
    a, b = ends.reshape(2, -1)
    parent = np.arange(len(ids))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[parent])], names=["id", "component_id"])


def components(edges: DataFrame, rounds: int = 40, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """Connected components of ``edges(a, b)`` (longs): rows ``(id, component_id)`` for every vertex with an edge.

    ``component_id`` is the smallest vertex reachable. Up to a checked number of edges one task settles them
    all. More are settled by alternating large-star and small-star rounds on edges alone, so that nothing but a
    count and a checksum comes to the driver; minima are combined before the shuffle, and a hub's edges meet
    only in joins that adaptive execution can split. Loops and repeated edges are harmless; an empty table
    gives an empty table.
    """
    at = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if at.count() <= at_once:
        return at.coalesce(1).mapInArrow(_settled, "id long, component_id long")
    seen = None
    for _ in range(rounds):
        at = cut(_smaller_to_smallest(_larger_to_smaller(at)))
        # a forest of stars is stable: nobody is both a child and a centre, and each child has one centre
        mark = at.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen:
            break
        seen = (mark["n"], mark["h"])
    else:
        raise RuntimeError("components did not settle")
    centres = at.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
    return at.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(centres)
