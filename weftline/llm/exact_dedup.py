"""Exact dedup by splitting off heavy hitters.

Digests that may be frequent are found by a Misra-Gries summary, their exact figures are computed by a
map-side filter and a partial aggregate, and the verified winners (never more than ``counters``) are
broadcast, so that rows of hot groups are settled where they are read. All other digests are shuffled, after
each task has combined its own rows of a digest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table
from weftline.session import cut

#: Counters of a summary; also the most rows that are ever broadcast (about 100 bytes each).
COUNTERS = 2048


def summarise(values: Iterable[bytes], counters: int) -> tuple[dict[bytes, int], int, int]:
    """Misra-Gries over ``values``: counts, what each of them may lack, and the number of values.

    A value is missing from the counts only if it makes up 1/(counters+1) of all at most.
    """
    counts: dict[bytes, int] = {}
    lacking = total = 0
    for value in values:
        total += 1
        if value in counts:
            counts[value] += 1
        elif len(counts) < counters:
            counts[value] = 1
        else:
            lacking += 1
            counts = {key: count - 1 for key, count in counts.items() if count > 1}
    return counts, lacking, total


def frequent_candidates(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``(digest)``: at most ``counters`` rows, with every digest above 2/(counters+1) of all rows.

    Each partition keeps a summary of its own and passes on only what may be above 1/(counters+1) of its
    rows, so that partitions of mostly different texts pass on next to nothing. Counts passed on never
    exceed the truth and fall short by 1/(counters+1) of all rows at most (and by one in a partition that saw
    a digest once, which is not passed on); hence the guarantee.
    """

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, lacking, total = summarise((value for batch in batches for value in batch.column(0).to_pylist()), counters)
        may = {key: count for key, count in counts.items() if count > 1 and (count + lacking) * (counters + 1) > total}
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(may), pa.binary()), "seen": pa.array(list(may.values()), pa.int64())})

    sums = digests.select("digest").mapInArrow(of_partition, "digest binary, seen long").groupBy("digest").agg(F.sum("seen").alias("seen"))
    return sums.orderBy(F.desc("seen"), "digest").limit(counters).select("digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty, and texts are equal only when identical. Of equal texts the row with the
    largest id stays; null ids come before all others, and of rows that share the largest id one row stays.
    Empty tables give empty tables; other columns of ``docs`` are not read, so their names cannot clash.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = cut(rows)  # texts are read and hashed once, and row numbers stay as they are
    best = F.max(F.struct("doc_id", "row"))
    candidates = F.broadcast(frequent_candidates(rows, counters))  # at most `counters` rows
    winners = rows.join(candidates, "digest", "left_semi").groupBy("digest").agg(best.alias("best"), F.count("*").alias("n"))
    heavy = cut(winners.filter("n > 1").limit(counters))  # bounded by the candidates
    hot = rows.join(F.broadcast(heavy), "digest").select("doc_id", "digest", "row", "best", "n")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    # a row of a digest of its own is its own best; only rows of groups, found by combined counts, are joined back
    counted = rest.groupBy("digest").agg(best.alias("best"), F.count("*").alias("n"))
    groups = cut(counted.filter("n > 1"))
    alone = counted.filter("n = 1").select("best.doc_id", "digest", "best.row", "best", "n")
    together = rest.join(groups, "digest").select("doc_id", "digest", "row", "best", "n")
    return hot.union(alone).union(together).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
