"""Rendezvous hashing of record keys over weighted shards, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import table

SHARDS = 24
#: Rows that one task numbers at a time.
NUMBERED_ROWS = 500_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) that wins ``key``: each shard draws u in (0, 1] by hash, and the least -ln(u)/weight wins.

    A shard's draw depends on the key and the shard alone: when a shard is added only rows that it wins
    move, and a share of weight/sum(weights) of the keys goes to each. Shards of weight 0 win nothing.
    Null keys count as the text "null". Equal draws go to the lower shard.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights: at least one above 0, none below")
    named = F.coalesce(key.cast("string"), F.lit("null"))
    even = len({w for w in weights if w}) == 1
    best = []
    for shard, weight in enumerate(weights):
        if weight:
            draw = F.substring(F.md5(F.concat(named, F.lit(f":{shard}")).cast("binary")), 1, 13)
            # 52 bits; where weights are equal, the largest draw is the least -ln(u)/weight
            cost = draw if even else F.log((F.conv(draw, 16, 10).cast("double") + 1) / float(2**52)) / weight
            best.append(F.struct(cost.alias("cost"), F.lit(-shard).alias("last")))
    return (-(F.greatest(*best) if len(best) > 1 else best[0])["last"]).cast("int")


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, added: float = 1.0) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    The id and the weights alone decide a row's shard (law ``key``); repeated ids share one, null ids too.
    ``grown_shard`` is the shard with one more of weight ``added``. ``slot`` counts a shard's rows from 0
    without gaps, by id inside ranges of hashed ids; rows of one id come in any order. Null texts have no
    bytes and the checksum of an empty text. An empty table gives an empty table.

    Slots need no shard in one task: rows are numbered within (shard, hash bucket), and a small table of
    bucket counts (shards * buckets rows, buckets in proportion to the rows) gives where each bucket starts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.col(id_col).cast("long")
    shard = rendezvous(key, weights)
    buckets = max(1, -(-docs.count() // (NUMBERED_ROWS * len(weights))))
    # copies of one id are the only rows a bucket cannot part; their own checksum salts them
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets))
    rows = docs.select(key.alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), shard.alias("shard"), rendezvous(key, [*weights, added]).alias("grown_shard"))
    rows = rows.withColumn("bucket", bucket)
    if buckets == 1:
        rows = rows.withColumn("first", F.lit(0).cast("long"))
    else:
        counts = rows.groupBy("shard", "bucket").count()
        before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        firsts = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
        rows = rows.join(firsts, ["shard", "bucket"])
    slot = F.col("first") + F.row_number().over(Window.partitionBy("shard", "bucket", "first").orderBy("doc_id", "text_crc32")) - 1
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


#: SQL has no checksum function: a table of 256 values by the rule of its polynomial, and a fold over the bytes.
ORACLE = """
WITH RECURSIVE steps(i, k, c) AS (
  SELECT i, 0, i::BIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM steps WHERE k < 8),
rule AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (SELECT doc_id, length(h) // 2 + 8 AS size, xor(4294967295, list_reduce([('0x' || h[2 * i + 1:2 * i + 2])::BIGINT FOR i IN range(length(h) // 2)],
  lambda acc, x: xor(acc >> 8, t[1 + (xor(acc, x) & 255)]), 4294967295::BIGINT)) AS text_crc32 FROM hexed, rule),
draws AS (SELECT *, [substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || k), 1, 13) FOR k IN range(25)] AS d FROM sums),
placed AS (SELECT *, list_position(d[1:24], list_max(d[1:24])) - 1 AS shard, list_position(d, list_max(d)) - 1 AS grown FROM draws)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard FROM placed
"""
