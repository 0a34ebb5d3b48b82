"""Bounded samples of labelled documents for fitting, and the split into fitted and held-out rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import BROADCAST_KEYS
from weftline.session import cut


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for null ids."""
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(modulus)).cast("int")


def held_out(doc_id: Column, modulus: int, rest: int) -> Column:
    """Whether labels of a row are kept from fitting. A row with a null id has no label and is not held out."""
    return F.coalesce(remainder(doc_id, modulus) == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, rest: int, per_class: int, longest: int) -> tuple[list[str], list[int]]:
    """Texts and labels (0 or 1) to fit on: at most ``per_class`` of each label, none of them held out.

    An id counts once, with its greatest label and the least of its texts, so tables with repeated rows give
    the same sample. Ids are taken in the order of their hashes, which no property of a row decides. Labelled
    texts of more than ``longest`` bytes are not fitted on (all are scored); where such texts, or ids without
    a document, leave a label short, more of its ids are looked at, until it has enough or none is left. What
    comes to the driver is bounded by 2 * per_class * longest bytes.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"), modulus, rest)).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= longest)
    asked = per_class + per_class // 4
    while True:
        some = cut(reduce(DataFrame.union, (known.filter(F.col("label") == k).orderBy(*order).limit(asked) for k in (0, 1))))
        # some ids, of which all rows are found where documents are read
        found = texts.join(F.broadcast(some) if asked <= BROADCAST_KEYS else some, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
        place = F.row_number().over(Window.partitionBy("label").orderBy(*order))
        rows = found.withColumn("place", place).filter(F.col("place") <= per_class).orderBy("label", "place").collect()
        # a label that gave all its ids has no more
        short = [k for k in (0, 1) if sum(r["label"] == k for r in rows) < per_class]
        if all(some.filter(F.col("label") == k).count() < asked for k in short):
            return [r["text"] for r in rows], [r["label"] for r in rows]
        asked *= 8
