"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before kept. Classifiers are
fitted on a bounded sample of the labelled rows among ``docs``. All stages but the last return rows and
columns of ``docs`` as they are; what a stage decides is which rows stay. Empty tables pass through. Where
labelled rows of both labels are missing a classifier cannot be fitted: it rejects nothing and logs so.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, exact_dedup, minhash_dedup, packing, quality, toxicity
from weftline.llm.common import fresh, table, without
from weftline.session import cut, scratch

LOG = logging.getLogger("weftline.pipeline")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network does not reject."""
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    if not isinstance(model, toxicity.Network):
        LOG.warning("toxicity: too few labelled documents to fit on, nothing is rejected")
        return docs
    scored = toxicity.score_toxicity(docs, model, keep_columns=True)
    return scored.filter(F.col(scored.columns[-1]) == 0).select(*_named(docs))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours vote for."""
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    if not isinstance(model, quality.Model):
        LOG.warning("quality: too few labelled documents to fit on, nothing is rejected")
        return docs
    scored = quality.score_quality(docs, model, keep_columns=True)
    return scored.filter(F.col(scored.columns[-1]) == 1).select(*_named(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; of rows with one id and one text, one."""
    decided = cut(exact_dedup.exact_dedup(docs).select("doc_id", "text_sha256", "kept"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = [F.col("doc_id").cast("long"), F.sha2(text.cast("binary"), 256)]
    gone = decided.filter("not kept").select("doc_id", "text_sha256")
    twins = gone.intersect(decided.filter("kept").select("doc_id", "text_sha256"))  # rows that repeat the one that stays
    same_text = fresh("same_text", docs)
    once = without(docs, twins, key, "left_semi").withColumn(same_text, text).dropDuplicates(["doc_id", same_text])
    return without(docs, gone, key).unionByName(once.drop(same_text)).select(*_named(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents, the one with the smallest id."""
    decided = minhash_dedup.near_duplicates(docs)
    return without(docs, decided.filter("not kept").select("doc_id"), [F.col("doc_id").cast("long")]).select(*_named(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents that are left, with their places in sequences."""
    return packing.pack(docs, bpe.default_path())


def _named(docs: DataFrame) -> list:
    return [F.col(f"`{name}`") for name in docs.columns]


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: Trained classifiers and statistics of tokens have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written as Parquet in the shared folder and read again.

    Results of stages are there until the application ends.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
