"""Mentions of characters: phrases of a cast, names that a model proposes, aliases, stop words."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline import fixed
from weftline.session import cut


def alias_table(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or fixed.alias_rows(), "alias string, canonical string")


def stop_table(spark: SparkSession, words: list[str] = fixed.STOPLIST) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def phrase_pattern(phrases: list[str]) -> str:
    """One pattern for many phrases: the longest first, in their own case, between word boundaries.

    Letters that phrases begin with are asked for first: at most places of a text nothing else is looked at.
    """
    begin = "(?=[" + "".join(re.escape(c) for c in sorted({p[0] for p in phrases if p})) + "])" if phrases and all(phrases) else ""
    return begin + r"(?<![\p{L}\p{N}])(" + "|".join(re.escape(p) for p in sorted(set(phrases), key=lambda p: (-len(p), p))) + r")(?![\p{L}\p{N}])"


def gazetteer(lines: DataFrame, spark: SparkSession, aliases: list[tuple[str, str]] | None = None) -> DataFrame:
    """``(*lines, character, surface, source, at)``: phrases of the cast in the lines, by one pass of one pattern."""
    rows = aliases or fixed.alias_rows()
    found = lines.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(phrase_pattern([a for a, _ in rows])), F.lit(1))).alias("at", "surface"))
    names = F.broadcast(alias_table(spark, list(dict(rows).items())).select(F.col("alias").alias("surface"), F.col("canonical").alias("character")))  # as long as the cast
    return found.join(names, "surface").withColumn("source", F.lit("gazetteer"))


def capitalised(lines: DataFrame, shape: str = r"\b([A-Z][a-z]{3,})") -> DataFrame:
    """The stand-in for a statistical model: capitalised words as proposed names."""
    return lines.select("*", F.posexplode(F.regexp_extract_all("text", F.lit(shape), F.lit(1))).alias("at", "surface"))


def once_per_line(found: DataFrame, keys: list[str] = ["episode", "line_idx"]) -> DataFrame:  # noqa: B006
    """A character counts once in a line, with its first surface."""
    first = Window.partitionBy(*keys, "character").orderBy("at", "surface")
    return found.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def zipf(count: Column, total: Column) -> Column:
    """Occurrences per billion words, as a power of ten."""
    return F.log10(count * 1e9 / total)


def frequencies(words: DataFrame) -> DataFrame:
    """``(word, zipf)`` of ``(word)``: what tells common words from names, counted over a whole corpus."""
    return zipfs(words.groupBy("word").agg(F.count("*").alias("n")))


def zipfs(counts: DataFrame) -> DataFrame:
    """``(word, zipf)`` of ``(word, n)``."""
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("word", zipf(F.col("n"), F.col("total")).alias("zipf"))  # one row


def resolve(surfaces: DataFrame, spark: SparkSession, aliases: list[tuple[str, str]] | None = None, stop: list[str] = fixed.STOPLIST, frequencies: DataFrame | None = None, max_zipf: float = fixed.MAX_ZIPF) -> DataFrame:
    """``character`` for distinct proposed names in ``surface``, null for those that are none.

    A cut-off name ("Sakur-") is the one canonical name with an alias that begins so, if it is one and three
    letters are there. Others lose possessive and honorific, then a title, then all but the first word, and
    the first of these forms that is an alias decides. What remains must look like a name, be no stop word,
    and (given ``frequencies`` of (word, zipf)) hold no common word.
    """
    table = dict((a.lower(), c) for a, c in (aliases or fixed.alias_rows()))
    known = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))  # as long as the cast
    raw = F.btrim("surface", F.lit(" .,!?…\"'"))
    cut_off = raw.rlike("[-–—]$")
    name = F.regexp_replace(F.rtrim(F.regexp_replace(raw, "[-–— ]+$", "")), fixed.POSSESSIVE, "")
    plain = F.btrim(F.regexp_replace(name, fixed.HONORIFIC, ""))
    untitled = F.btrim(F.regexp_replace(plain, fixed.TITLE, ""))
    proper = F.when((untitled == F.upper(untitled)) & (untitled != F.lower(untitled)), F.initcap(F.lower(untitled))).otherwise(untitled)
    rows = surfaces.withColumns({"__cut": cut_off, "__name": name})
    rows = rows.withColumns({"__alias": F.coalesce(known[F.lower(plain)], known[F.lower(untitled)], known[F.lower(F.split(untitled, " ")[0])]), "__proper": proper})
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(c).alias("c")) for a, c in table.items()))
    begun = F.array_distinct(F.transform(F.filter(pairs, lambda p: F.startswith(p["a"], F.lower("__name"))), lambda p: p["c"]))
    shaped = (F.length("__proper") >= 4) & F.col("__proper").rlike(fixed.NAME_SHAPE) & ~F.lower("__proper").isin(stop)
    new = F.when(shaped, F.col("__proper"))
    if frequencies is not None:
        words = rows.select("__proper").distinct().select("__proper", F.explode(F.split(F.lower("__proper"), " ")).alias("word"))
        common = words.join(frequencies, "word").filter(F.col("zipf") >= max_zipf).select("__proper").distinct().withColumn("__common", F.lit(True))
        rows = rows.join(common, "__proper", "left")
        new = F.when(F.col("__common").isNull(), new)
    cut = F.when((F.length("__name") >= 3) & (F.size(begun) == 1), begun[0])
    return rows.withColumn("character", F.when(F.col("__cut"), cut).otherwise(F.coalesce("__alias", new))).drop("__cut", "__name", "__alias", "__proper", "__common")


def without_stop_words(mentions: DataFrame, stop: DataFrame) -> DataFrame:
    return mentions.join(F.broadcast(stop), F.lower("character") == F.col("word"), "left_anti")


def extract(lines: DataFrame, spark: SparkSession, model: Callable[[DataFrame], DataFrame] | None = None, aliases: list[tuple[str, str]] | None = None, frequencies: DataFrame | None = None) -> DataFrame:
    """Mentions by the cast first, then by a model where one is given; each character once a line.

    What the cast claims is blanked before the model reads a line, so that no part of a phrase is a name again.
    """
    rows = aliases or fixed.alias_rows()
    found = gazetteer(lines, spark, rows).drop("text")
    if model is not None:
        claimed = phrase_pattern([alias for alias, _ in rows])
        proposed = cut(model(lines.withColumn("text", F.regexp_replace("text", claimed, " "))).drop("text"))  # a model reads the lines once
        names = resolve(proposed.select("surface").distinct(), spark, rows, frequencies=frequencies).filter("character is not null")
        later = proposed.join(names, "surface").withColumns({"source": F.lit("model"), "at": F.col("at") + 1_000_000})  # after all phrases
        found = found.unionByName(later)
    return once_per_line(found)
