"""Scans and sinks: subtitles, transcripts, articles, cached tables, reports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as X
from weftline.operators.dialogue import keep_first
from weftline.operators.ordered import in_order

EPISODE = r"(?i)Season\s*(\d+)\s*-\s*(\d+)"
SRT_TIME = r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)"


def raw_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".ass", ".srt")) -> DataFrame:
    """``(path, raw)`` of the files below ``path`` with one of the suffixes, in any case; an error if there is none."""
    # binary files keep what a text reader would trim or split
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.filter(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no {', '.join(suffixes)} files in {path}")
    decoded = F.make_valid_utf8(F.col("content").cast("string"))  # bytes that are no UTF-8 become the replacement character
    return files.select("path", F.regexp_replace(decoded, "^﻿", "").alias("raw"))


def ass_events(files: DataFrame) -> DataFrame:
    """``(path, event_no, start, end, text)`` of ASS scripts: dialogue of the events section, by its own format line."""
    rows = files.select("path", F.posexplode(F.split("raw", r"\r\n|\r|\n")).alias("event_no", "line")).withColumn("line", F.btrim("line", F.lit(" \t\x0b\x0c")))
    # the section a line stands in, and the last format line of it, run along the file
    file = Window.partitionBy("path").orderBy("event_no").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.startswith("line", F.lit("["))
    inside = F.lower(F.last(F.when(begins, F.col("line")), ignorenulls=True).over(file)) == "[events]"
    rows = rows.withColumn("inside", inside)
    formats = F.when(F.col("inside") & F.startswith("line", F.lit("Format:")), F.col("line"))
    rows = rows.withColumn("format", F.last(formats, ignorenulls=True).over(file))
    rows = rows.filter(F.col("inside") & F.col("format").isNotNull() & F.startswith("line", F.lit("Dialogue:")))
    fields = F.transform(F.split(F.substr("format", F.lit(8)), ","), lambda f: F.lower(F.btrim(f)))
    rows = rows.select("path", "event_no", fields.alias("fields"), F.substr("line", F.lit(10)).alias("rest"))
    rows = rows.withColumn("values", F.expr("split(rest, ',', size(fields))"))
    # a field that the format lacks is null; filters may run before sections are told apart
    value = lambda name: F.try_element_at("values", F.nullif(F.array_position("fields", F.lit(name)).cast("int"), F.lit(0)))
    return rows.select("path", "event_no", X.timecode(value("start")).alias("start"), X.timecode(value("end")).alias("end"), X.clean_text(value("text")).alias("text")).filter("text <> ''")


def srt_events(files: DataFrame) -> DataFrame:
    """The same of SRT scripts: blocks between blank lines, with a time line and any number of text lines."""
    blocks = files.select("path", F.posexplode(F.split(F.replace("raw", F.lit("\r\n"), F.lit("\n")), r"\n\s*\n")).alias("event_no", "block"))
    part = lambda k: F.regexp_extract("block", SRT_TIME, k).cast("int")
    seconds = lambda k: part(k) * 3600 + part(k + 1) * 60 + part(k + 2) + part(k + 3) / 1000
    after = F.regexp_replace("block", f"(?s)^.*?{SRT_TIME}", "")
    return blocks.filter(F.col("block").rlike(SRT_TIME)).select("path", "event_no", seconds(1).alias("start"), seconds(5).alias("end"), X.clean_text(after).alias("text")).filter("text <> ''")


def subtitles(spark: SparkSession, path: str) -> DataFrame:
    """``events`` of the subtitle files below a path."""
    return events(raw_files(spark, path))


def events(files: DataFrame) -> DataFrame:
    """``(episode, season, start, end, text, line_idx)`` of ``(path, raw)``: events by start, ties in the order of the file."""
    srt = F.lower("path").endswith(".srt")
    found = ass_events(files.filter(~srt)).unionByName(srt_events(files.filter(srt)))
    name = F.url_decode(F.replace(F.regexp_extract("path", r"([^/]+)$", 1), F.lit("+"), F.lit("%2B")))
    season, episode = F.regexp_extract(name, EPISODE, 1), F.regexp_extract(name, EPISODE, 2)
    unnamed = F.raise_error(F.concat(F.lit("no season and episode in "), name))
    found = found.select(F.when(episode == "", unnamed.cast("int")).otherwise(episode.cast("int")).alias("episode"), season.cast("int").alias("season"), "start", "end", "text", "event_no")
    order = Window.partitionBy("episode").orderBy("start", "event_no")
    return found.withColumn("line_idx", F.row_number().over(order) - 1).drop("event_no")


def transcript(spark: SparkSession, path: str, min_words: int = 1) -> DataFrame:
    """``(turn, speaker, line, prev_speaker, prev_line)`` of a CSV file of name and line.

    Rows without name or line go, then those of fewer words; turns count what is left, and the previous line
    is the previous one left. Rows of one file keep their order.
    """
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, schema="name string, line string")
    rows = rows.withColumn("at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id())).dropna(subset=["name", "line"])
    rows = rows.select("at", X.squeeze(F.col("name")).alias("speaker"), X.clean_line(F.col("line")).alias("line")).filter(X.word_count(F.col("line")) >= min_words)
    return transcript_turns(rows, "at")


def transcript_turns(rows: DataFrame, at: str) -> DataFrame:
    """``(turn, speaker, line, prev_speaker, prev_line)`` of ``(at, speaker, line)``: one sequence by ``at``, dealt over ranges of it."""
    before = lambda window: {f"prev_{c}": F.lag(c).over(window) for c in ("speaker", "line")}
    return in_order(rows, [at], before, before=1).select(F.col("number").cast("int").alias("turn"), "speaker", "line", "prev_speaker", "prev_line")


ARTICLE = "name string, jutsu_name string, classification array<string>, jutsu_type string, description string, jutsu_description string"


def articles(spark: SparkSession, path: str, fallback: str | None = None, labels: list[str] = fixed.LABEL_PRIORITY) -> DataFrame:
    """``(name, classes, label, description, text)`` of JSON lines in the rich or the flat form, each name once."""
    for source in (path, fallback):
        if source and _exists(spark, source):
            break
    else:
        raise FileNotFoundError(f"no articles at {path}")
    rows = spark.read.schema(ARTICLE).json(source).withColumn("at", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()))
    return label_articles(rows.select("at", F.coalesce("name", "jutsu_name").alias("name"), "classification", "jutsu_type", F.coalesce("description", "jutsu_description").alias("description")), "at", labels)


def label_articles(rows: DataFrame, order: str, labels: list[str]) -> DataFrame:
    """Labels, clean descriptions of more than 20 characters, and the first of each name by ``order``."""
    classes = X.classes_of(F.col("classification"), F.col("jutsu_type"))
    tidy = rows.select(order, "name", classes.alias("classes"), X.primary_label(classes, labels).alias("label"), X.squeeze(F.coalesce("description", F.lit(""))).alias("description"))
    tidy = tidy.filter(F.col("label").isNotNull() & (F.length("description") > 20))
    return keep_first(tidy, ["name"], [order]).select("name", "classes", "label", "description", F.concat(X.squeeze(F.col("name")), F.lit(". "), "description").alias("text"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table at ``path``, built and written first where it is missing or a refresh is asked for."""
    if refresh or not _exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def resume(spark: SparkSession, path: str, groups: DataFrame, key: str, score: Callable[[DataFrame], DataFrame], batches: int = 1) -> DataFrame:
    """Scores of all groups at ``path``, computing only those whose key is not there yet.

    What is left is dealt by its key into ``batches`` jobs, each written when it is done: a run that is ended
    keeps all jobs before, and the next run goes on from there.
    """
    rest = groups
    if _exists(spark, f"{path}/_SUCCESS"):
        rest = groups.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    for batch in range(batches):
        some = rest.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == batch)
        if not some.isEmpty():
            score(some).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def save_report(report: dict, path: str) -> str:
    """A small report as indented JSON on the driver's file system."""
    with open(path, "w", encoding="utf-8") as file:
        json.dump(report, file, indent=2, ensure_ascii=False)
    return path


def records(df: DataFrame, limit: int = 10_000) -> list[dict]:
    """Rows of a small result as plain dictionaries; an error beyond ``limit``, which bounds what the driver holds."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} records; narrow the query")
    return [row.asDict(recursive=True) for row in rows]


def write_records(df: DataFrame, path: str) -> None:
    """JSON lines, replacing what was there."""
    df.write.mode("overwrite").json(path)


def wiki_pages(responses: DataFrame, body: Column | str = "value") -> DataFrame:
    """``(page_id, title, wikitext)`` of staged API responses; pages without a revision are left out."""
    shape = "query struct<pages: array<struct<pageid: bigint, title: string, revisions: array<struct<slots: struct<main: struct<content: string>>>>>>>"
    pages = responses.select(F.explode(F.from_json(body, shape)["query"]["pages"]).alias("p"))
    return pages.filter(F.size("p.revisions") > 0).select(F.col("p.pageid").alias("page_id"), F.col("p.title").alias("title"), F.col("p.revisions")[0]["slots"]["main"]["content"].alias("wikitext"))


def wiki_listing(responses: DataFrame, body: Column | str = "value", batch: int = 50, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """``(*keys, request, titles)`` of staged category listings: the titles that follow, by requests of ``batch``.

    A response is a row, and its ``keys`` tell it from others; without any, its own hash does.
    """
    shape = "query struct<categorymembers: array<struct<title: string>>>"
    by = keys or ["response"]
    rows = responses if keys else responses.withColumn("response", F.xxhash64(body))
    members = rows.select(*by, F.posexplode(F.from_json(body, shape)["query"]["categorymembers"]).alias("at", "m"))
    grouped = members.groupBy(*by, F.floor(F.col("at") / batch).alias("request")).agg(F.sort_array(F.collect_list(F.struct("at", "m.title"))).alias("x"))
    return grouped.select(*keys, "request", F.array_join(F.transform("x", lambda x: x["title"]), "|").alias("titles"))


def wiki_chain(responses: DataFrame, order: str, limit: int | None = None, body: Column | str = "value") -> DataFrame:
    """``(order, titles, cursor)`` of the staged listings of one category, one row a response.

    Titles beyond ``limit`` in all are left out. The cursor is what the next listing continues from: null after
    the last response, and once the limit is reached. Counts of responses, not their titles, meet in one window.
    """
    shape = "query struct<categorymembers: array<struct<title: string>>>, continue struct<cmcontinue: string>"
    parsed = responses.select(order, F.from_json(body, shape).alias("r"))
    rows = parsed.select(order, F.transform("r.query.categorymembers", lambda m: m["title"]).alias("titles"), F.col("r.continue.cmcontinue").alias("cursor"))
    if limit is None:
        return rows
    counts = rows.select(order, F.size("titles").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a response
    room = counts.select(order, F.greatest(F.lit(limit) - before, F.lit(0)).cast("int").alias("room"))
    return rows.join(room, order).select(order, F.slice("titles", F.lit(1), F.col("room")).alias("titles"), F.when(F.col("room") > F.size("titles"), F.col("cursor")).alias("cursor"))
