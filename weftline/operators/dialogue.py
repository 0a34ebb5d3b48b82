"""Line-level tables: repeated boilerplate, arcs, scripts, previous lines."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline import fixed
from weftline.functions import text as X
from weftline.operators.ordered import fold


def arc_table(spark: SparkSession, arcs: list[tuple[int, int, str]] = fixed.ARCS) -> DataFrame:
    return spark.createDataFrame(arcs, "first long, last long, arc string")


def with_arc(rows: DataFrame, arcs: list[tuple[int, int, str]] = fixed.ARCS, key: str = "episode") -> DataFrame:
    """The arc whose range holds ``key``, "Unknown" beyond all; of overlapping ranges the first."""
    out = F.lit(fixed.UNKNOWN_ARC)
    for first, last, name in reversed(arcs):  # a handful of literal ranges needs no join at all
        out = F.when(F.col(key).between(first, last), F.lit(name)).otherwise(out)
    return rows.withColumn("arc", out)


def with_arc_join(rows: DataFrame, arcs: DataFrame, key: str = "episode") -> DataFrame:
    """The same for a table of disjoint ranges (first, last, arc) that is small enough to broadcast."""
    joined = rows.join(F.broadcast(arcs), F.col(key).between(F.col("first"), F.col("last")), "left")
    return joined.select(*rows.columns, F.coalesce("arc", F.lit(fixed.UNKNOWN_ARC)).alias("arc"))


def flag_repeated(lines: DataFrame, min_episodes: int = 5, window_s: float = 150.0) -> DataFrame:
    """``is_song``: lines whose normal form occurs in many episodes, near an episode's beginning or end, of three words or more.

    The spread is a two-step aggregate (distinct pairs, then counts), both combined before the shuffle; only
    forms that spread far enough come back, so the join's other side is small, and a form that all episodes
    share is one row of it. Lines too short to be looked up, many of which have one form, are dealt over all
    tasks by a key that no form can have.
    """
    norm = X.lyric_norm(F.col("text"))
    rows = lines.withColumn("__norm", norm)
    wide = rows.filter(X.spaces(F.col("__norm")) >= 2).select("__norm", "episode").distinct().groupBy("__norm").count().filter(F.col("count") >= min_episodes).select("__norm", F.lit(True).alias("__wide"))
    ends = rows.groupBy("episode").agg(F.max("end").alias("__duration"))
    inside = (F.col("start") <= window_s) | (F.col("start") >= F.col("__duration") - window_s)
    asked = F.when(X.spaces(F.col("__norm")) >= 2, F.col("__norm")).otherwise(F.concat(F.lit("#"), F.xxhash64("episode", "start").cast("string")))
    flagged = rows.withColumn("__norm", asked).join(ends, "episode").join(wide, "__norm", "left").withColumn("is_song", F.coalesce("__wide", F.lit(False)) & F.coalesce(inside, F.lit(False)))
    return flagged.select(*lines.columns, "is_song")


def dialogue(lines: DataFrame, min_episodes: int = 5, window_s: float = 150.0, drop_songs: bool = True) -> DataFrame:
    """Flagged lines with arcs; without songs, line numbers keep their gaps."""
    rows = with_arc(flag_repeated(lines, min_episodes, window_s))
    return rows.filter("not is_song") if drop_songs else rows


class _Script:
    def __init__(self) -> None:
        self.parts: list[str] = []

    def take(self, at: object, text: str) -> tuple:
        self.parts.append(text)
        return ()

    def end(self) -> Iterator[tuple]:
        yield (" ".join(self.parts),)


def scripts(lines: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """One text per group: its lines in order, joined by a space. A group is an episode, a document, a conversation."""
    return fold(lines.filter(F.col(text).isNotNull()).select(*keys, order, text), keys, [order], _Script, "script string")


def with_previous(lines: DataFrame, keys: list[str], order: str, columns: dict[str, str], empty: str | None = None) -> DataFrame:
    """Columns of the row before, in each group; ``empty`` instead of null where it is given."""
    before = Window.partitionBy(*keys).orderBy(order)
    lagged = {new: F.lag(old).over(before) for old, new in columns.items()}
    return lines.withColumns({new: F.coalesce(c, F.lit(empty)) if empty is not None else c for new, c in lagged.items()})


def keep_first(rows: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, which must be total for the result to be fixed.

    Each task keeps the first row of its own, so of a key's rows one a task is shuffled at most.
    """
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__first")
    return rows.groupBy(*keys).agg(first).select("__first.*")


def document_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", timed: bool = False) -> DataFrame:
    """``(episode, line_idx, text)``: lines of documents; ``timed`` adds start and end, in characters before and with them.

    Lines leave the row that holds their document without a shuffle. Times are running sums along a document, so
    they sort its lines; what follows by episode finds them partitioned.
    """
    lines = docs.select(F.col(key).alias("episode"), F.posexplode(F.split(F.col(text), "\n")).alias("line_idx", "text"))
    if not timed:
        return lines
    before = Window.partitionBy("episode").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)).cast("double")
    return lines.withColumn("start", start).withColumn("end", F.col("start") + F.length("text"))
