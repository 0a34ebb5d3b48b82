"""Weighted co-occurrence networks of mentions, and their tables."""

from __future__ import annotations

import html
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline import fixed
from weftline.session import cut


#: Mentions whose pairs meet in one task; the number of tasks follows from the count, and so a task's memory does not grow.
MENTIONS_A_TASK = 20_000
#: Characters whose numbers are held by the driver and sent to every task at most (checked); pairs of more carry names.
NAMES_AT_ONCE = 1_000_000


def frequent(mentions: DataFrame, least: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Mentions of the characters that have at least ``least`` of them (in each group of ``keys``); they are computed once.

    Mentions stay where they are and the characters are sent to them: by its name, a character whose mentions grow with
    the corpus would come whole to one task.
    """
    mentions = cut(mentions)
    enough = cut(mentions.groupBy(*keys, "character").count().filter(F.col("count") >= least).select(*keys, "character"))
    return mentions.join(F.broadcast(enough) if enough.count() <= NAMES_AT_ONCE else enough, [*keys, "character"], "left_semi")


def edges(mentions: DataFrame, window: int = 10, tau: float = 4.0, keys: list[str] = [], at_once: int = MENTIONS_A_TASK) -> DataFrame:  # noqa: B006
    """``(*keys, source, target, weight, cooccurrences, episodes)`` of characters within ``window`` lines of an episode.

    A pair at distance d adds exp(-d / tau). The band join runs on (episode, block of window + 1 lines): each
    mention meets its own block and the next, so an episode of any length is many small groups. Lines and
    characters are combined first, in tasks by the count of mentions, dealt by their lines. Pairs are shuffled once, by both names (as numbers), with their distance; what an episode
    and what all episodes add is summed where they arrive.
    """
    width = window + 1
    dealt = mentions.repartition(max(1, -(-mentions.count() // at_once)), *keys, "episode", "line_idx")
    rows = cut(dealt.groupBy(*keys, "episode", "line_idx", "character").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("line_idx") / width)))
    names = rows.select("character").distinct()
    few = names.count() <= NAMES_AT_ONCE
    if few:  # in their order, so that the lesser number is the lesser name
        sorted_names = names.orderBy("character").toArrow()["character"]
        numbers = F.broadcast(rows.sparkSession.createDataFrame(pa.table({"character": sorted_names, "number": np.arange(len(sorted_names), dtype=np.int32)})))
        rows = rows.join(numbers, "character").drop("character").withColumnRenamed("number", "character")
    parts = max(1, -(-rows.count() // at_once))
    left = rows.select(*keys, "episode", F.col("line_idx").alias("line_a"), F.col("character").alias("a"), F.col("n").alias("n_a"), F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    right = rows.select(*keys, "episode", F.col("line_idx").alias("line_b"), F.col("character").alias("b"), F.col("n").alias("n_b"), "block")
    near = (F.col("line_b") >= F.col("line_a")) & (F.col("line_b") - F.col("line_a") <= window) & (F.col("a") != F.col("b")) & ((F.col("line_b") > F.col("line_a")) | (F.col("a") < F.col("b")))
    left, right = (side.repartition(parts, *keys, "episode", "block") for side in (left, right))
    pairs = left.join(right, [*keys, "episode", "block"]).filter(near)
    dealt = pairs.select(*keys, F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), "episode", (F.col("line_b") - F.col("line_a")).cast("int").alias("d"), (F.col("n_a") * F.col("n_b")).alias("c")).repartition(parts, *keys, "source", "target")
    by_episode = dealt.groupBy(*keys, "source", "target", "episode").agg(F.sum(F.col("c") * F.exp(-F.col("d") / tau)).alias("w"), F.sum("c").alias("c"))
    done = by_episode.groupBy(*keys, "source", "target").agg(F.sum("w").alias("weight"), F.sum("c").alias("cooccurrences"), F.count("*").alias("episodes"))
    if few:
        for end in ("source", "target"):
            done = done.withColumnRenamed(end, "number").join(numbers.withColumnRenamed("character", end), "number").drop("number")
    return done.select(*keys, "source", "target", "weight", "cooccurrences", "episodes")


def network(mentions: DataFrame, window: int = 10, tau: float = 4.0, min_mentions: int = 8, arc: str | None = None) -> DataFrame:
    """Edges of one network: the arc's mentions if one is named, then frequent characters, then pairs."""
    rows = mentions.filter(F.col("arc") == arc) if arc else mentions
    return edges(frequent(rows, min_mentions), window, tau)


def arc_networks(mentions: DataFrame, window: int = 10, tau: float = 4.0, min_mentions: int = 8) -> DataFrame:
    """Networks of all arcs in one job; an arc needs a third of the mentions, three at least."""
    return edges(frequent(mentions, max(3, min_mentions // 3), ["arc"]), window, tau, ["arc"])


def both_ways(links: DataFrame, *columns: str) -> DataFrame:
    """Every link from both its ends, by one pass."""
    ends = F.array(F.struct(F.col("source").alias("a"), F.col("target").alias("b")), F.struct(F.col("target").alias("a"), F.col("source").alias("b")))
    return links.select(F.explode(ends).alias("__e"), *columns).select("__e.a", "__e.b", *columns)


def degrees(links: DataFrame) -> DataFrame:
    """``(character, degree, strength)`` of every endpoint; isolated characters do not appear."""
    return both_ways(links, "weight").groupBy(F.col("a").alias("character")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def ties(links: DataFrame, character: str, k: int = 8) -> DataFrame:
    """The strongest ties of one character."""
    touching = links.filter((F.col("source") == character) | (F.col("target") == character))
    other = F.when(F.col("source") == character, F.col("target")).otherwise(F.col("source"))
    return touching.select(other.alias("character"), F.bround("weight", 1).alias("weight"), "episodes", F.col("weight").alias("__w")).orderBy(F.desc("__w"), "character").limit(k).drop("__w")


def strongest(links: DataFrame, k: int) -> DataFrame:
    return links.orderBy(F.desc("weight"), "source", "target").limit(k)


def induced(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with both ends among ``nodes(character)``."""
    return links.join(nodes.select(F.col("character").alias("source")), "source", "left_semi").join(nodes.select(F.col("character").alias("target")), "target", "left_semi").select(links.columns)


def leaders(metrics: DataFrame, k: int = 2, by: str = "community") -> DataFrame:
    """The k characters of highest rank in each group, which name it."""
    order = Window.partitionBy(by).orderBy(F.desc("pagerank"), "character")
    return metrics.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(by, "place", "character")


def labelled(metrics: DataFrame, k: int = 22, by: str = "pagerank") -> DataFrame:
    """The k characters whose names a drawing shows; ties by name."""
    return metrics.orderBy(F.desc(by), "character").limit(k)


def node_styles(metrics: DataFrame) -> DataFrame:
    """Size by rank, colour by community; communities from the ninth on share one colour."""
    top = Window.partitionBy(F.lit(1))  # metrics are one row a character
    colours = F.array(*map(F.lit, fixed.COMMUNITY_COLOURS))
    colour = F.when(F.col("community") < len(fixed.COMMUNITY_COLOURS), F.get(colours, F.col("community").cast("int"))).otherwise(fixed.OTHER_COLOUR)
    return metrics.withColumns({"size": 10 + 40 * F.sqrt(F.col("pagerank") / F.max("pagerank").over(top)), "colour": colour})


def edge_styles(links: DataFrame) -> DataFrame:
    top = links.agg(F.max("weight").alias("top"))
    return links.crossJoin(F.broadcast(top)).withColumn("width", 0.5 + 6 * F.pow(F.col("weight") / F.col("top"), 0.6)).drop("top")


def layout(names: list[str], links: list[tuple[str, str, float]], steps: int = 200, seed: int = 7) -> dict[str, tuple[float, float]]:
    """Places in the unit square: ends of links draw together, all others push apart; for what one page shows."""
    rng, n = np.random.default_rng(seed), len(names)
    at, place = rng.random((n, 2)), {name: i for i, name in enumerate(names)}
    pull = np.zeros((n, n))
    for a, b, w in links:
        pull[place[a], place[b]] = pull[place[b], place[a]] = w
    pull /= pull.max(initial=1e-9)
    ideal = 1 / np.sqrt(max(n, 1))
    for step in range(steps):
        apart = at[:, None] - at[None]
        far = np.maximum(np.linalg.norm(apart, axis=2), 1e-3)
        force = (apart * (ideal**2 / far**2 - pull * far / ideal)[..., None]).sum(axis=1)
        length = np.maximum(np.linalg.norm(force, axis=1, keepdims=True), 1e-9)
        at = at + force / length * np.minimum(length, 0.1 * (1 - step / steps))
    low, high = at.min(axis=0, initial=0), at.max(axis=0, initial=1)
    return {name: tuple(((at[i] - low) / np.maximum(high - low, 1e-9)).tolist()) for i, name in enumerate(names)}


def page(links: DataFrame, metrics: DataFrame, top_edges: int = 250, height: str = "720px") -> str:
    """A self-contained HTML page: a drawing of the strongest links and their characters, and its data."""
    shown = edge_styles(strongest(links, top_edges)).collect()  # at most top_edges
    ends = sorted({x for row in shown for x in (row["source"], row["target"])})
    drawn = node_styles(metrics).filter(F.col("character").isin(ends)).orderBy(F.desc("pagerank"), "character")
    nodes = [r.asDict() for r in drawn.select("character", "size", "colour", "mentions", "community").collect()]
    names = {r["character"] for r in labelled(drawn).collect()}
    at = {name: (20 + 960 * x, 20 + 680 * y) for name, (x, y) in layout(ends, [(r["source"], r["target"], r["weight"]) for r in shown]).items()}
    lines = "".join('<line x1="{:.1f}" y1="{:.1f}" x2="{:.1f}" y2="{:.1f}" stroke="#999" stroke-opacity="0.5" stroke-width="{:.2f}"><title>{}</title></line>'.format(*at[r["source"]], *at[r["target"]], r["width"], html.escape(f"{r['source']} - {r['target']}: {r['weight']:.1f}")) for r in shown)
    dots = "".join('<circle cx="{:.1f}" cy="{:.1f}" r="{:.1f}" fill="{}"><title>{}</title></circle>'.format(*at[n["character"]], n["size"] / 3, n["colour"], html.escape(n["character"])) for n in nodes)
    words = "".join('<text x="{:.1f}" y="{:.1f}" font-size="12" text-anchor="middle">{}</text>'.format(*at[n["character"]], html.escape(n["character"])) for n in nodes if n["character"] in names)
    data = json.dumps({"nodes": nodes, "links": [r.asDict() for r in shown]}, ensure_ascii=False).replace("</", "<\\/")
    drawing = f'<svg viewBox="0 0 1000 720" style="width:100%;height:{html.escape(height)}">{lines}{dots}{words}</svg>'
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Network</title></head><body>{drawing}<script type="application/json" id="network">{data}</script></body></html>'
