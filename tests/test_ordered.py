"""Folds and windows along an order, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import dialogue, graph, memory, ordered, themes
from weftline.sources import files


@pytest.mark.parametrize(("parts", "before", "after"), [(1, 2, 0), (5, 0, 3), (7, 4, 4), (40, 2, 1)])
def test_windows_over_ranges_are_those_over_the_whole_order(spark, parts, before, after):
    rng = random.Random(parts)
    values = [(rng.random(), rng.randint(0, 9)) for _ in range(97)]
    rows = spark.createDataFrame(values, "at double, x long").repartition(3)
    out = ordered.in_order(rows, ["at"], lambda w: {"s": F.sum("x").over(w.rowsBetween(-before, after)), "lag": F.lag("x").over(w)}, max(before, 1), after, parts=parts)
    xs = [x for _, x in sorted(values)]
    assert out.columns == ["at", "x", "number", "s", "lag"]
    assert [(r["number"], r["x"], r["s"], r["lag"]) for r in out.orderBy("number").collect()] == [(i, x, sum(xs[max(0, i - before) : i + after + 1]), xs[i - 1] if i else None) for i, x in enumerate(xs)]
    assert ordered.in_order(rows.limit(0), ["at"], lambda w: {"lag": F.lag("x").over(w)}, 1).count() == 0


def test_rolling_means_by_theme(spark):
    rows = [(e, t, float((e * 7 + len(t)) % 11)) for t in ("one", "three") for e in range(60)]
    out = {(r["theme"], r["episode"]): r["rolling"] for r in themes.rolling(spark.createDataFrame(rows, "episode int, theme string, score double")).collect()}
    for t in ("one", "three"):
        own = [s for e, u, s in rows if u == t]
        assert all(abs(out[t, e] - sum(own[max(0, e - 4) : e + 5]) / len(own[max(0, e - 4) : e + 5])) < 1e-12 for e in range(60)) and len(out) == 120


def test_turns_of_one_long_transcript(spark):
    rows = spark.range(20_000).select(F.col("id").alias("at"), F.concat(F.lit("s"), F.col("id") % 3).alias("speaker"), F.col("id").cast("string").alias("line")).repartition(6)
    out = files.transcript_turns(rows, "at")
    assert out.filter("turn <> cast(line as int) or (turn > 0 and prev_line <> cast(turn - 1 as string)) or (turn = 0 and prev_line is not null)").count() == 0 and out.count() == 20_000


def plain_chunks(sizes, budget):
    out = []
    for n in sizes:
        if not out or sum(out[-1]) + n > budget:
            out.append([])
        out[-1].append(n)
    return out


def test_chunks_equal_a_plain_loop(spark):
    rng = random.Random(2)
    groups = {k: [rng.choice((0, 0, 1, 3, 8, 30)) for _ in range(rng.randint(1, 60))] for k in (*range(9), None)}
    rows = [(k, i, " ".join("w" * n)) for k, sizes in groups.items() for i, n in enumerate(sizes)] + [(3, 1000, None)]
    rng.shuffle(rows)
    out = themes.chunks(spark.createDataFrame(rows, "episode int, line_idx int, text string"), 10).collect()
    for k, sizes in groups.items():
        own = sorted((r["chunk_id"], r["n_lines"], r["tokens"]) for r in out if r["episode"] == k)
        assert own == [(i, len(c), sum(c)) for i, c in enumerate(plain_chunks(sizes, 10))]
    assert themes.chunks(spark.createDataFrame([], "episode int, line_idx int, text string"), 10).count() == 0


def test_one_document_of_a_million_lines(spark):
    lines = spark.range(1_000_000).select(F.lit(7).alias("episode"), F.lit("a").alias("arc"), F.col("id").cast("int").alias("line_idx"), F.when(F.col("id") % 10 == 0, "one two three").otherwise("one").alias("text"))
    packed = themes.chunks(lines, 12)
    r = packed.agg(F.count("*").alias("n"), F.sum("n_lines").alias("lines"), F.max("tokens").alias("most"), F.max("chunk_id").alias("last")).first()
    assert (r["lines"], r["most"], r["last"]) == (1_000_000, 12, r["n"] - 1) and r["n"] == 100_000
    assert memory.scenes(lines).agg(F.count("*").alias("n"), F.max("first").alias("last")).first() == (249_999, 999_992)


def test_scripts_and_scenes_keep_their_order(spark):
    rows = spark.createDataFrame([("a", k, f"l{k}" if k != 3 else None) for k in reversed(range(15))] + [("b", 0, "only"), ("c", 0, None)], "key string, at int, text string").repartition(4)
    assert {r["key"]: r["script"] for r in dialogue.scripts(rows, ["key"], "at").collect()} == {"a": " ".join(f"l{k}" for k in range(15) if k != 3), "b": "only"}
    assert sorted(map(tuple, memory.scenes(rows, ["key"], "at").collect())) == [("a", 0, " ".join(f"l{k}" for k in range(8) if k != 3)), ("a", 4, " ".join(f"l{k}" for k in range(4, 12))), ("b", 0, "only"), ("c", 0, "")]


def test_ranks_are_the_same_whether_values_are_sent_or_joined(spark):
    rng = random.Random(8)
    links = spark.createDataFrame([(f"n{a:02}", f"n{b:02}", rng.random() + 0.1) for a in range(25) for b in range(a + 1, 25) if rng.random() < 0.3] + [("x", "y", 2.0)], "source string, target string, weight double")
    for run, column in ((graph.pagerank, "pagerank"), (graph.eigenvector, "eigenvector")):
        sent, joined = ({r["character"]: r[column] for r in run(links, at_once=n).collect()} for n in (100, 0))
        assert sent.keys() == joined.keys() and all(abs(sent[k] - joined[k]) < 1e-8 for k in sent)
        assert run(links.limit(0)).count() == 0


def test_components_in_place_and_by_shuffles_agree_and_links_stay(spark):
    rng = np.random.default_rng(4)
    pairs = {tuple(sorted((f"v{a:03d}", f"v{b:03d}"))) for a, b in rng.integers(0, 300, (220, 2)) if a != b} | {(f"w{k:02d}", f"w{k + 1:02d}") for k in range(60)}
    links = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "source string, target string, weight double").repartition(7)
    found = lambda rows: {(r["character"], r["component"]) for r in rows.collect()}
    assert found(graph.components(links)) == found(graph.components(links, at_once=0))
    with graph._Links(links) as held:
        plain = np.zeros((held.n, held.n))
        place = {x: k for k, x in enumerate(held.names.to_pylist())}
        for a, b in pairs:
            plain[place[a], place[b]] = plain[place[b], place[a]] = 1.0
        x = rng.random(held.n)
        assert np.allclose(held.sums(x), plain @ x)


def test_an_embedder_gets_pieces_of_bounded_length(spark):
    rows = spark.createDataFrame([(k, "x" * (1 + 997 * k % 5000)) for k in range(600)] + [(600, "y" * (memory.LETTERS + 5)), (601, None)], "k int, text string").coalesce(1)
    met = memory.embed(rows, F.col("text"), lambda texts: np.full((len(texts), 1), texts.str.len().fillna(0).sum())).select("k", F.col("embedding")[0].alias("n")).toPandas().set_index("k")["n"]
    assert len(met) == 602 and met.drop(600).max() <= memory.LETTERS < met[600] and met.nunique() > 3


def test_texts_are_not_copied_to_the_blocks_of_a_search(spark):
    rng = random.Random(6)
    rows = spark.createDataFrame([(f"line {k % 37:02d}", f"said {k}", [float(rng.randrange(3)) for _ in range(4)]) for k in range(200)], "line string, context string, embedding array<double>")
    asks = spark.createDataFrame([(q, [float(rng.randrange(3)) for _ in range(4)]) for q in range(30)], "query_id int, query array<double>")
    got, want = (find(rows, asks, 5, ["line", "context"]) for find in (memory.nearest_of_many, memory.nearest))
    own = lambda found: {(r["query_id"], r["place"], r["line"], r["context"], r["similarity"]) for r in found.collect()}
    assert own(got) == own(want) and set(got.columns) == {"query_id", "place", "line", "context", "similarity"}
    moved = next(x for x in got._jdf.queryExecution().analyzed().toString().splitlines() if "CoGroup" in x)
    assert "__number" in moved and "context" not in moved
