import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.config import Characters, Settings
from weftline.operators import classify, graph, memory, mentions, network, themes
from weftline.plans import api

NAMES = "episode int, arc string, line_idx int, character string, start double"


def test_chunks_close_before_the_budget(spark):
    rows = [(1, i, " ".join(["w"] * n)) for i, n in enumerate([3, 4, 9, 0, 2, 12, 1])] + [(2, 0, "a")]
    out = [(r["episode"], r["chunk_id"], r["first_line"], r["n_lines"], r["tokens"]) for r in themes.chunks(spark.createDataFrame(rows, "episode int, line_idx int, text string"), 10).orderBy("episode", "chunk_id").collect()]
    assert out == [(1, 0, 0, 2, 7), (1, 1, 2, 2, 9), (1, 2, 4, 1, 2), (1, 3, 5, 1, 12), (1, 4, 6, 1, 1), (2, 0, 0, 1, 1)]


def test_theme_tables(spark):
    assert themes.label_ids({"not_entailment": 1, "Entailment": 0}) == (0, 1) and themes.label_ids({"entailment": 2, "neutral": 1, "contradiction": 0}) == (2, 0)
    episodes = spark.createDataFrame([(1, "a", "x", 1.0), (2, "a", "x", 3.0), (3, "b", "x", 2.0), (1, "a", "y", 0.5), (2, "a", "y", 0.5), (3, "b", "y", 0.5)], "episode int, arc string, theme string, score double")
    assert {(r["theme"], r["score"], r["relative"]) for r in themes.profile(episodes).collect()} == {("x", 2.0, 1.0), ("y", 0.5, 0.25)}
    assert {(r["arc"], r["theme"]): r["lift"] for r in themes.lift(episodes).collect()} == {("a", "x"): 1.0, ("b", "x"): 1.0, ("a", "y"): 1.0, ("b", "y"): 1.0}
    assert [r["rolling"] for r in themes.rolling(episodes.filter("theme = 'x'"), 3).orderBy("episode").collect()] == [2.0, 2.0, 2.5]
    chunked = spark.createDataFrame([(1, "friends of mine"), (2, "x")], "episode int, text string")
    model = lambda: lambda texts, labels: [[len(t) / 100 for _ in labels] for t in texts]
    assert {(r["episode"], r["theme"], r["score"]) for r in themes.score_with_model(chunked, ["p", "q"], model).collect()} == {(1, "p", 0.15), (1, "q", 0.15), (2, "p", 0.01), (2, "q", 0.01)}


@pytest.mark.parametrize(("surface", "name"), [("Sasuke-kun", "Sasuke"), ("Lady Tsunade", "Tsunade"), ("Naruto's", "Naruto"), ("SAKURA", "Sakura"), ("Sakur--", "Sakura"), ("Gennai", "Gennai"), ("GENNAI", "Gennai"), ("the", None), ("Uchiha", None), ("hey", None), ("Naruto Uzumaki-kun", "Naruto"), ("Transform", None), ("Pervy Sage", "Jiraiya")])
def test_surfaces(spark, surface, name):
    common = spark.createDataFrame([("transform", 4.0), ("gennai", 1.0)], "word string, zipf double")
    assert mentions.resolve(spark.createDataFrame([(surface,)], "surface string"), spark, frequencies=common).first()["character"] == name


def test_mentions_count_once_a_line(spark):
    lines = spark.createDataFrame([(1, 0, "Sasuke and Sasuke Uchiha met Guy, that guy."), (1, 1, "Might Guy! Gennai said."), (1, 2, "nobody")], "episode int, line_idx int, text string")
    found = mentions.extract(lines, spark, mentions.capitalised)
    assert sorted((r["line_idx"], r["character"], r["surface"], r["source"]) for r in found.collect()) == [(0, "Guy", "Guy", "gazetteer"), (0, "Sasuke", "Sasuke", "gazetteer"), (1, "Gennai", "Gennai", "model"), (1, "Guy", "Might Guy", "gazetteer")]


def test_edges_decay_within_the_window_and_the_episode(spark):
    rows = [(1, "a", 10, "A", 0.0), (1, "a", 11, "B", 0.0), (1, "a", 14, "A", 0.0), (1, "a", 30, "C", 0.0), (2, "b", 11, "C", 0.0), (1, "a", 30, "B", 0.0)]
    table = spark.createDataFrame(rows, NAMES)
    out = {(r["source"], r["target"]): (r["weight"], r["cooccurrences"], r["episodes"]) for r in network.edges(table).collect()}
    assert set(out) == {("A", "B"), ("B", "C")} and out["A", "B"][1:] == (2, 1) and out["B", "C"] == (1.0, 1, 1)
    assert math.isclose(out["A", "B"][0], math.exp(-1 / 4) + math.exp(-3 / 4))
    assert network.network(table, min_mentions=3).count() == 0
    assert {r["arc"] for r in network.arc_networks(spark.createDataFrame(rows * 3, NAMES)).collect()} == {"a"}


def test_edges_agree_with_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(e), "a", int(line), str(c), 0.0) for e, line, c in zip(rng.integers(0, 3, 300), rng.integers(0, 90, 300), rng.choice(list("ABCDE"), 300))]
    want = {}
    for i, (e, _, x, a, _) in enumerate(rows):
        for f, _, y, b, _ in rows[:i]:
            if e == f and a != b and abs(x - y) <= 10:
                w, n, s = want.get((min(a, b), max(a, b)), (0, 0, frozenset()))
                want[min(a, b), max(a, b)] = (w + math.exp(-abs(x - y) / 4), n + 1, s | {e})
    out = {(r["source"], r["target"]): r for r in network.edges(spark.createDataFrame(rows, NAMES)).collect()}
    assert set(out) == set(want)
    assert all(math.isclose(out[k]["weight"], w) and (out[k]["cooccurrences"], out[k]["episodes"]) == (n, len(s)) for k, (w, n, s) in want.items())


LINKS = [("a", "b", 2.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 0.5), ("d", "e", 3.0), ("e", "f", 2.0), ("d", "f", 2.0), ("x", "y", 1.0)]


@pytest.fixture(scope="module")
def links(spark):
    return spark.createDataFrame(LINKS, "source string, target string, weight double")


def test_ranks_and_components(spark, links):
    names = sorted({n for a, b, _ in LINKS for n in (a, b)})
    matrix = np.zeros((len(names), len(names)))
    for a, b, w in LINKS:
        matrix[names.index(a), names.index(b)] = matrix[names.index(b), names.index(a)] = w
    r = np.full(len(names), 1 / len(names))
    for _ in range(2000):
        r = 0.15 / len(names) + 0.85 * (matrix / matrix.sum(axis=0)) @ r
    out = {x["character"]: x["pagerank"] for x in graph.pagerank(links).collect()}
    assert np.allclose([out[n] for n in names], r) and math.isclose(sum(out.values()), 1.0)
    v = np.ones(len(names))
    for _ in range(2000):
        v = (matrix + np.eye(len(names))) @ v
        v /= np.linalg.norm(v)
    out = {x["character"]: x["eigenvector"] for x in graph.eigenvector(links).collect()}
    assert np.allclose([out[n] for n in names], v)
    assert {x["character"]: x["component"] for x in graph.components(links).collect()} == {n: "x" if n in "xy" else "a" for n in names}
    assert sorted(x["character"] for x in graph.largest_component(links).collect()) == list("abcdef")
    assert {x["character"]: (x["degree"], x["strength"]) for x in network.degrees(links).collect()}["d"] == (3, 5.5)


def test_betweenness_and_communities(spark, links):
    out = {x["character"]: x["betweenness"] for x in graph.betweenness(links).collect()}
    assert math.isclose(out["c"], 2 * 2 * 3 / (7 * 6)) and math.isclose(out["d"], 2 * 3 * 2 / (7 * 6)) and out["x"] == 0
    assert {x["character"]: x["community"] for x in graph.louvain(links).collect()} == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": 1, "x": 2, "y": 2}
    assert graph.louvain_labels([("b", "a", 1.0)]) == {"a": 0, "b": 0}
    mentioned = spark.createDataFrame([(c,) for c in "aaabbcdefxy"], "character string")
    table = graph.metrics(links, mentioned)
    assert set(table.columns) == {"character", "mentions", "degree", "strength", "pagerank", "betweenness", "eigenvector", "community"} and table.count() == 8
    styled = {r["character"]: r for r in network.node_styles(table).collect()}
    assert max(r["size"] for r in styled.values()) == 50 and styled["a"]["colour"] == "#3987e5"
    assert "</script>" in network.page(links, table) and [r["character"] for r in network.leaders(table).filter("community = 2").orderBy("place").collect()] == ["x", "y"]
    assert [(r["character"], r["weight"]) for r in network.ties(network.edge_styles(links).withColumn("episodes", F.lit(1)), "d", 2).collect()] == [("e", 3.0), ("f", 2.0)]


def test_splits_weights_and_reports(spark):
    rows = spark.createDataFrame([(i, "a" if i < 160 else "b" if i < 190 else "c") for i in range(200)], "id int, label string")
    split = classify.stratified_split(rows, "id", "label").collect()
    assert {(label, s): sum(r["label"] == label and r["split"] == s for r in split) for label in "abc" for s in ("test", "val", "train")} == {("a", "test"): 24, ("a", "val"): 24, ("a", "train"): 112, ("b", "test"): 5, ("b", "val"): 5, ("b", "train"): 20, ("c", "test"): 2, ("c", "val"): 2, ("c", "train"): 6}
    folds = classify.folds(rows, "id", "label").collect()
    assert all(abs(sum(r["label"] == label and r["fold"] == k for r in folds) - n / 5) < 1 for k in range(5) for label, n in (("a", 160), ("b", 30), ("c", 10)))
    counts = spark.createDataFrame([(x,) for x, n in (("N", 1452), ("T", 282), ("G", 54)) for _ in range(n)], "label string")
    assert {r["label"]: round(r["weight"], 2) for r in classify.class_weights(counts, "label").collect()} == {"N": 0.41, "T": 2.11, "G": 11.04}
    done = classify.report(spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y_true string, y_pred string"), ["a", "b"])
    assert done["accuracy"] == 0.6667 and done["confusion_matrix"]["matrix"] == [[1, 1], [0, 1]] and done["per_class"]["a"] == {"precision": 1.0, "recall": 0.5, "f1-score": 0.6667, "support": 2.0}


def test_classifiers_and_cross_validation(spark):
    texts = [(i, "good" if i % 2 else "bad", ("bright sunny day of joy " if i % 2 else "dark rainy night of woe ") + f"number {i % 7}") for i in range(60)]
    rows = spark.createDataFrame(texts, "id int, label string, text string")
    model = classify.tfidf_logistic(rows.filter("id < 40"), "label", features=512)
    out = classify.predict(model, rows.filter("id >= 40")).collect()
    assert all(r["y_pred"] == r["label"] and math.isclose(sum(r["probabilities"].values()), 1.0, abs_tol=1e-6) for r in out)
    vectors = spark.createDataFrame([(i, "p" if i % 3 else "q", [float(i % 3 > 0), 1.0, i / 60]) for i in range(60)], "id int, label string, embedding array<double>")

    def fit(train):
        fitted = classify.embedding_logistic(train, "label")
        return lambda rest: classify.predict(fitted, rest, "embedding")

    scores = classify.cross_validate(vectors, "id", "label", {"one": fit, "none": lambda train: lambda rest: rest.withColumn("y_pred", F.lit("p"))}, k=3)
    assert {r["model"]: r["mean"] for r in classify.fold_summary(scores).collect()}["one"] == 1.0
    assert classify.paired(scores, "one", "none").first()["folds_won"] == 3


def test_memories(spark):
    lines = spark.createDataFrame([(1, "a", i, f"l{i}") for i in range(12)] + [(2, "b", 0, "only")], "episode int, arc string, line_idx int, text string")
    assert [(r["episode"], r["first"], r["text"].split()[0], len(r["text"].split())) for r in memory.scenes(lines).orderBy("episode", "first").collect()] == [(1, 0, "l0", 8), (1, 4, "l4", 8), (2, 0, "only", 1)]
    cards = [memory.Card("Nora", "Nora N", signature=r"\bbelieve it\b"), memory.Card("Ida", "Ida I")]
    said = spark.createDataFrame([(1, 0, "Why?"), (1, 1, "Because, Believe it!"), (1, 2, "Because, Believe it!")], "episode int, line_idx int, text string")
    spoken = spark.createDataFrame([(0, "Nora", "one two three four", None), (1, "Ida", "too short", "x"), (2, "Nora", "Because, Believe it!", "who?")], "turn int, speaker string, line string, prev_line string")
    voices = memory.voice(said, spoken, cards)
    assert sorted(tuple(r) for r in voices.collect()) == [("Nora", "", "one two three four", "transcript"), ("Nora", "Why?", "Because, Believe it!", "subtitle-signature")]
    records = memory.training_records(voices, cards[0]).collect()
    assert [[m["role"] for m in r["prompt"]] for r in records] == [["system", "user"]] and records[0]["completion"][0]["content"] == "Because, Believe it!"
    with pytest.raises(ValueError):
        memory.training_records(voices, cards[1])


def letters(texts):
    out = np.array([[t.lower().count(chr(97 + k)) for k in range(26)] for t in texts], dtype=float)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def test_prompts(spark, tmp_path):
    rows = [("Nora", "aaa", "bbb", "t"), ("Nora", "", "aab", "t"), ("Nora", "ccc", "zzz", "t"), ("Ida", "q", "aaa", "t")]
    voices = memory.embed(spark.createDataFrame(rows, "character string, context string, line string, source string"), F.concat_ws(" ", "context", "line"), letters)
    scenes = memory.embed(spark.createDataFrame([(3, "arc", 0, "Nora said aaa"), (4, "arc", 0, "zzz zzz")], "episode int, arc string, first int, text string"), F.col("text"), letters)
    service = api.Service(spark, Settings(root=str(tmp_path)), [memory.Card("Nora", "Nora N"), memory.Card("Ida", "Ida I")])
    messages, found = service.prepare("Nora", "aaa", [{"role": "user", "content": "a"}, {"role": "tool", "content": "x"}], voices, scenes, letters)
    assert found["voice"][:2] == ["aab", "bbb"] and found["scenes"][0] == "(Episode 3, arc) Nora said aaa"
    assert [(m["role"], m["content"]) for m in messages[1:]] == [("user", "aaa"), ("assistant", "bbb"), ("user", "a"), ("user", "aaa")] and "zzz" in messages[0]["content"]
    with pytest.raises(api.Invalid):
        service.prepare("Zed", "a", [], voices, scenes, letters)
    assert list(service.chat({"voice": []}, iter(["a", "ab", "a", "abc"]))) == [("context", {"voice": []}), ("delta", "a"), ("delta", "b"), ("delta", "c"), ("done", {})]
    history = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in (("user", "u1"), ("assistant", "a1"), ("user", "u2"))])
    assert spark.range(1).select(memory.query_text(history, F.lit("new"))).first()[0] == "u2 new"
    assert [m["content"] for m in spark.range(1).select(memory.recent(history, 1)).first()[0]] == ["a1", "u2"]


def test_verdicts(spark):
    scores = lambda *arms: spark.createDataFrame(list(arms), "arm string, distinctiveness double, relevance double, words double, catchphrase_rate double")
    good = memory.verdict(scores(("base", 0.1, 0.4, 18.0, 0.0), ("lora", 0.2, 0.38, 12.0, 0.2))).first()
    parrot = memory.verdict(scores(("base", 0.1, 0.4, 18.0, 0.0), ("lora", 0.3, 0.2, 4.0, 0.9))).first()
    assert good["recommend"] and not parrot["recommend"] and parrot["more_distinctive"] and not parrot["not_parroting"]


def test_service(spark, tmp_path):
    settings = Settings(root=str(tmp_path), characters=Characters(min_mentions=2))
    service = api.Service(spark, settings)
    with pytest.raises(api.Missing):
        service.characters()
    rows = [(1, "Prologue", k, name, 0.0) for k in range(0, 40, 4) for name in ("A", "B", "Hokage")] + [(6, "Land of Waves", k, name, 0.0) for k in range(3) for name in ("C", "D")]
    spark.createDataFrame(rows, NAMES).write.parquet(settings.out("characters", "mentions.parquet"))
    out = service.characters()
    assert [(x["source"], x["target"]) for x in out["links"]] == [("A", "B")] and {r["character"] for r in out["ranking"]} == {"A", "B", "C", "D"}
    assert service.ties("C", "Land of Waves")[0]["character"] == "D"
    for bad in (lambda: service.characters("nowhere"), lambda: service.characters(top_edges=5), lambda: service.ties("C", k=99), lambda: service.score_themes(None, [" "])):
        with pytest.raises(api.Invalid):
            bad()
    with pytest.raises(api.Missing):
        service.ties("Z")
    lines = spark.createDataFrame([(1, "Prologue", 0, "friends and friendship"), (2, "Prologue", 0, "war")], "episode int, arc string, line_idx int, text string")
    assert service.score_themes(lines, ["friendship"], 1, 5)["profile"][0]["theme"] == "friendship"
    assert isinstance(service.personas(), list) and pd.DataFrame(service.personas()).shape[0] == len(memory.CARDS)


def test_blocks_of_queries_find_what_a_broadcast_finds(spark, monkeypatch):
    monkeypatch.setattr(memory, "ROWS_AT_ONCE", 40)
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((90, 8)).round(1)
    vectors[30:60] = vectors[0]  # ties, in order of their keys
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(90, None)], "line long, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors[::3])], "query_id long, query array<double>")
    boost = F.when(F.col("line") % 7 == 0, 0.5).otherwise(0.0)
    for k in (4, 100):
        found = [sorted((r["query_id"], r["place"], r["line"], r["similarity"]) for r in search(rows.filter("embedding is not null"), asked, k, ["line"], boost).collect()) for search in (memory.nearest, memory.nearest_of_many)]
        assert found[0] == found[1] and len(found[0]) == 30 * min(k, 90)


def test_every_term_of_enough_texts_is_a_feature(spark):
    words = [f"w{i:05d}" for i in range(70_000)]
    rows = [(str(i % 2), " ".join(words[i % 100 :: 100])) for i in range(200)]  # each word in two texts
    model = classify.tfidf_logistic(spark.createDataFrame(rows, "label string, text string").repartition(4), "label")
    found = [set(stage.vocabulary) for stage in model.stages if hasattr(stage, "vocabulary")]
    assert set(words) <= found[0]
    grams = {}
    for i, (_, text) in enumerate(rows):
        for word in text.split():
            for n in (3, 4, 5):
                for at in range(len(word) + 3 - n):
                    grams.setdefault(f" {word} "[at : at + n], set()).add(i)
    assert found[1] == {gram for gram, texts in grams.items() if len(texts) >= 3}


def test_pairs_are_shuffled_once_in_as_many_tasks_as_mentions_ask_for(spark):
    rows = [(e, "a", (i * 7) % 30, f"N{(i * i + e) % 9}", 0.0) for e in range(4) for i in range(25)]
    few = network.edges(spark.createDataFrame(rows, NAMES))
    many = network.edges(spark.createDataFrame(rows, NAMES), at_once=5)
    key = lambda r: (r["source"], r["target"], round(r["weight"], 9), r["cooccurrences"], r["episodes"])
    assert sorted(map(key, few.collect())) == sorted(map(key, many.collect())) and few.count() > 20
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 3 and "Union" not in network.degrees(many)._jdf.queryExecution().optimizedPlan().toString()


def test_louvain_of_a_graph_of_more_links_than_a_task_takes(spark):
    rng = np.random.default_rng(3)
    names = [f"n{i:03d}" for i in range(120)]
    edges = [(names[i], names[j], 3.0 if i % 4 == j % 4 else 1.0) for i in range(120) for j in range(i + 1, 120) if rng.random() < (0.5 if i % 4 == j % 4 else 0.05)]
    links = spark.createDataFrame(edges, "source string, target string, weight double")
    found = {r["character"]: r["community"] for r in graph.louvain(links, at_most=300).collect()}
    assert found == {name: i % 4 for i, name in enumerate(names)}
    keyed = links.withColumn("arc", F.lit("x")).union(spark.createDataFrame([("p", "q", 1.0, "y")], "source string, target string, weight double, arc string"))
    by_arc = {(r["arc"], r["character"]): r["community"] for r in graph.louvain(keyed, ["arc"], at_most=300).collect()}
    assert by_arc == {**{("x", k): v for k, v in found.items()}, ("y", "p"): 0, ("y", "q"): 0}


def test_betweenness_leaves_out_links_that_no_shortest_path_takes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    edges = [(f"n{i:02d}", f"n{j:02d}", float(rng.integers(1, 5)) * (20 if i == 0 else 1)) for i in range(40) for j in range(i + 1, 40) if rng.random() < 0.6]
    edges += [(f"p{i:03d}", f"p{i + 1:03d}", 1.0) for i in range(90)]  # a path longer than the passes, apart from the rest
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    place, around = {x: i for i, x in enumerate(names)}, [[] for _ in names]
    for a, b, w in edges:
        around[place[a]].append((place[b], 1 / w))
        around[place[b]].append((place[a], 1 / w))
    want = sum(graph.shortest_path_shares(around, k) for k in range(len(names))) / (len(names) - 1) / (len(names) - 2)
    links = spark.createDataFrame(edges, "source string, target string, weight double")
    got = {r["character"]: r["betweenness"] for r in graph.betweenness(links).collect()}
    assert np.allclose([got[x] for x in names], want, atol=1e-12)
    assert graph._without_detours(graph._numbered(links)[1], len(names)).count() < len(edges) / 2
    numbered = [(place[a], place[b], 1 / w) for a, b, w in edges if a[0] == "n"]
    both = np.array(sorted([(b, a, x) for a, b, x in numbered] + numbered, key=lambda e: e[1]))
    some = graph.shares_at_once(both[:, 0].astype(int), both[:, 1].astype(int), both[:, 2], len(names), np.arange(10))
    assert np.allclose(some, sum(graph.shortest_path_shares(around, k) for k in range(10)), atol=1e-9)


def test_words_of_a_chunk_are_taken_once_for_all_labels(spark):
    chunked = spark.createDataFrame([(1, "The battle, the BATTERY and 7"), (2, "9 8"), (3, None)], "episode int, text string")
    scored = themes.score(chunked, themes.label_table(spark, ["batt", "the", "ands"]))
    assert {(r["episode"], r["theme"]): r["score"] for r in scored.collect()} == {(1, "batt"): 0.4, (1, "the"): 0.4, (1, "ands"): 0.0, **{(e, t): 0.0 for e in (2, 3) for t in ("batt", "the", "ands")}}
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.index("Join") < plan.index("split(")


def test_mentions_of_one_character_do_not_meet_in_one_task(spark, monkeypatch):
    rows = [(e, "a", i, "Hot" if i % 2 else f"N{e}", 0.0) for e in range(20) for i in range(40)]
    tasks, plain = [], network.cut

    def counted(df):
        if "block" in df.columns:  # mentions as they are combined
            tasks.append(df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return plain(df)

    monkeypatch.setattr(network, "cut", counted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for more characters than Spark sends of itself
    try:
        found = network.edges(network.frequent(spark.createDataFrame(rows, NAMES), 8), at_once=20)
        assert found.count() == 20 and tasks[0] < 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_counts_of_shortest_paths_follow_the_edges_of_shortest_paths_alone(monkeypatch):
    rng = np.random.default_rng(5)
    n, numbers = 300, []
    pairs = {(0, k): 2.0 for k in range(1, n)} | {tuple(sorted(map(int, rng.choice(np.arange(1, n), 2, replace=False)))): float(rng.integers(1, 8)) for _ in range(20_000)}
    both = np.array(sorted([(a, b, x) for (a, b), x in pairs.items()] + [(b, a, x) for (a, b), x in pairs.items()], key=lambda e: e[1]))
    start, end, length = both[:, 0].astype(int), both[:, 1].astype(int), both[:, 2]
    sources, plain = np.arange(7, 27), np.bincount
    monkeypatch.setattr(graph, "EDGES", 500)
    monkeypatch.setattr(np, "bincount", lambda x, *rest: numbers.append(len(x)) or plain(x, *rest))
    found = graph.shares_at_once(start, end, length, n, sources)
    monkeypatch.undo()
    around = [[] for _ in range(n)]
    for a, b, x in both.tolist():
        around[int(a)].append((int(b), x))
    assert np.allclose(found, sum(graph.shortest_path_shares(around, int(k)) for k in sources), atol=1e-9)
    assert numbers and max(numbers) < len(both) * len(sources) / 2  # not each edge for each source
