import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, minhash_dedup, shingles
from weftline.llm.common import components, without


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_shingles int")


def reference_shingles(text, k=5):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def group_minima(ids, links):
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(least[a], least[b])
            changed |= least[a] != low or least[b] != low
            least[a] = least[b] = low
    return least


def made_texts(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(word() for _ in range(rng.randint(1, 60))))
    return texts


def test_exact_dedup_agrees_with_groups_of_equal_texts(spark):
    texts = ["a", "b", "a", None, "", "c ", "c", "b", "a", "x" * 300_000, "x" * 300_000]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    for counters in (1, 2, 2048):
        out = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, rows), counters=counters).collect()}
        assert len(out) == len(rows)
        for i, text in enumerate(texts):
            same = [j for j, t in enumerate(texts) if (t or "") == (text or "")]
            assert (out[i]["keep_id"], out[i]["group_size"], out[i]["kept"]) == (max(same), len(same), i == max(same))
            assert out[i]["text_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_exact_dedup_of_nulls_repeats_and_nothing(spark):
    rows = [(1, "a", "", 0), (1, "a", "", 0), (None, "a", "", 0), (None, "b", "", 0)]
    out = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["group_size"], r["kept"]) for r in out).count((1, 3, True)) == 1
    assert sum(r["kept"] for r in out) == 2
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_misra_gries_keeps_frequent_values():
    rng = random.Random(2)
    values = [b"hot"] * 400 + [b"warm"] * 200 + [str(rng.random()).encode() for _ in range(600)]
    rng.shuffle(values)
    counts, lacking, total = exact_dedup.summarise(values, 9)
    assert total == 1200 and {b"hot", b"warm"} <= set(counts)
    assert all(counts[v] <= values.count(v) <= counts[v] + lacking for v in (b"hot", b"warm"))


def test_frequent_candidates_hold_every_heavy_digest(spark):
    values = [(b"%d" % (i % 3),) for i in range(900)] + [(b"x%d" % i,) for i in range(300)]
    random.Random(1).shuffle(values)
    found = {bytes(r[0]) for r in exact_dedup.frequent_candidates(spark.createDataFrame(values, "digest binary").repartition(7), 16).collect()}
    assert {b"0", b"1", b"2"} <= found and len(found) <= 16


def test_shingles_match_sets_of_words():
    texts = [*made_texts(3, 40), "", "  \t", None, "One", "A b C", "a\x0bb\x0cc d e f", "a　b c", "ÀB ab", "w " * 5000]
    got = list(shingles.shingle_sets([t and t.encode() for t in texts]))
    assert [len(x) for x in got] == [len(reference_shingles(t)) for t in texts]
    for i in range(0, 40, 3):
        a, b = reference_shingles(texts[i]), reference_shingles(texts[i + 1])
        assert len(np.intersect1d(got[i], got[i + 1])) == len(a & b)


@pytest.mark.parametrize(("seed", "leaf"), [(5, 2048), (6, 8)])
def test_near_duplicates_agree_with_all_pairs(spark, seed, leaf):
    texts = [*made_texts(seed), None, "", "one two", "one two", "ONE two"]
    sets = [reference_shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    least = group_minima(range(len(texts)), links)
    out = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs(spark, [(i, t, "", 0) for i, t in enumerate(texts)]), leaf=leaf).collect()}
    assert {i: r["component_id"] for i, r in out.items()} == least
    assert all(out[i]["n_shingles"] == len(sets[i]) and out[i]["kept"] == (least[i] == i) for i in out)


def test_near_duplicates_of_null_ids_repeated_ids_and_nothing(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(7, long, "", 0), (3, "other words that are long enough here", "", 0), (3, long, "", 0), (None, long, "", 0), (9, "other words that are long enough here", "", 0)]
    out = minhash_dedup.near_duplicates(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in out) == [(-1, -1), (3, 3), (3, 3), (7, 3), (9, 3)]
    assert minhash_dedup.near_duplicates(docs(spark, [])).count() == 0


def test_pairs_at_the_threshold_are_found_in_crowds(spark):
    rows = [(i, text, "", 0) for i, text in at_threshold(200)]
    out = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs(spark, rows), words=1, leaf=4).collect()}
    missed = [pair for pair in range(200) if out[2 * pair + 1] != 2 * pair]
    assert not missed and all(out[2 * pair] == 2 * pair for pair in range(200))


def test_trees_follow_the_deepest_branching():
    wanted = [minhash_dedup.trees_for(0.75, n) for n in range(10)]
    assert wanted == sorted(wanted) and wanted[0] <= 8 < wanted[1] and 30 < wanted[9] < 80
    assert 0.75 * (1 + minhash_dedup.twice(0.75)) >= 1  # a pair at the threshold does not die out


def at_threshold(n):
    """Pairs with 60 of 80 words in common, 50 of which are in all texts: 60 / 80 in a pair, 50 / 90 in others."""
    crowd = [f"all{i}" for i in range(50)]
    return [(2 * k + own, " ".join([*crowd, *(f"p{k}x{i}" for i in range(10)), *(f"o{k}x{own}x{i}" for i in range(10))])) for k in range(n) for own in (0, 1)]


@pytest.mark.parametrize("depth", [1, 3, 6])
def test_recall_of_trees_by_depth(spark, depth):
    n = 150
    rows = spark.createDataFrame(at_threshold(n), "doc_id long, text string")
    described = minhash_dedup.describe(rows, 1).select(F.col("doc_id").alias("class"), F.col("doc_id").alias("rep"), "minwise").cache()
    trees = minhash_dedup.trees_for(0.75, depth - 1)
    nodes, branchings, _ = minhash_dedup.leaves(described, range(trees), 2, depth)
    met = {(a, b) for r in nodes.groupBy("node").agg(F.sort_array(F.collect_set("rep")).alias("x")).collect() for a in r["x"] if a % 2 == 0 for b in r["x"] if b == a + 1}
    print(f"depth {depth}: {branchings} branchings, {trees} trees, recall {len(met) / n:.3f}")
    assert branchings == depth - 1 and len(met) >= 0.95 * n


@pytest.mark.parametrize(("nodes", "ids"), [(0, 0), (30, 0), (100_000, 1_000_000)])
def test_what_is_not_broadcast_gives_the_same(spark, monkeypatch, nodes, ids):
    monkeypatch.setattr(minhash_dedup, "BROADCAST_NODES", nodes)
    monkeypatch.setattr(minhash_dedup, "BROADCAST_IDS", ids)
    texts = made_texts(8)
    sets = [reference_shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    out = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs(spark, [(i, t, "", 0) for i, t in enumerate(texts)]), leaf=8).collect()}
    assert out == group_minima(range(len(texts)), links)


@pytest.mark.parametrize("at_once", [0, 1000])
def test_components_both_ways(spark, at_once):
    rng = random.Random(at_once)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (200, 201), (200, 201)]
    least = group_minima({x for e in edges for x in e}, edges)
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame(edges, "a long, b long"), at_once=at_once).collect()}
    assert got == {i: least[i] for a, b in edges if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long"), at_once=at_once).count() == 0


def test_without_matches_nulls_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, key_0 string")
    gone = spark.createDataFrame([(1,), (None,), (None,)], "x long")
    assert [r["doc_id"] for r in without(rows, gone, [F.col("doc_id")]).collect()] == [2]
    assert sorted(r["key_0"] for r in without(rows, gone, [F.col("doc_id")], "left_semi").collect()) == ["a", "c"]


@pytest.mark.parametrize("leaf", [2048, 2])
def test_each_text_of_a_repeated_id_links_it(spark, leaf):
    text = lambda k, last: " ".join([*(f"t{k}w{i}" for i in range(60)), last])
    rows = [(k, text((k, side), "same"), "", 0) for k in range(20) for side in (0, 1)]
    rows += [(100 + 2 * k + side, text((k, side), "other"), "", 0) for k in range(20) for side in (0, 1)]
    out = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs(spark, rows), leaf=leaf).collect()}
    assert out == {**{k: k for k in range(20)}, **{100 + 2 * k + side: k for k in range(20) for side in (0, 1)}}
