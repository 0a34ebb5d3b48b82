"""The factorisation against plain numpy, its loss, and what labels find."""

import random

import numpy as np
import pytest

from weftline.operators import topics

TOPICS = {"sea": ["sea", "seafarer", "ship", "sail", "wave"], "law": ["law", "lawyer", "judge", "court", "plea"], "farm": ["farm", "farmer", "corn", "barn", "cow"]}


def made(n=60, seed=2):
    rng = random.Random(seed)
    kinds = [list(TOPICS)[i % 3] for i in range(n)]
    return [(i, i % 4, " ".join(rng.choice(TOPICS[k]) for _ in range(rng.randint(6, 20)))) for i, k in enumerate(kinds)], kinds


@pytest.fixture(scope="module")
def fitted(spark):
    rows, _ = made()
    chunks = spark.createDataFrame([*rows, (900, 0, None), (901, 1, ""), (902, 0, "zzzz")], "chunk_id int, episode int, text string").repartition(3)
    return chunks, topics.factorise(chunks, ["chunk_id", "episode"], list(TOPICS), free=2, rounds=12)


def test_updates_equal_a_plain_version_and_the_loss_falls(fitted):
    _, found = fitted
    rows, _ = made()
    v = np.array([[text.split().count(w) for w in found.words] for _, _, text in rows], dtype=float)
    h, w, losses = topics.seeds(found.words, list(TOPICS), 2), np.ones((len(v), 5)), []
    for _ in range(12):
        w = w * (v @ h.T) / np.maximum(w @ h @ h.T, topics.TINY)
        h = h * (w.T @ v) / np.maximum(w.T @ w @ h, topics.TINY)
        losses.append(((v - w @ h) ** 2).sum())
    assert np.allclose(found.h, h, rtol=1e-6, atol=1e-9) and np.allclose(found.losses, losses, rtol=1e-6)
    assert all(b <= a + 1e-9 for a, b in zip(found.losses, found.losses[1:]))
    got = {r["chunk_id"]: r["w"] for r in found.rows.collect()}
    assert len(got) == 60 and all(np.allclose(got[i], w[i], rtol=1e-6, atol=1e-9) for i in got)


def test_labels_find_their_chunks(fitted):
    chunks, found = fitted
    scores = topics.score(found, chunks, ["chunk_id", "episode"]).toPandas()
    assert len(scores) == 63 * 3 and scores["score"].between(0, 1).all()
    best = scores.loc[scores.groupby("chunk_id")["score"].idxmax()].set_index("chunk_id")["theme"]
    kinds = made()[1]
    assert sum(best[i] == k for i, k in enumerate(kinds)) >= 57
    assert (scores[scores["chunk_id"] >= 900]["score"] == 0).all()


def test_no_chunks(spark):
    none = spark.createDataFrame([], "chunk_id int, text string")
    found = topics.factorise(none, ["chunk_id"], ["sea"], rounds=2)
    assert found.losses == [] and topics.score(found, none, ["chunk_id"]).count() == 0


def test_chunks_are_not_written_in_every_round(spark, monkeypatch):
    times, write = [], topics.written
    monkeypatch.setattr(topics, "written", lambda rows: times.append(1) or write(rows))
    rows = spark.createDataFrame([(k, f"alpha{k % 3} beta{k % 2} gamma") for k in range(12)], "id int, text string")
    found = topics.factorise(rows, ["id"], ["alpha"], rounds=11)
    assert len(times) == 3 and len(found.losses) == 11 and found.rows.count() == 12
    assert all(b <= a + 1e-9 for a, b in zip(found.losses, found.losses[1:]))


def test_sums_are_as_many_as_cores_whatever_the_table_was_dealt_to(spark, monkeypatch):
    parts, write = [], topics.written
    monkeypatch.setattr(topics, "written", lambda rows: parts.append(rows.rdd.getNumPartitions()) or write(rows))
    monkeypatch.setattr(topics, "PLACES", 7)
    rows = [(k, f"alpha{k % 3} beta{k % 2} gamma " + "delta " * (k % 4)) for k in range(60)]
    few, many = (topics.factorise(spark.createDataFrame(rows, "id int, text string").repartition(p), ["id"], ["alpha"], rounds=7) for p in (1, 23))
    assert parts and max(parts) <= spark.sparkContext.defaultParallelism
    assert few.words == many.words and np.allclose(few.h, many.h, rtol=1e-9) and np.allclose(few.losses, many.losses)
