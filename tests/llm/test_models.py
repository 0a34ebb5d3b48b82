import random

import numpy as np
import pytest

from weftline.llm import labels, quality, toxicity


def made(seed, n, bad=("stupid", "moron", "loweist")):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7)))
    texts, marks = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 300))]
        if i % 2:
            for _ in range(1 + len(words) // 60):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(("", ",", "."))
        texts.append(" ".join(words))
        marks.append(i % 2)
    return texts, marks


def area(scores, marks):
    order = np.argsort(np.argsort(scores)) + 1
    marks = np.array(marks)
    return (order[marks == 1].sum() - marks.sum() * (marks.sum() + 1) / 2) / marks.sum() / (len(marks) - marks.sum())


def test_gradients_are_those_of_the_loss():
    net = toxicity.fit(*made(1, 24), rounds=1)
    words = toxicity.read_words([t.encode() for t in made(2, 6)[0]])
    at, _ = toxicity.windows(words, blank := len(words.hashes))
    at, y, weights = at[:, :6], np.array([0, 1, 0, 1, 1, 0.0]), np.ones(6)
    x = net.inputs(words)[0].astype(np.float64)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        z = net.forward(x @ net.p["w"] + net.p["b"], at, blank)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    got, _ = net.gradients(x, at, blank, y, weights)
    rng = np.random.default_rng(0)
    for name, gradient in got.items():
        place, step = tuple(rng.integers(0, s) for s in gradient.shape), 1e-3
        before = net.p[name][place]
        net.p[name][place] = before + step
        high = loss()
        net.p[name][place] = before - step
        low = loss()
        net.p[name][place] = before
        assert abs((high - low) / 2 / step - gradient[place]) < 1e-5, name


def test_windows_cover_every_word_and_overlap():
    texts = [b"", b"a", b" ".join(b"w%d" % i for i in range(64)), b" ".join(b"w%d" % i for i in range(65)), b" ".join(b"w%d" % i for i in range(1000))]
    words = toxicity.read_words(texts)
    at, text = toxicity.windows(words, blank := len(words.hashes))
    assert np.bincount(text).tolist() == [1, 1, 1, 2, 21]
    for k in range(len(texts)):
        own = words.positions[words.texts[k] : words.texts[k + 1]]
        assert set(at[:, text == k].ravel()) - {blank} == set(own)


def test_toxicity_learns_words_and_scores_every_text(spark):
    net = toxicity.fit(*made(3, 300))
    texts, marks = made(4, 200)
    assert area(net.scores([t.encode() for t in texts]), marks) > 0.97
    edges = [None, "", "!!!", "hello " * 20000, texts[1]]
    rows = spark.createDataFrame([(i, t, 9.0) for i, t in enumerate(edges)], "doc_id long, text string, score double")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(rows, net).collect()}
    assert len(out) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    assert out[0]["score"] == out[1]["score"] == out[2]["score"]
    kept = toxicity.score_toxicity(rows, net, keep_columns=True)
    assert kept.columns == ["doc_id", "text", "score", "_score", "predicted"] and {r["score"] for r in kept.collect()} == {9.0}
    assert toxicity.score_toxicity(rows.limit(0), net).count() == 0


def test_quality_votes_by_neighbours(spark):
    rng = random.Random(6)
    good = [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(10, 200))) + "." for _ in range(300)]
    junk = [rng.choice((lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | "), lambda t: " ".join(w for w in t.split() for _ in range(6)), lambda t: t.replace(" ", "*** ")))(t) for t in good[150:]]
    model = quality.fit(good[:100] + junk[:100], [1] * 100 + [0] * 100)
    scores = model.scores([t.encode() for t in good[100:150] + junk[100:]])
    assert area(scores, [1] * 50 + [0] * 50) > 0.97
    rows = spark.createDataFrame([(0, None, 1), (1, "", 1), (2, good[0], 1), (3, "x" * 200_000, 1)], "doc_id long, text string, predicted int")
    out = {r["doc_id"]: r for r in quality.score_quality(rows, model).collect()}
    assert out[0]["score"] == out[1]["score"] == 0 and out[2]["predicted"] == 1 and len(out) == 4
    assert quality.score_quality(rows.limit(0), model).count() == 0


def test_axes_span_what_a_dense_decomposition_spans():
    rng = np.random.default_rng(3)
    dense = rng.random((60, 200)) * (rng.random((60, 200)) < 0.2) + np.outer(rng.random(60), rng.random(200)) * 3
    of, column = np.nonzero(dense)
    axes = quality._axes(of, column, dense[of, column], 60, 200, 8)
    _, values, right = np.linalg.svd(dense)
    assert np.allclose(axes.T @ axes, np.eye(8), atol=1e-6)
    assert np.allclose(np.linalg.norm(dense @ axes, axis=0), values[:8], rtol=2e-2) and abs(axes[:, 0] @ right[0]) > 1 - 1e-9


def test_cosines_are_exact():
    texts, marks = made(8, 60)
    model = quality.fit(texts, marks)
    probe = [t.encode() for t in made(9, 20)[0]]
    projected = np.zeros((len(probe), model.axes.shape[1]))
    for text, column, value in zip(*model.weighted(probe)):
        projected[text] += value * model.axes[column]
    projected /= np.linalg.norm(projected, axis=1, keepdims=True)
    for row, score in zip(projected, model.scores(probe)):
        cosine = np.array([row @ v for v in model.vectors])
        near = np.flatnonzero(np.round(cosine, 9) >= np.sort(np.round(cosine, 9))[-quality.NEIGHBOURS])
        weight = np.maximum(cosine[near], 0) ** 8 + 1e-9
        assert abs(score - (weight * model.labels[near]).sum() / weight.sum()) < 1e-9


def test_ties_of_quality_all_vote_and_words_tell():
    # 20 copies of a text, of which the sample holds both labels: whichever is looked at first, all vote
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(4))
    texts, marks = [], []
    for k in range(200):
        texts.append(" ".join(word("abcd" if k % 2 else "wxyz") if rng.random() < 0.5 else rng.choice(("goods", "plain") if k % 2 else ("spams", "offer")) for _ in range(60)))
        marks.append(k % 2)
    model = quality.fit(texts[:100] + ["same text of all"] * 20, marks[:100] + [1] * 5 + [0] * 15)
    scores = model.scores([t.encode() for t in texts[100:]])
    assert area(scores, marks[100:]) > 0.97  # alike in how they are written
    assert abs(model.scores([b"same text of all"])[0] - 0.25) < 0.01


def test_network_agrees_with_a_plain_one():
    # gated recurrent units, attention and pooling, one window and one step after the other
    net = toxicity.fit(*made(1, 24), rounds=1)
    words = toxicity.read_words([t.encode() for t in made(5, 3)[0]])
    at, _ = toxicity.windows(words, blank := len(words.hashes))
    x, p, h = net.inputs(words)[0].astype(float), {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    got = net.forward((net.inputs(words)[0] @ net.p["w"] + net.p["b"]), at, blank)
    for n in range(at.shape[1]):
        states = np.zeros((len(at), 2 * h))
        for way, order in ((0, range(len(at))), (1, range(len(at) - 1, -1, -1))):
            state = np.zeros(h)
            for t in order:
                a = (x[at[t, n]] @ p["w"] + p["b"])[way * 3 * h : (way + 1) * 3 * h]
                b = state @ p["u"][way]
                z, r = sigmoid(a[:h] + b[:h]), sigmoid(a[h : 2 * h] + b[h : 2 * h])
                new = np.tanh(a[2 * h :] + r * (b[2 * h :] + p["c"][way]))
                state = (1 - z) * new + z * state
                states[t, way * h : (way + 1) * h] = state
        real = [t for t in range(len(at)) if at[t, n] != blank]
        score = np.array([np.tanh(states[t] @ p["att"] + p["att_b"]) @ p["att_v"] for t in real])
        weight = np.exp(score) / np.exp(score).sum()
        assert abs(sum(w * states[t] for w, t in zip(weight, real)) @ p["out"] + p["out_b"][0] - got[n]) < 1e-3


def test_null_and_repeated_ids_are_scored(spark):
    texts, marks = made(7, 60)
    rows = spark.createDataFrame([(None, texts[0]), (None, None), (4, texts[1]), (4, texts[1]), (4, texts[2])], "doc_id long, text string")
    for score, model in ((toxicity.score_toxicity, toxicity.fit(texts, marks, rounds=2)), (quality.score_quality, quality.fit(texts, marks))):
        out = score(rows, model).collect()
        assert len(out) == 5 and sum(r["doc_id"] is None for r in out) == 2
        assert len({r["score"] for r in out if r["doc_id"] == 4}) <= 2


def test_windows_score_as_the_matrices_say():
    net = toxicity.fit(*made(1, 24), rounds=1)
    words = toxicity.read_words([t.encode() for t in made(5, 30)[0]] + [b""])
    at, _ = toxicity.windows(words, blank := len(words.hashes))
    assert np.allclose(net.logits(net.projected(words), at, blank), net.forward(net.inputs(words)[0] @ net.p["w"] + net.p["b"], at, blank), atol=1e-4)


@pytest.fixture(scope="module")
def fitted():
    texts, marks = made(7, 120)
    return toxicity.fit(texts, marks, rounds=2), quality.fit(texts, marks)


def test_scores_hang_on_the_text_alone(fitted):
    probe = [t.encode() for t in made(12, 256)[0]] + [b"", b"!!", b"a " * 9000, b"x" * 20_000]
    for model in fitted:
        alone = np.concatenate([model.scores([t]) for t in probe])
        for size in (2, 7, 256):
            for turn in (0, 1, 3):
                moved = probe[turn:] + probe[:turn]
                got = np.concatenate([model.scores(moved[k : k + size]) for k in range(0, len(moved), size)])
                assert np.roll(got, turn).tobytes() == alone.tobytes(), (type(model), size)


@pytest.mark.parametrize("size", [700, 3000])
def test_long_texts_score_in_blocks_as_in_one_piece(fitted, monkeypatch, size):
    rng = random.Random(size)
    words = made(13, 40)[0]
    probe = [rng.choice((" ", "\n", "  ", ", ")).join(words[:k]).encode() for k in (4, 9, 17, 30)] + [b"stupid " * 3000, b". " * 5000 + b"stupid", b"word " * 2000 + b"stupid moron " * 8]
    for module, model in zip((toxicity, quality), fitted):
        whole = model.scores(probe)
        monkeypatch.setattr(module, "BYTES", size)
        assert np.concatenate([model.scores([t]) for t in probe]).tobytes() == whole.tobytes()


def test_stretches_have_the_windows_of_the_text(monkeypatch):
    monkeypatch.setattr(toxicity, "BYTES", 500)
    monkeypatch.setattr(toxicity, "LONGEST_WORD", 90)
    rng = random.Random(4)
    for n in [*range(0, 400, 7), 3000]:
        text = b" ".join(bytes(rng.choice(b"abc") for _ in range(rng.choice((1, 5, 9, 200)))) for _ in range(n))
        parts = list(toxicity.stretches(text))
        seen = []
        for piece in ([text], parts):
            rows = []
            for part in piece:
                words = toxicity.read_words([part])
                at, _ = toxicity.windows(words, len(words.hashes))
                rows += [tuple(np.append(words.hashes, 0)[at[:, k]]) for k in range(at.shape[1])]
            seen.append(rows)
        assert seen[0] == seen[1], n


@pytest.mark.parametrize("k", [0, 1])
def test_a_text_of_many_megabytes_needs_little_memory(fitted, k):
    import tracemalloc

    text = (" ".join(made(14, 40)[0]) + "\n").encode() * 700
    assert len(text) > 20_000_000
    tracemalloc.start()
    score = fitted[k].scores([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 <= score[0] <= 1 and most < 150e6


def test_samples_leave_out_what_is_held_out(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i != 3 else None) for i in range(400)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 3 == 0 and 1 or 0) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r["h"] for r in docs.select("doc_id", labels.held_out(docs["doc_id"], 5, 0).alias("h")).collect()}
    import zlib

    assert out == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(400)}
    texts, y = labels.labelled_sample(docs, marks, "toxic", 5, 0, 30, 100)
    assert sorted(y) == [0] * 30 + [1] * 30
    for text, mark in zip(texts, y):
        i = int(text.split()[1]) if text else 3
        assert not out[i] and mark == (i % 3 == 0)
    assert labels.labelled_sample(docs, marks.limit(0), "toxic", 5, 0, 30, 100) == ([], [])


def test_repeated_rows_give_the_same_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i % 7 else "long " * 50) for i in range(300)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    once = labels.labelled_sample(docs, marks, "toxic", 5, 0, 5, 100)
    assert sorted(once[1]) == [0] * 5 + [1] * 5 and len(set(once[0])) == 10
    for times in (2, 3):
        again, more = docs, marks
        for _ in range(times - 1):
            again, more = again.union(docs), more.union(marks)
        assert labels.labelled_sample(again, more, "toxic", 5, 0, 5, 100) == once
    assert labels.labelled_sample(again, marks, "toxic", 5, 0, 5, 100) == once


def test_a_label_without_fitting_texts_at_first_is_looked_for_further(spark):
    # of label 1 only every fiftieth id has a text short enough
    docs = spark.createDataFrame([(i, f"text {i}" if i % 2 == 0 or i % 100 == 1 else "long " * 50) for i in range(1000)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    texts, y = labels.labelled_sample(docs, marks, "toxic", 5, 0, 6, 100)
    assert y.count(0) == 6 and y.count(1) == 6 and all(int(t.split()[1]) % 100 == 1 for t, m in zip(texts, y) if m)


def test_models_without_two_labels_are_constants(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert toxicity.fit([], []) == quality.fit([], []) == 0.5 and toxicity.fit(["a"], [1]) == 1.0
    assert [r["score"] for r in toxicity.score_toxicity(rows, 0.5).collect()] == [0.5, 0.5]
    assert [r["predicted"] for r in quality.score_quality(rows, 0.5).collect()] == [0, 0]
