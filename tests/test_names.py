"""The field of names against sums over all labellings, and what it finds."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import mentions, names


def random_field(rng):
    return names.Field(rng.normal(size=(names.BUCKETS, names.LABELS)), rng.normal(size=(names.LABELS, names.LABELS)), rng.normal(size=names.LABELS))


def score(field, scores, labels):
    return field.start[labels[0]] + sum(scores[t, x] for t, x in enumerate(labels)) + sum(field.step[a, b] for a, b in zip(labels, labels[1:]))


def test_passes_equal_all_labellings_of_short_lines():
    rng = np.random.default_rng(4)
    field = random_field(rng)
    sizes = np.array([1, 5, 3, 4])
    flat = rng.normal(size=(sizes.sum(), names.LABELS))
    scores = names.padded(sizes.tolist(), flat, 0.0)
    total, words, steps = names.marginals(field, scores, sizes)
    best = names.viterbi(field, scores, sizes)
    expected = np.zeros((names.LABELS, names.LABELS))
    for k, n in enumerate(sizes):
        every = list(itertools.product(range(names.LABELS), repeat=int(n)))
        values = np.array([score(field, scores[:, k], labels) for labels in every])
        assert np.isclose(total[k], np.log(np.exp(values).sum()))
        assert tuple(best[:n, k]) == every[int(values.argmax())]
        weight = np.exp(values - total[k])
        for t in range(n):
            assert np.allclose(words[t, k], [weight[[x[t] == label for x in every]].sum() for label in range(names.LABELS)])
        for w, labels in zip(weight, every):
            for a, b in zip(labels, labels[1:]):
                expected[a, b] += w
        assert (words[n:, k] == 0).all()
    assert np.allclose(steps, expected)


def test_fitting_follows_the_gradient_of_what_is_allowed():
    # with one word a line and one feature set apart, fitting must separate the labels that are allowed
    lines = [["Anna", "went"], ["went", "Anna"], ["the", "house"], ["Bert", "went"]]
    may = [np.ones((2, 3), bool) for _ in lines]
    for k, line in enumerate(lines):
        for t, word in enumerate(line):
            may[k][t] = [False, True, False] if word == "Anna" else [True, True, True] if word == "Bert" else [True, False, False]
    field = names.fit(lines, may, rounds=40, batch=2)
    assert names.names_in(field, ["Anna went", "the house", "", None, "went"]) == [[(0, "Anna")], [], [], [], []]
    assert names.names_in(field, ["Bert went"])[0] == [(0, "Bert")]  # by shape and neighbour


CAST = ["Amira Voss", "Amira", "Tollen", "Keshet", "Branwick", "Ilva Dorn", "Sorrel"]
OTHERS = ["Mertin", "Halvard", "Quenby", "Ostara"]


def made(seed, n, people):
    rng = random.Random(seed)
    verbs, rest = ["said", "went", "asked", "saw", "left"], ["the house was old", "it rained", "nobody knew why", "they waited there"]
    lines, truth = [], []
    for _ in range(n):
        who = rng.choice(people)
        form = rng.randrange(5)
        line = [f"{who} {rng.choice(verbs)} that {rng.choice(rest)}.", f"Then {who} {rng.choice(verbs)} quietly.", f"We met {who} near the river.", f"{rng.choice(rest).capitalize()}.", f"Where is {who}?"][form]
        lines.append(line)
        truth.append(who if form != 3 else None)
    return lines, truth


@pytest.fixture(scope="module")
def fitted(spark):
    lines, _ = made(1, 600, CAST + OTHERS)
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)] + [(2, 0, None), (2, 1, "")], "episode int, line_idx int, text string")
    return names.fit_on(rows, [(c, c) for c in CAST])


def test_held_out_lines_and_names_outside_the_cast(fitted):
    for people, least in ((CAST, 0.97), (OTHERS, 0.9), (["Wendril", "Pasko"], 0.8)):
        lines, truth = made(7, 300, people)
        found = names.names_in(fitted, lines)
        hits = sum(t is not None and t in [name for _, name in own] for own, t in zip(found, truth))
        f1 = 2 * hits / (sum(map(len, found)) + sum(t is not None for t in truth))
        assert f1 >= least, (people, f1)


def test_long_lines_and_company_change_nothing(fitted, monkeypatch):
    lines = made(9, 40, CAST)[0] + ["Then Tollen left. " * 20_000]
    whole = names.names_in(fitted, lines)
    assert len(whole[-1]) == 20_000
    monkeypatch.setattr(names, "WORDS", 50)
    assert names.names_in(fitted, lines) == whole == [names.names_in(fitted, [t])[0] for t in lines]


def test_model_in_the_extraction(spark, fitted):
    lines = spark.createDataFrame([(1, 0, "Then Quenby asked quietly."), (1, 1, "Where is Amira Voss?"), (1, 2, "It rained."), (1, 3, None), (1, 4, "We met Sleep near the river.")], "episode int, line_idx int, text string")
    cast = [(c, c.split()[0]) for c in CAST]
    common = spark.createDataFrame([("sleep", 5.0), ("quenby", 1.0)], "word string, zipf double")
    out = mentions.extract(lines, spark, names.model(fitted), cast, common)
    assert sorted((r["line_idx"], r["character"], r["source"]) for r in out.collect()) == [(0, "Quenby", "model"), (1, "Amira", "gazetteer")]
    share = names.agreement(out, mentions.extract(lines, spark, aliases=cast)).first()
    assert (share["precision"], share["recall"], share["f1"]) == (1, 1, 1)
    assert names.model(fitted)(lines.limit(0)).count() == 0


def test_build_from_subtitle_files(spark, tmp_path):
    from weftline.config import Settings
    from weftline.plans import api

    settings = Settings(root=str(tmp_path))
    folder = tmp_path / settings.paths.subtitles_dir
    folder.mkdir(parents=True)
    for episode in (1, 2):
        said = [f"Then {who} {verb} quietly." for who in ("Naruto", "Sasuke", "Sakura", "Wendril") for verb in ("went", "sleeps", "asked")] + ["Quietly she sleeps."]
        blocks = [f"{i}\n00:00:{i:02},000 --> 00:00:{i:02},900\n{text}" for i, text in enumerate(said, 1)]
        (folder / f"Season 1 - {episode:02}.srt").write_text("\n\n".join(blocks))
    made = api.build(spark, settings)
    assert made["dialogue"].count() == 26 and made["chunks"].select("theme").distinct().count() == len(settings.themes.labels)
    found = {(r["character"], r["source"]) for r in made["mentions"].collect()}
    assert {("Naruto", "gazetteer"), ("Sasuke", "gazetteer"), ("Sakura", "gazetteer"), ("Wendril", "model")} <= found and not any(c in ("Quietly", "Then") for c, _ in found)
    assert api.build(spark, settings)["mentions"].count() == made["mentions"].count()


def test_a_model_reads_each_line_once(spark):
    read = spark.sparkContext.accumulator(0)

    def model(lines):
        def seen(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        rows = lines.mapInArrow(seen, lines.schema)
        return rows.withColumns({"at": F.lit(0), "surface": F.regexp_extract("text", r"([A-Z]\w+)", 1)})

    lines = spark.createDataFrame([(i, 0, f"then Zorander{chr(97 + i)} went") for i in range(12)], "episode long, line_idx long, text string")
    common = spark.createDataFrame([("then", 6.0)], "word string, zipf double")
    assert mentions.extract(lines, spark, model, [("Anna", "Anna")], common).count() == 12 and read.value == 12


def test_words_split_over_all_texts_are_those_of_the_pattern():
    rng = random.Random(4)
    texts = ["", *("".join(rng.choice("aAé1٣中²\U0001f600\U00010400-'’_ \n.,") for _ in range(rng.randint(0, 30))) for _ in range(3000)), "-", "a'"]
    distinct, numbers, counts = names.split_words(texts)
    assert [[distinct[w] for w in own] for own in np.split(numbers, np.cumsum(counts)[:-1])] == [names._WORD.findall(t) for t in texts]
    assert len(distinct) == len(set(distinct)) and names.split_words([""])[0] == []
    field = names.Field(np.random.default_rng(2).normal(size=(names.BUCKETS, names.LABELS)), np.zeros((3, 3)), np.zeros(3))
    own = [names._WORD.findall(t) for t in texts]
    plain = field.node[names.Features().lines([w for w in own if w])].sum(axis=1)
    for most in (200_000, 1):
        assert np.array_equal(names.Scores(field, most).lines(distinct, numbers, counts), plain)
