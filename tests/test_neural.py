"""The trained network: gradients over partitions, folds side by side, and what it learns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import classify, neural, training


def made(n, seed=1):
    rng = random.Random(seed)
    topics = {"sea": ["ship", "sail", "wave", "crew"], "law": ["judge", "court", "plea", "jury"], "rare": ["corn", "barn", "cow"]}
    out = []
    for i in range(n):
        label = "rare" if i % 10 == 0 else ("sea", "law")[i % 2]
        out.append((i, label, " ".join(rng.choice(topics[label] if rng.random() < 0.4 else ["the", "and", "of", "was"]) for _ in range(rng.randint(4, 20)))))
    return [*out, (n, "sea", None), (n + 1, "law", "")]


LABELS = ["law", "rare", "sea"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(made(240), "key long, label string, text string")


def ready(rows, roles, buckets=512):
    return neural.featured(rows.withColumn("roles", roles), "label", LABELS, ["key", "roles"], buckets=buckets)


def test_gradient_is_the_same_over_any_partitions_and_that_of_the_loss(rows):
    roles = F.array(*[F.when(F.col("key") % 3 == m, neural.VAL).otherwise(neural.TRAIN) for m in range(2)])
    table = ready(rows, roles, 64)
    models = neural.Models.fresh(2, 3, 64, 4)
    weights = np.array([[1.0, 3.0, 0.5], [2.0, 1.0, 1.0]])
    sums = [neural.total(table.repartition(n, "key"), models, weights) for n in (1, 7)]
    one = table.toPandas().sort_values("key")
    begins = np.concatenate(([0], np.cumsum([len(a) for a in one["at"]])))
    plain = neural.batch_sums(models, one["y"].to_numpy(), np.stack(one["roles"]), weights, np.concatenate(one["at"].tolist()).astype(int), np.concatenate(one["x"].tolist()), begins)
    for got in sums:
        assert np.allclose(got, plain, rtol=1e-4, atol=1e-5)
    flat, size = models.flat(), models.flat().size
    loss = lambda f, m: neural.total(table, models.of(f), weights)[size:].reshape(2, -1)[m, 0]
    rng = np.random.default_rng(0)
    for at in (*rng.integers(0, models.w[0].size, 2), size - 1, size - 4, models.w.size + 1):
        step = np.zeros(size)
        step[at] = 1e-2
        change = sum(loss(flat + step, m) - loss(flat - step, m) for m in range(2)) / 2e-2
        assert abs(change - plain[at]) < 2e-2 + 0.02 * abs(plain[at])


def test_folds_side_by_side_equal_separate_fits(spark, rows):
    done, trained = neural.cross_validate(rows, "key", "label", LABELS, k=3, epochs=2, steps=4, buckets=512)
    table = done.toPandas()
    assert sorted(table["key"]) == list(range(242)) and set(table["fold"]) == {0, 1, 2}
    dealt = classify.nested_folds(rows.select("key", "label"), "key", "label", 3)
    role = F.when(F.col("part") == "train", neural.TRAIN).when(F.col("part") == "val", neural.VAL).otherwise(neural.TEST)
    for fold in range(3):
        own = rows.join(dealt.filter(F.col("fold") == fold).select("key", F.array(role).alias("roles")), "key")
        alone = neural.featured(own, "label", LABELS, ["key", "roles"], buckets=512)
        one = neural.train(alone, 1, 3, 2, 4, 512)
        assert np.allclose(one.best.w[0], trained.best.w[fold], atol=1e-3) and one.best_epoch[0] == trained.best_epoch[fold]
        said = {r["key"]: r["y_pred"] for r in neural.predictions(alone, one.best, ["key"], LABELS).collect()}
        together = {r.key: r.y_pred for r in table[table["fold"] == fold].itertuples()}
        assert said.keys() == together.keys() and sum(said[k] == together[k] for k in said) >= len(said) - 1


def test_fine_tune_with_a_network(spark, rows):
    split = classify.stratified_split(rows, "key", "label")
    done = training.fine_tune(neural.Network("label", LABELS, steps=6, buckets=1024), split, "label", epochs=4)
    assert done["macro_f1"] > 0.9 and done["history"][-1]["loss"] < done["history"][0]["loss"] and done["best_val_macro_f1"] > 0.9


def test_nothing_to_train_on(spark):
    none = spark.createDataFrame([], "key long, label string, text string")
    done, trained = neural.cross_validate(none, "key", "label", LABELS, k=2, epochs=1, steps=1, buckets=64)
    assert done.count() == 0 and trained.best_epoch == [1, 1]
    assert neural.macro_f1(np.array([[1, 1], [0, 1]])) == pytest.approx((2 / 3 + 2 / 3) / 2)


def test_one_product_gives_the_values_of_all_models():
    rng = np.random.default_rng(5)
    texts = ["a b c d", "", "ship sail", None, "b b a"]
    found = [neural.features(t, 64) for t in texts]
    begins, at, x = np.cumsum([0, *(len(a) for a, _ in found)]), np.concatenate([a for a, _ in found]), np.concatenate([v for _, v in found])
    models = neural.Models.fresh(3, 2, 64, 4)
    models = models.of(rng.normal(size=models.flat().size))
    used, full, hidden, p = models.probabilities(at, x, begins)
    for m in range(3):
        for r in range(len(texts)):
            some = slice(begins[r], begins[r + 1])
            own = np.tanh((models.w[m][at[some]] * x[some, None]).sum(axis=0) + models.b[m])
            z = np.exp(own @ models.v[m] + models.c[m])
            assert np.allclose(hidden[m, r], own, atol=1e-5) and np.allclose(p[m, r], z / z.sum(), atol=1e-5)
    assert set(used) == set(at) and full.shape == (5, len(used))


def test_features_of_validation_rows_are_taken_once(spark, rows, monkeypatch):
    taken, plain = [], neural.featured
    monkeypatch.setattr(neural, "featured", lambda *args, **more: taken.append(1) or plain(*args, **more))
    split = classify.stratified_split(rows.limit(60), "key", "label")
    training.fine_tune(neural.Network("label", LABELS, steps=1, buckets=64), split, "label", epochs=2)
    assert len(taken) == 3  # of training, validation and test rows
