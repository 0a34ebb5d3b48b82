import json

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from weftline import runtime
from weftline.config import Settings
from weftline.operators import classify, network, terms, training
from weftline.plans import api
from weftline.sources import crawl, files


class Steps:
    """A trainer whose predictions are right on as many rows as its epoch's share says."""

    def __init__(self, shares):
        self.shares, self.at, self.kept, self.weights = shares, -1, None, None

    def epoch(self, rows, weights):
        self.at, self.weights = self.at + 1, weights
        return 1.0 / (self.at + 1)

    def predict(self, rows):
        return rows.withColumn("y_pred", F.when(F.col("id") % 10 < self.shares[self.at] * 10, F.col("label")).otherwise(F.translate("label", "ab", "ba")))

    def keep(self):
        self.kept = self.at

    def restore(self):
        self.at = self.kept


def test_epochs_stop_and_the_best_one_is_judged(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], ("train", "val", "test")[i // 20]) for i in range(60)], "id int, label string, split string")
    trainer = Steps([0.2, 0.8, 0.5, 0.8, 0.9])
    out = training.fine_tune(trainer, rows, "label", epochs=5)
    assert len(out["history"]) == 4 and out["best_epoch"] == 2 and out["accuracy"] == 0.8 and trainer.weights == {"a": 1.0, "b": 1.0}


def test_a_run_is_cut_after_epochs_without_gain(spark):
    rows = spark.createDataFrame([([1.0, 3.0, 2.0, 3.0, 9.0],), ([1.0, 0.5],), ([],)], "s array<double>")
    found = [r["x"] for r in rows.select(training.early_stop(F.col("s")).alias("x")).collect()]
    assert found == [Row(best_epoch=2, best=3.0, epochs=4), Row(best_epoch=1, best=1.0, epochs=2), Row(best_epoch=0, best=float("-inf"), epochs=0)]


def test_counts_stay_sparse(spark):
    from pyspark.ml.linalg import SparseVector, Vectors

    rows = spark.createDataFrame([(Vectors.sparse(1_000_000, [7, 9], [1.0, 2.0]),)], ["v"])
    out = classify._Damped(inputCol="v", outputCol="w").transform(rows).first()["w"]
    assert isinstance(out, SparseVector) and out.indices.tolist() == [7, 9] and out.values[0] == 1.0 and abs(out.values[1] - 1.6931471805599454) < 1e-15


def test_reports_of_folds():
    done = lambda x: {"macro_f1": x, "accuracy": x, "per_class": {"a": {"f1-score": x, "support": 5.0}}}
    out = classify.cross_report([("m", 0, done(0.5)), ("k", 0, done(0.4)), ("m", 1, done(0.7)), ("k", 1, done(0.8))], pair=("m", "k"))
    assert out["n"] == 10 and out["models"]["m"]["macro_f1"] == {"mean": 0.6, "std": 0.1414}
    assert out["m_minus_k"] == {"mean": 0.0, "std": 0.1414, "folds_won": 1, "per_fold": [0.1, -0.1]}


def test_model_options_and_cache():
    assert runtime.model_options("a-7B", "cpu") == {"dtype": "float32"}
    assert "bits" in runtime.model_options("a-13b-chat", "cuda", True) and "bits" not in runtime.model_options("a-1.5b", "cuda", True)
    assert "bits" not in runtime.model_options("a-8b", "cuda")
    models = runtime.Models(lambda name, options: object())
    assert models.get("x", dtype="a") is models.get("x", dtype="a") and models.get("x") is not models.get("x", dtype="a")


def test_an_own_adapter_answers(tmp_path):
    class Model:
        def stream(self, messages, adapter):
            yield str(adapter and adapter.rsplit("/", 1)[-1])

    (tmp_path / "A").mkdir()
    (tmp_path / "A" / "adapter_config.json").write_text("{}")
    assert list(training.answer(Model(), [], "A", str(tmp_path))) == ["A"] and list(training.answer(Model(), [], "B", str(tmp_path))) == ["None"]


def test_listing_follows_cursors_to_a_limit(tmp_path):
    asked = []

    def fetch(address):
        asked.append(address)
        if "revisions" in address:
            return json.dumps({"query": {"pages": []}})
        first = "cmcontinue" not in address
        return json.dumps({"query": {"categorymembers": [{"title": f"{'a' if first else 'b'}{i}"} for i in range(60)]}, **({"continue": {"cmcontinue": "z"}} if first else {})})

    wiki = crawl.Wiki("http://w", "c", fetch, str(tmp_path))
    assert [len(x) for x in wiki.titles()] == [60, 60] and len(asked) == 2
    assert [len(x) for x in wiki.titles(70)] == [60, 10] and [len(x) for x in wiki.titles(60)] == [60] and len(asked) == 2
    assert len(list(wiki.pages(70))) == 3


def test_a_run_goes_on_where_it_ended(spark, tmp_path):
    path, seen = str(tmp_path / "scores"), []
    rows = spark.range(40).withColumnRenamed("id", "k")

    def score(some):
        seen.extend(r["k"] for r in some.collect())
        if len(seen) > 20 and len(seen) < 40:
            raise RuntimeError("ended")
        return some

    try:
        files.resume(spark, path, rows, "k", score, 4)
    except RuntimeError:
        pass
    kept = {r["k"] for r in spark.read.parquet(path).collect()}
    seen.clear()
    assert 0 < len(kept) < 40 and files.resume(spark, path, rows, "k", lambda some: seen.extend(r["k"] for r in some.collect()) or some, 4).count() == 40
    assert kept.isdisjoint(seen)


def test_a_page_draws_its_links(spark):
    links = spark.createDataFrame([("A", "B", 2.0, 3, 1), ("B", "<C>", 1.0, 1, 1)], "source string, target string, weight double, cooccurrences int, episodes int")
    metrics = spark.createDataFrame([("A", 3, 0.3, 0), ("B", 4, 0.5, 0), ("<C>", 1, 0.2, 1)], "character string, mentions int, pagerank double, community int")
    out = network.page(links, metrics)
    assert out.count("<line") == 2 and out.count("<circle") == 3 and out.count("<text") == 3 and "&lt;C&gt;" in out


def test_overview_and_reports_before_any_stage(spark, tmp_path):
    service = api.Service(spark, Settings(root=str(tmp_path)))
    out = service.overview()
    assert out["lines"] == 0 and out["characters"] == 0 and not any(out["ready"].values())
    (tmp_path / "outputs" / "models").mkdir(parents=True)
    (tmp_path / "outputs" / "models" / "metrics.json").write_text(json.dumps({"data": {"train": 3, "test": 1}}))
    assert service.report() == {"data": {"train": 3, "test": 1}, "crossval": None} and service.overview()["jutsus"] == 4
    assert not any(p["has_adapter"] for p in service.personas())


def test_an_adapter_is_judged_on_records_held_out(spark, tmp_path):
    class Tuned:
        seen = None

        def loss(self, rows):
            self.rest = {r["completion"] for r in rows.collect()}
            return 2.0 if self.seen is None else 1.0

        def fit(self, rows, epochs):
            self.seen = {r["completion"] for r in rows.collect()}

        def save(self, path):
            self.path = path

    tuner = Tuned()
    records = spark.createDataFrame([(f"p{i % 50}", f"c{i % 50}") for i in range(100)], "prompt string, completion string")
    out = training.tune_adapter(tuner, records, "at", share=0.3)
    assert out["examples"] + out["held_out"] == 100 and 0 < out["held_out"] < 60 and (out["loss_before"], out["loss_after"]) == (2.0, 1.0)
    assert tuner.path == "at" and tuner.seen.isdisjoint(tuner.rest)


def test_the_gradient_of_texts_is_summed_in_as_many_parts_as_there_are_cores(spark, monkeypatch):
    parts, made = [], classify._logistic

    class Seen(type(made(1.0, 1.0))):
        def _fit(self, rows):
            parts.append(rows.rdd.getNumPartitions())
            return super()._fit(rows)

    def seen(c, total):
        out = Seen()
        made(c, total)._copyValues(out)
        return out

    monkeypatch.setattr(classify, "_logistic", seen)
    rows = spark.createDataFrame([(f"word{k % 7} and other{k % 5} here", "ab"[k % 2]) for k in range(60)], "text string, label string").repartition(23)
    model = classify.tfidf_logistic(rows, "label", min_words=1, min_chars=1)
    assert parts and max(parts) <= spark.sparkContext.defaultParallelism
    assert {r["y_pred"] for r in classify.predict(model, rows).collect()} <= {"a", "b"}


def test_terms_of_more_than_a_driver_holds_stay_in_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(terms, "BLOCK", 300)
    monkeypatch.setattr(terms, "SHARD", 700)
    monkeypatch.setattr(terms, "PLACES", 40)
    rng = np.random.default_rng(1)
    kinds = {"a": "sea ship sail wave port crew Ärger", "b": "field corn plough barn seed cow", "c": "court judge law trial jury plea x1"}
    made = [(i, "abc"[i % 3], " ".join(rng.choice([*kinds["abc"[i % 3]].split(), "the", "tide", *kinds["abc"[(i + 1) % 3]].split()[:3]], rng.integers(1, 12)))) for i in range(120)]
    rows = spark.createDataFrame([*made, (120, "a", "")], "id int, label string, text string").repartition(5)
    model = classify.tfidf_logistic(rows, "label", at_once=0)
    small = classify.tfidf_logistic(rows, "label")
    assert isinstance(model, terms.TermModel) and not isinstance(small, terms.TermModel)
    held = model.weights.collect()
    found = [{t for r in held if r["kind"] == kind for t in bytes(r["terms"]).decode().split("\n")} for kind in (terms.WORDS, terms.CHARS)]
    assert found == [set(stage.vocabulary) for stage in small.stages if hasattr(stage, "vocabulary")] and len({r["shard"] for r in held}) > 3
    one, other = ({r["id"]: (r["y_pred"], r["probabilities"]) for r in classify.predict(m, rows).collect()} for m in (model, small))
    assert len(one) == 121 and all(one[k][0] == other[k][0] for k in other)
    assert all(abs(one[k][1][x] - other[k][1][x]) < 0.01 and abs(sum(one[k][1].values()) - 1) < 1e-9 for k in other for x in "abc")
    classify.save(model, str(tmp_path / "model"))
    again = {r["id"]: (r["y_pred"], r["probabilities"]) for r in classify.predict(classify.load(spark, str(tmp_path / "model")), rows).collect()}
    assert all(again[k][0] == one[k][0] and np.isclose(again[k][1]["a"], one[k][1]["a"]) for k in one)


def test_a_fit_over_shards_ends_at_the_least_loss():
    class Plain:
        def __init__(self, x):
            self.x = x

        def products(self, a):
            return self.x @ (self.x.T @ a)

    rng = np.random.default_rng(2)
    x, y, share = rng.standard_normal((50, 80)), rng.integers(0, 3, 50), np.full(50, 1 / 50)
    a, added, losses = terms.fit(Plain(x), y, share, 3, 0.05)
    assert all(b <= c + 1e-12 for b, c in zip(losses[1:], losses))
    w = x.T @ a
    p = terms._chances(x @ w + added)[0] - np.eye(3)[y]
    assert np.abs((x.T @ (share[:, None] * p))[:, :2] + 0.05 * w).max() < 2e-3 and np.abs((share[:, None] * p).sum(axis=0)).max() < 2e-3
    assert terms.fit(Plain(x), np.zeros(50, int), share, 1, 0.05)[0].shape == (50, 0)
