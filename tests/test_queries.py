import importlib.util
import math
import os
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__
from weftline.operators import graph

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def cells(frame):
    frame = frame[sorted(frame.columns)]
    plain = lambda v: "none" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(plain, row)) for row in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(__spark_entry__.plans.ORACLES))
def test_query_and_sql_agree(spark, database, name):
    got = __spark_entry__.queries()[name](spark, FOLDER).toPandas()
    want = database.execute(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and cells(got) == cells(want)


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.plans.QUERIES) - set(__spark_entry__.plans.ORACLES) - {"tfidf_logreg", "baseline_report"}))
def test_other_queries_run(spark, name):
    assert __spark_entry__.queries()[name](spark, FOLDER).columns


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["source", "target", "weight", "cooccurrences", "episodes"]


def test_llm_queries_are_there_if_their_package_is():
    present = importlib.util.find_spec("weftline.llm") is not None
    assert ("pipeline" in __spark_entry__.queries()) == present


@pytest.mark.parametrize("name", ["recall_exchanges", "recall_scenes"])
def test_searches_take_every_twentieth_vector(spark, database, name):
    asked = {r["query_id"] for r in __spark_entry__.queries()[name](spark, FOLDER).collect()}
    assert asked == {v for (v,) in database.execute("SELECT vec_id FROM embeddings WHERE vec_id % 20 = 0").fetchall()} and len(asked) > 5


def test_metrics_are_of_the_whole_network(spark, tmp_path):
    rng = random.Random(4)
    names = [f"Name{a}{b}" for a in "abcdef" for b in "ghijkl"]
    texts = [[rng.choice(names) for _ in range(30)] for _ in range(60)]
    spark.createDataFrame([(i, "\n".join(t), "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    weight = np.zeros((len(names), len(names)))
    for text in texts:
        for i, a in enumerate(text):
            for j in range(i + 1, min(i + 11, len(text))):
                if a != text[j]:
                    x, y = names.index(a), names.index(text[j])
                    weight[x, y] += math.exp((i - j) / 4)
                    weight[y, x] = weight[x, y]
    assert (weight > 0).sum() > 2 * 250
    run = lambda name: __spark_entry__.queries()[name](spark, str(tmp_path)).toPandas()
    ranks, vector = np.full(len(names), 1 / len(names)), np.ones(len(names))
    for _ in range(300):
        ranks = 0.15 / len(names) + 0.85 * (weight / weight.sum(axis=0)) @ ranks
        vector = (weight + np.eye(len(names))) @ vector
        vector /= np.linalg.norm(vector)
    metrics = run("network_metrics").set_index("character").loc[names]
    assert metrics["degree"].tolist() == (weight > 0).sum(axis=0).tolist()
    assert np.allclose(metrics["strength"], weight.sum(axis=0)) and np.allclose(metrics["pagerank"], ranks) and np.allclose(metrics["eigenvector"], vector)
    assert np.allclose(run("pagerank").set_index("character").loc[names, "pagerank"], ranks, atol=1e-6)
    assert np.allclose(run("eigenvector").set_index("character").loc[names, "eigenvector"], vector, atol=1e-6)
    edges = [(names[i], names[j], weight[i, j]) for i in range(len(names)) for j in range(i + 1, len(names)) if weight[i, j]]
    labels = graph.louvain_labels(edges)
    assert dict(run("louvain").values) == labels and metrics["community"].to_dict() == labels
    # shortest paths by squaring, then the share of them through each name
    with np.errstate(divide="ignore"):
        length = np.where(weight > 0, 1 / weight, np.inf)
    np.fill_diagonal(length, 0)
    short = length.copy()
    for k in range(len(names)):
        short = np.minimum(short, short[:, [k]] + short[[k], :])
    n = len(names)
    on = [sum(s != v != t and s != t and math.isclose(short[s, v] + short[v, t], short[s, t]) for s in range(n) for t in range(n)) / (n - 1) / (n - 2) for v in range(n)]
    assert np.allclose(run("betweenness").set_index("character").loc[names, "betweenness"], on, atol=1e-6)
    best = {c: sorted((-metrics.loc[x, "pagerank"], x) for x in names if labels[x] == c)[:2] for c in set(labels.values())}
    assert {(r.community, r.place): r.character for r in run("community_top2").itertuples()} == {(c, k + 1): x for c, two in best.items() for k, (_, x) in enumerate(two)}


def test_vocabulary_of_tfidf_logreg_is_not_cut(spark, monkeypatch):
    models, fit = [], __spark_entry__.plans.classify.tfidf_logistic
    monkeypatch.setattr(__spark_entry__.plans.classify, "tfidf_logistic", lambda *a, **b: models.append(fit(*a, **b)) or models[0])
    assert __spark_entry__.queries()["tfidf_logreg"](spark, FOLDER).count()
    assert max(len(stage.vocabulary) for stage in models[0].stages if hasattr(stage, "vocabulary")) > 1 << 12


def test_surfaces_of_all_documents_are_resolved(spark, database):
    got = {r["surface"] for r in __spark_entry__.queries()["surface_resolution"](spark, FOLDER).collect()}
    assert got == {s for (s,) in database.execute("SELECT DISTINCT unnest(regexp_extract_all(text, '\\b([A-Z][a-z]{3,})', 1)) FROM documents").fetchall()} and len(got) > 12
