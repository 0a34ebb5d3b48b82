import random

import corpus_pipeline
from weftline.llm import bpe, packing
from tests.llm.test_models import made


def test_stages_keep_clean_documents_and_drop_what_they_should(spark, tmp_path):
    rng = random.Random(1)
    texts, marks = made(21, 240)
    junk = ["!! ".join(t.upper().split()) for t in texts[:160:2]]
    rows = [(i, t) for i, t in enumerate(texts + junk)]
    clean = [t for t, m in zip(texts, marks) if not m]
    n = len(rows)
    copies = [(n + k, clean[k]) for k in range(10)]
    near = [(n + 20 + k, clean[20 + k] + " tail") for k in range(10) if len(clean[20 + k].split()) > 60]
    rows += copies + near + [(None, clean[40] + " of an unknown id"), (copies[0][0], clean[0])]
    table = spark.createDataFrame([(i, t, "en", "clash") for i, t in rows], "doc_id long, text string, lang string, kept string")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, m) for i, m in enumerate(marks)] + [(len(texts) + k, 0, 0) for k in range(len(junk))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == table.columns
        kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    toxic = {i for i, m in enumerate(marks) if m}
    assert len(toxic & {i for i, _ in kept["toxicity"]}) <= 0.05 * len(toxic)
    assert len({i for i, m in enumerate(marks) if not m} - {i for i, _ in kept["toxicity"]}) <= 3
    assert sum(i is not None and len(texts) <= i < len(texts) + len(junk) for i, _ in kept["quality"]) <= 2
    exact = kept["exact_dedup"]
    assert len({t for _, t in exact}) == len(exact) and {t for _, t in exact} == {t for _, t in kept["quality"]}
    for text in {t for _, t in exact}:
        ids = [i for i, t in kept["quality"] if t == text]
        assert [i for i, t in exact if t == text] == [max(ids, key=lambda i: -1 if i is None else i)]
    gone = {i for i, _ in exact} - {i for i, _ in kept["minhash_near_dedup"]}
    assert gone <= {i for i, _ in near} and len(gone) >= len([i for i, _ in near if i in {j for j, _ in exact}]) - 1
    packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in kept["minhash_near_dedup"]}
    assert len(packing.pack(docs, bpe.default_path()).columns) == 7
    assert rng


def test_empty_tables_pass_through(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
