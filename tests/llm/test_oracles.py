import os

import duckdb
import pytest

from weftline.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want, got = connection.execute(ORACLES[name]).df(), QUERIES[name](spark, FOLDER).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert sorted(map(str, want[columns].itertuples(index=False, name=None))) == sorted(map(str, got[columns].itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["op1_html_extraction", "op6_bpe_round_trip", "op7_quality", "op8_toxicity", "op9_token_counts", "op10_packing"])
def test_other_queries_return_a_row_for_each_input(spark, name):
    out = QUERIES[name](spark, FOLDER)
    key = "page_id" if name.startswith("op1_") else "doc_id"
    table = "pages" if key == "page_id" else "documents"
    assert out.select(key).distinct().count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()
