"""Core queries against their SQL over a few pages with titles that letters with accents make hard."""

import duckdb
import pytest

from millrace.plans import registry
from test_oracles import rows

WORDS = ["wren", "alder", "heron", "fern", "moss", "tern", "gull", "quarry", "loom", "birch"]
TITLES = {12: "éoi.", 7: "é", 5: "ço moss tern", 25: "ééoi. un"}
QUERIES = ["chan_b_df", "chan_c_lsh", "dedup_tokens", "name_variants", "normalized_records", "base_clean", "chan_b_idf", "chan_c_shingles", "suffix_strip"]


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    title = lambda i: TITLES.get(i, f"{WORDS[i % 10]} {WORDS[i * 7 // 10 % 10]} {WORDS[i * 3 % 10]}{i}")
    spark.createDataFrame([(i, f"<title>{title(i)}</title>") for i in range(60)], "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, pages, name):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{pages}/pages.parquet/*.parquet'")
    assert rows(registry.QUERIES[name](spark, pages).toPandas()) == rows(con.sql(registry.ORACLE_SQL[name]).df())
