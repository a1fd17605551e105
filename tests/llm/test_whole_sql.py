"""Whole results of operators against their SQL on the small documents table."""

import duckdb
import pytest

from periodica.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op9_ngram_join", "op10_suffix_dedup"])
def test_rows_match_sql(spark, name):
    got = QUERIES[name](spark, SF)
    names = ", ".join(sorted(got.columns))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(f"select {names} from ({ORACLES[name]}) order by doc_id").fetchall()
    assert [tuple(r) for r in got.select(*sorted(got.columns)).orderBy("doc_id").collect()] == want
