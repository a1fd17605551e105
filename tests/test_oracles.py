import datetime
import math

import duckdb
import pytest

from periodica.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "lineitem", "events", "part", "documents")


def plain(rows):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, bool) or isinstance(v, str):
            return str(v)
        if isinstance(v, datetime.datetime):
            return v.isoformat()
        return round(float(v), 4) + 0.0
    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows_match_sql(spark, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    found = plain(got.select(names).collect())
    if name not in ORACLES:
        assert isinstance(found, list)
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    out = con.sql(ORACLES[name])
    assert sorted(out.columns) == names
    want = plain(con.sql(f"select {', '.join(names)} from ({ORACLES[name]})").fetchall())
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-4)) for x, y in zip(a, b, strict=True)), (a, b)
