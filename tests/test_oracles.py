"""Core queries against their SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from millrace.plans import registry

SF = "/root/testdata/sf0.001"
FEW = [n for n in registry.ORACLE_SQL if n not in ("run_blocking", "blocking_stats", "recall_report", "channel_union")]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    value = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    return sorted(([value(v) for v in r] for r in frame.astype(object).values.tolist()), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", FEW)
def test_query(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(registry.ORACLE_SQL[name]).df())
