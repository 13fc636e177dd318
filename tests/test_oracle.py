"""Every query against DuckDB on the smallest driver tables."""

import math
import os

import duckdb
import pytest

from veritally.plans.oracle import ORACLE_SQL
from veritally.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def rows(pdf):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("<NA>", "NaT"):
            return "null"
        return f"{float(x):.9g}" if "float" in type(x).__name__ else str(x)

    return sorted(tuple(cell(x) for x in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) and rows(got) == rows(want)


def test_streams_equal_their_batch_twins(spark):
    assert rows(QUERIES["stream_human"](spark, SF).toPandas()) == rows(QUERIES["human_standing"](spark, SF).toPandas())
