"""Every registered query: its plan, and its rows against its SQL, at the smallest scale."""

import math
import re
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from kgqueries.registry import ORACLES, QUERIES
from tests.conftest import SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


NEVER = re.compile("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroups")


def run(spark, name):
    """The rows; the plan must hold no nested loop and no Python."""
    df = entry.queries()[name](spark, SMALL)
    rows = df.collect()
    assert not NEVER.search(df._jdf.queryExecution().executedPlan().toString())
    return df, rows


def cell(v):
    if isinstance(v, (float, Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    df, rows = run(spark, name)
    cols = sorted(df.columns)
    got = Counter(tuple(cell(r[c]) for c in cols) for r in rows)
    ref = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in ref.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(cell(r[i]) for i in at) for r in ref.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    assert run(spark, name)[1]


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["name", "numOrders"] and df.count() == 10


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
