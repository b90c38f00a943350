"""The catalogue against SQL on the smallest tables, and the contract of the entry module."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry
from evidloom.plans import catalog, oracle

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = duck.execute(oracle.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(float(r[i]) if r[i].__class__.__name__ == "Decimal" else r[i]) for i in at) for r in cur.fetchall()), key=str)
    assert got == want


def test_entry(spark):
    r = entry.entry(spark).first()
    assert 0 <= r.recall_at_1 <= r.recall_at_10 <= 1
    assert set(oracle.SQL) <= set(catalog.QUERIES) <= set(entry.queries())


def test_evidence_finds_more_than_claims(spark):
    assert catalog.bm25_oracle_ceiling(spark, DATA).first().recall_at_10 >= catalog.bm25_metrics(spark, DATA).first().recall_at_10 - 0.05


def test_reasons_add_up(spark):
    n = catalog.claims(spark, DATA).select("final_id", "source", "judgement").distinct().count()
    assert sum(r.n for r in catalog.reject_reasons(spark, DATA).collect()) >= n
