"""Registered queries beside their SQL on the smallest tables.

Single features are left to test_features.py and to verify.py, which runs everything.
"""

import duckdb
import pytest
from conftest import SF_SMALL

import __spark_entry__ as entry_point
from tidegauge.catalogue import base

TABLES = "orders lineitem events embeddings".split()
SQL, QUERIES = base.ORACLES, base.QUERIES  # the training-data operators are checked beside their own tables
entry_point.queries()
CHECKED = [n for n in SQL if not n.startswith("feature_")] + ["feature_median", "feature_spectral_centroid", "feature_mfcc"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted("|".join(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    want = canonical(cur.fetchall(), names)
    assert len(got) == len(want) and len(got) > 0
    assert got == want


def test_registry():
    assert set(SQL) <= set(QUERIES) <= set(entry_point.queries())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
