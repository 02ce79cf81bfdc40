"""Every registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tideline.plans import log_queries, registry, stream_queries, txn_queries  # noqa: F401

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    assert len(set(df.columns)) == len(df.columns)
    if name in registry.ORACLES:
        rel = duck.sql(registry.ORACLES[name])
        at = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
        want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
        assert sorted(df.columns) == [rel.columns[i] for i in at] and got == want
