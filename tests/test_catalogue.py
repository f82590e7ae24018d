"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from trailmesh import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame):
    def plain(x):
        if x is None or pd.isna(x):
            return "null"
        return repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__module__ == "numpy" and type(x).__name__ != "bool" else str(bool(x)) if type(x).__name__ in ("bool", "bool_") else str(x)

    return sorted(tuple(plain(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, db, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    if name in catalogue.ORACLE_SQL:
        want = db.execute(catalogue.ORACLE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    assert len(got) > 0 or name in ("chunk_needed", "journey_candidates", "triple_candidates", "meeting_flash", "snap_pair", "sampled_triples", "chunk_coverage_violations", "endpoint_use_counts")


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(catalogue.ORACLE_SQL) <= set(entry.queries())
