from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return str(v)


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k != "pipeline" and not k.startswith("op")))
def test_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = entry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    left = sorted(repr([plain(r[c]) for c in order]) for r in got.collect())
    right = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in want.fetchall())
    assert left == right


def test_entry(spark):
    assert entry.entry(spark).count() > 0
