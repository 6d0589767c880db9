from __future__ import annotations

import duckdb
import pytest

from orrery.llm import queries

from ..test_oracles import TABLES, plain


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    """Whole tables, row by row."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    left = sorted(repr([plain(r[c]) for c in order]) for r in got.collect())
    right = sorted(repr([plain(r[names.index(c)]) for c in order]) for r in want.fetchall())
    assert left and left == right
