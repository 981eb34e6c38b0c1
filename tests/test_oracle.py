"""Every registered query with an oracle equals DuckDB on the sf0.001 tables."""

import math

import duckdb
import pytest

from pagewright.plans.catalog import ORACLE, QUERIES

from conftest import SF_SMALL

TABLES = ["customer", "events", "documents", "embeddings", "pages", "benchmark", "conversations"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def canon(v):
    if v is None:
        return ("~",)
    if isinstance(v, float):
        return ("n", round(v, 6)) if not math.isnan(v) else ("nan",)
    if isinstance(v, (int, bool)) and not isinstance(v, bool):
        return ("n", float(v))
    return (type(v).__name__, v)


def table(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in recs)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert table(sdf.columns, [tuple(r) for r in sdf.collect()]) == table(dcols, res.fetchall())


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.startswith("audit_")])
def test_audits_find_some_rows_and_not_all(spark, name):
    from pagewright.sources import TestTables
    t = TestTables(spark, SF_SMALL)
    found = QUERIES[name](spark, SF_SMALL).count()
    assert 0 < found < t.fx_inodes_bad.count() + t.fx_pages_bad.count()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
