"""Every registered query equals its DuckDB oracle (rows, columns, values) at sf0.001."""

import collections
import math

import duckdb
import pytest

from reelforge.plans import registry as E

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
KEYS = sorted(E.queries())


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(repr(_norm(r[i])) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    missing = set(E.queries()) - set(E.oracle_sql())
    assert missing == set()


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF)
    rows = df.collect()
    cur = con.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _bag(df.columns, rows) == _bag(dcols, cur.fetchall())


@pytest.mark.parametrize("key", ["a05_column_stats_frames", "a05_column_stats_embeddings"])
def test_column_stats_do_not_need_exchange_reuse(spark, con, key):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = E.queries()[key](spark, SF)
        rows = df.collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    cur = con.execute(E.oracle_sql()[key])
    assert _bag(df.columns, rows) == _bag([d[0] for d in cur.description], cur.fetchall())
