"""Every training-data query with SQL equals it on the small tables."""

import collections
import math

import duckdb
import pytest

from reelforge.llm import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages labels conversations".split()


def _norm(v):
    return ("nan" if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(repr(_norm(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("key", sorted(Q.oracle_sql()))
def test_query_matches_oracle(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = Q.queries()[key](spark, SF)
    cur = con.execute(Q.oracle_sql()[key])
    assert _bag(df.columns, df.collect()) == _bag([d[0] for d in cur.description], cur.fetchall())
