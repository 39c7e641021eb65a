"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from sysloom.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def one(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return repr(x) if isinstance(x, (bool, str, list)) else repr(float(x)) if isinstance(x, (int, float)) else str(x)

    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLE_SQL:
        got = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in got.description]
        assert sorted(names) == sorted(df.columns)
        assert plain(rows, df.columns) == plain(got.fetchall(), names)
    else:
        assert rows
