"""Every query against its SQL in DuckDB, on the smallest tables."""

import math

import pytest

from auditweave.plans.registry import oracle_sql, queries
from auditweave.plans.roles import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in (*TABLES, "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_is_its_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    own = plain(df.select(*[f"`{c}`" for c in columns]).collect())
    got = duck.sql(oracle_sql()[name])
    assert sorted(got.columns) == columns
    order = [got.columns.index(c) for c in columns]
    assert own == plain([[r[k] for k in order] for r in got.fetchall()])
