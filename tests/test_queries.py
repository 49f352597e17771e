"""Every registered audit query against DuckDB on the same Parquet files."""

import duckdb
import pytest

from webweft.plans import registry

TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(str(v[i]) for i in order) for v in values))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches(spark, small, duck, name):
    df = registry.queries()[name](spark, small)
    got = rows(df.columns, df.collect())
    rel = duck.sql(registry.oracle_sql()[name])
    assert got == rows(rel.columns, rel.fetchall())
