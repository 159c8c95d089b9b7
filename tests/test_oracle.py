"""Every registered query of the engine against its SQL twin, at the smallest size."""

import duckdb
import pytest

from adloom.plans import oracle, queries

SF = "/root/testdata/sf0.001"
ORACLE = oracle.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("lineitem", "part", "orders", "events", "pages", "embeddings", "nation", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(str, zip(*[table.column(c).to_pylist() for c in names])))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    got = rows(queries.queries()[name](spark, SF).toArrow())
    assert got == rows(duck.execute(ORACLE[name]).to_arrow_table())


def test_rows_only_queries(spark):
    for name in set(queries.queries()) - set(ORACLE):
        assert queries.queries()[name](spark, SF).count() > 0
