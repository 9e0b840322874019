"""Every registered plan with SQL, against DuckDB at the smallest scale."""

import duckdb
import pytest

from siteworks.plans import CHECKS, PLANS

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return f"{value:.9g}" if value else "0"
    return None if value is None else str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=str)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_plan_equals_sql(spark, db, name):
    got = PLANS[name](spark, SF)
    want = db.execute(CHECKS[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


def test_every_check_has_a_plan():
    assert set(CHECKS) <= set(PLANS)
