"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from quirefold.functions.predicates import parse_filter
from quirefold.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    cur = duck.execute(ORACLES[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted(repr(tuple(r[cols.index(c)] for c in sorted(cols))) for r in cur.fetchall())


def test_pushdown_and_topk(spark):
    plan = QUERIES["topk_entry_orders"](spark, DIR)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThanOrEqual(" in plan and "o_orderdate" not in plan.split("ReadSchema")[1]


def test_cli_literals():
    assert parse_filter("a:eq:4") == ("a", "eq", 4) and parse_filter("a:lt:4.5") == ("a", "lt", 4.5)
    assert parse_filter("a:eq:true") == ("a", "eq", True) and parse_filter("a:eq:x:y") == ("a", "eq", "x:y")
    assert parse_filter("a:gt:inf")[2] == float("inf")
    for bad in ("a:eq", "a:any:1", "a"):
        with pytest.raises(ValueError):
            parse_filter(bad)


#: Queries that match nothing on the tables given, by design.
NOTHING = {"filter_type_mismatch_eq", "filter_type_mismatch_range", "filter_undeclared_field", "contains_any_empty", "array_eq_scalar", "limit_zero", "filter_bigint_exact"}


def test_no_query_is_vacuous():
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    empty = {n for n, sql in ORACLES.items() if not duck.execute(sql).fetchone()}
    assert empty <= NOTHING


def test_whole_orders_stay_dealt_out(spark):
    """Places of a whole sorted table come without a task that has all of its rows: a window orders partitions, not rows."""
    plan = QUERIES["order_by_desc"](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "__before" in plan
