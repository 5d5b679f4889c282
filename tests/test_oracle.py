"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, sf, name):
    assert compare(spark, con, QUERIES[name], SQL[name], sf) in ("", "both empty")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    rows = {(r["kind"], r["value"]): r["n"] for r in entry.entry(spark).collect()}
    assert rows[("total", None)] == sum(n for (kind, _), n in rows.items() if kind == "severity")
