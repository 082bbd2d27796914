"""Every query against its expected-result SQL on the smallest data set."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference
from docproof.plans.queries import QUERIES
from oracle.sql import build

EXPECTED = build()


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    if name in EXPECTED:
        assert difference(df, con, EXPECTED[name]) is None
    else:
        assert df.count() > 0


def test_every_expected_result_has_a_query():
    assert set(EXPECTED) <= set(QUERIES)
    assert set(QUERIES) == set(EXPECTED)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name, order", [
    ("sort_by_any", "confidence, id"), ("daily_trend", "label"), ("confidence_distribution", "confidence"),
    ("scan_documents", "created_at DESC, id DESC"), ("page_documents", "confidence DESC, id DESC"),
])
def test_ordered_queries_come_in_order(spark, small, con, name, order):
    """The comparison above sorts both sides; here the order itself is compared."""
    df = QUERIES[name](spark, small)
    names = ", ".join(df.columns)
    want = con.execute(f"SELECT {names} FROM ({EXPECTED[name]}) ORDER BY {order}").fetchall()
    assert [tuple(r) for r in df.collect()] == want
