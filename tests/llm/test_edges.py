"""Every dealt operator on empty tables, repeated and null rows, and clashing further columns."""

import pytest
from conftest import SF, rows

from cinderlode.llm import queries as Q

FOUND = ["p1_found", "p2_found", "p4_found", "p6_found", "p7_found", "p9_found"]


@pytest.mark.parametrize("name", [q for q in Q.QUERIES if q not in ("p7_items", "p8_shares", "p4_recall")])
def test_empty_tables(spark, empty, name):
    assert rows(Q.QUERIES[name](spark, empty)) == []


def test_reports_of_empty_tables(spark, empty, tmp_path):
    assert rows(Q.p8_shares(spark, empty)) == []
    assert rows(Q.p7_items(spark, empty)) == []


@pytest.mark.parametrize("name", FOUND)
def test_clashing_columns_and_repeated_rows(spark, clashing, repeated, name):
    plain = rows(Q.QUERIES[name](spark, SF))
    assert len(plain) == len(set(plain))
    assert rows(Q.QUERIES[name](spark, clashing)) == plain
    assert rows(Q.QUERIES[name](spark, repeated)) == plain


@pytest.mark.parametrize("name", ["p8_mixture", "p9_pieces", "p4_neighbours", "p1_feeds", "p6_fused", "p2_groups"])
def test_other_queries_with_clashing_columns(spark, clashing, name):
    assert rows(Q.QUERIES[name](spark, clashing)) == rows(Q.QUERIES[name](spark, SF))
