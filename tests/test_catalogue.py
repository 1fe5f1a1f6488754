"""Every query with SQL gives the rows that DuckDB gives; the rest run."""

from __future__ import annotations

import os
from collections import Counter
from html.parser import HTMLParser

import pytest

import oracle_check
from vellumframe.plans import applied, catalogue, fixtures, layouts  # noqa: F401


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in oracle_check.TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, sf, duck, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle_check.rows_of(got) == oracle_check.rows_of(want)


def test_parent_child(spark, sf):
    """Against a plain stack machine with the same rules for void and implied ends."""
    from vellumframe.sources.markup import _CLOSES, _VOID

    want: Counter = Counter()

    class Stack(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open = []

        def handle_starttag(self, tag, attrs):
            while self.open and tag in _CLOSES.get(self.open[-1], ()):
                self.open.pop()
            want[(self.open[-1] if self.open else "#root", tag)] += 1
            if tag not in _VOID:
                self.open.append(tag)

        def handle_endtag(self, tag):
            if tag in self.open:
                while self.open.pop() != tag:
                    pass

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        Stack().feed(r["html"])
    got = {(r["parent_tag"], r["child_tag"]): r["n"] for r in catalogue.parent_child(spark, sf).collect()}
    assert got == dict(want)


def test_entry_and_guard(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
