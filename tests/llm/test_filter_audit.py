"""Filter interactions, against a replay in Python."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
from helpers import docs

from vellumframe.llm import filter_audit, queries

LABELS = "doc_id long, quality int, toxic int, part string"


def want(rows: list[tuple], labels: list[tuple]) -> dict:
    """(part, order, step): counts, of (id, part, text)."""
    least: dict = {}
    for i, _, text in rows:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    out, shapley = defaultdict(lambda: [0] * 6), Counter()
    for i, part, text in rows:
        text, part = text or "", part or ""
        words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and least[text] < i,
        }
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, letter in enumerate(order, 1):
                x = out[part, order, step]
                here = fails[letter] and not gone
                x[2] += fails[letter] and gone
                gone |= here
                x[0] += not gone
                x[1] += here
                x[3] += fails[letter] and sum(fails.values()) == 1
                x[4] += here and i in good
                x[5] += here and i in toxic
                shapley[part, letter] += here
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def held(got, wanted: dict) -> None:
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got} == wanted and len(got) == len(wanted)


def test_odd_rows(spark):
    df = docs(spark)
    rows = [(r["doc_id"], r["source"], r["text"]) for r in df.collect()] + [(50, "t", "A# " * 300), (51, "", "A# " * 300), (52, None, "w%d " * 40)]
    more = spark.createDataFrame([(i, t, "en", p, 0, 0.0, 0, True, 0, 0) for i, p, t in rows], df.schema)
    labels = [(5, 1, 0, "x"), (5, 0, None, "x"), (50, None, 1, "y"), (None, 1, 1, "z"), (3, 1, 1, "q")]
    held(filter_audit.audit(more, spark.createDataFrame(labels, LABELS)).collect(), want(rows, [x[:3] for x in labels]))


def test_empty(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs(spark).limit(0), none).count() == 0
    assert filter_audit.audit(docs(spark), none).count() == 2 * 120 * 5


def test_query_and_sql(spark, sf):
    got = queries.op11_filter_audit(spark, sf).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    held(got, want(rows, labels))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    names = got[0].asDict().keys()
    assert sorted(con.sql(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL['op11_filter_audit']})").fetchall()) == sorted(map(tuple, got))
