"""Ancestors by open levels, against all pairs."""

from __future__ import annotations

import random

from vellumframe.operators import ordered, tree

NODES = "doc string, pre long, last long, tag string, _level long, ancestor string"


def forest(seed: int, n: int, deep: float) -> list[tuple]:
    """(pre, last, tag) of a random tree in document order."""
    r, out, open_ = random.Random(seed), [], []
    for pre in range(n):
        while open_ and r.random() > deep:
            out[open_.pop()][1] = pre - 1
        out.append([pre, pre, r.choice("abcd")])
        open_.append(pre)
    for i in open_:
        out[i][1] = n - 1
    return [tuple(x) for x in out]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ordered, "WIDE", 4)
    monkeypatch.setattr(ordered, "BUCKETS", 16)
    data = [(doc, *x) for doc, seed, n, deep in (("p", 1, 300, 0.6), ("q", 2, 200, 0.95), (None, 3, 40, 0.5), ("r", 4, 1, 0.5)) for x in forest(seed, n, deep)]
    df = spark.createDataFrame([(*x, 7, "x") for x in data], NODES)
    outer, inner = df.where("tag in ('a', 'b')"), df.where("tag in ('b', 'c')")
    want = sorted((str(d), a, b) for d, a, last, t in data if t in "ab" for d2, b, _, t2 in data if d2 == d and t2 in "bc" and a < b <= last)
    # Repeated rows are one ancestor and one node.
    pairs = tree.within(outer.union(outer), inner.union(inner), ["doc"])
    assert sorted((str(r["doc"]), r["outer_pre"], r["inner_pre"]) for r in pairs.collect()) == want
    near = tree.nearest_ancestor(inner.drop("ancestor"), outer, ["doc"])
    deepest = {(d, b): max(a for d2, a, b2 in want if (d2, b2) == (d, b)) for d, _, b in want}
    got = near.collect()
    assert {(str(r["doc"]), r["pre"]): r["ancestor"] for r in got if r["ancestor"] is not None} == deepest and len(got) == inner.count() and near.columns == [*inner.drop("ancestor").columns, "ancestor"]
    counted = {(str(r["doc"]), r["pre"]): r["n"] for r in tree.around(inner, outer, ["doc"], "n").collect()}
    assert counted == {(str(d), b): sum((d2, b2) == (str(d), b) for d2, _, b2 in want) for d, b, _, t in data if t in "bc"}


def test_wide_document(spark):
    """A document whose equality join would meet 40,000 * 400 rows."""
    nodes = spark.range(40_000).selectExpr("'d' AS doc", "id AS pre", "id AS last")
    outer = spark.range(400).selectExpr("'d' AS doc", "id * 100 AS pre", "id * 100 + 50 AS last")
    got = tree.within(outer, nodes, ["doc"])
    assert got.count() == 400 * 50 and got.where("outer_pre != inner_pre - inner_pre % 100").count() == 0
    assert tree.within(outer, nodes.limit(0), ["doc"]).count() == 0 and tree.nearest_ancestor(nodes, outer.limit(0), ["doc"]).where("ancestor is null").count() == 40_000
