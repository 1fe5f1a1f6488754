"""Zone trees, the log of edits, undo and redo."""

from __future__ import annotations

import random

from vellumframe.operators import ordered, zones

ZONES = "book string, zid string, parent string, pos long, kind string, level int"


def tree_of(df, book="b"):
    return {r["zid"]: (r["parent"], r["pos"]) for r in df.where(f"book = '{book}'").collect()}


def test_renest_any_level(spark, monkeypatch):
    monkeypatch.setattr(ordered, "WIDE", 4)
    monkeypatch.setattr(ordered, "BUCKETS", 16)
    r = random.Random(4)
    data = [(b, f"{b}{i}", i * 3, r.choice([None, 1, 2, 3, 7, 8, 9, 40])) for b in "pq" for i in range(200)]
    want = {}
    for b in "pq":
        stack: list = []
        for _, zid, _, level in (x for x in data if x[0] == b):
            while stack and stack[-1][0] >= (level or 1):
                stack.pop()
            want[zid] = stack[-1][1] if stack else None
            stack.append((level or 1, zid))
    df = spark.createDataFrame(data, "book string, zid string, ord long, level int")
    assert {x["zid"]: x["parent"] for x in zones.renest(df).collect()} == want
    flow = spark.createDataFrame([("b", "p0", 0, "p", None), ("b", "s1", 1, "sec", 1), ("b", "p2", 2, "p", None), ("b", "s3", 3, "sec", 9), ("b", "p4", 4, "p", None), ("b", "s5", 5, "sec", 8), ("c", "p6", 1, "p", None)], "book string, zid string, ord int, kind string, level int")
    assert {x["zid"]: x["parent"] for x in zones.reflow(flow).collect()} == {"p0": None, "s1": None, "p2": "s1", "s3": "s1", "p4": "s3", "s5": "s1", "p6": None}
    assert zones.renest(df.limit(0)).count() == 0


def small(spark):
    rows = [("b", "r", None, 0, "body", None), *[("b", z, "r", i, k, n) for i, (z, k, n) in enumerate([("a", "p", None), ("s", "sec", 1), ("c", "p", None), ("d", "ref-list", None)])], ("b", "s1", "s", 0, "title", None), ("b", "s2", "s", 1, "p", None), ("c", "r", None, 0, "body", None)]
    return spark.createDataFrame(rows, ZONES)


def test_tree_edits(spark):
    own = small(spark)
    edit = lambda text, *rows: spark.createDataFrame(rows, text)
    boxed = zones.wrap(own, edit("book string, zid string, into string, new_kind string", ("b", "c", "x", "boxed-text"), ("b", "s", "x", "boxed-text"), ("b", "s2", "x", "boxed-text")))
    assert tree_of(boxed) == {"r": (None, 0), "a": ("r", 0), "x": ("r", 1), "d": ("r", 2), "s": ("x", 0), "c": ("x", 1), "s1": ("s", 0), "s2": ("s", 1)}
    back = zones.unwrap(boxed, edit("book string, zid string", ("b", "x")))
    assert tree_of(back) == tree_of(own) and tree_of(back, "c") == {"r": (None, 0)}
    moves = edit("book string, zid string, to string, after long", ("b", "c", "s", 0), ("b", "s", "s2", -1), ("b", "d", "r", -1))
    assert tree_of(zones.move(own, moves)) == {"r": (None, 0), "d": ("r", 0), "a": ("r", 1), "s": ("r", 2), "s1": ("s", 0), "c": ("s", 1), "s2": ("s", 2)}
    assert {r["zid"]: r["level"] for r in zones.set_level(own, edit("book string, zid string, new_level int", ("b", "s", 4))).collect() if r["level"]} == {"s": 4}
    assert [(r["book"], r["parent"]) for r in zones.misplaced(own).collect()] == [("b", "r")]
    nested = zones.normalize(own)
    assert tree_of(nested) == {"r": (None, 0), "a": ("r", 0), "s": ("r", 1), "d": ("r", 2), "s1": ("s", 0), "s2": ("s", 1), "c": ("s", 2)} and zones.misplaced(nested).count() == 0


def test_standing(spark):
    r, rows, want = random.Random(6), [], {}
    for book in range(30):
        old, undo, redo = [], [], []
        for seq in range(r.randint(0, 60)):
            action = r.choice(["edit", "edit", "undo", "redo", "look"])
            rows.append((book, seq, action))
            if action == "edit":
                undo.append(seq)
                redo.clear()
                if len(undo) > 4:
                    old.append(undo.pop(0))
            elif action == "undo" and undo:
                redo.append(undo.pop())
            elif action == "redo" and redo:
                undo.append(redo.pop())
            if seq == 25:
                want[book, 25] = sorted(old + undo)
        want[book, None] = sorted(old + undo)
    df = spark.createDataFrame(rows, "book int, seq int, action string")
    for at in (None, 25):
        got: dict = {}
        for x in zones.standing(df, at, depth=4).collect():
            got.setdefault(x["book"], []).append(x["edit"])
        assert {k: sorted(v) for k, v in got.items()} == {b: w for (b, a), w in want.items() if a == at and w} or at == 25 and all(sorted(got.get(b, [])) == w for (b, a), w in want.items() if a == 25)


def test_versions(spark):
    """The tree after each action is that which the edits made, undone and redone."""
    own = small(spark).where("book = 'b'")
    first = zones.set_level(own, spark.createDataFrame([("b", "s", 4)], "book string, zid string, new_level int"))
    second = zones.unwrap(first, spark.createDataFrame([("b", "s")], "book string, zid string"))
    third = zones.wrap(first, spark.createDataFrame([("b", "a", "y", "boxed-text")], "book string, zid string, into string, new_kind string"))
    keys = ["book", "zid"]
    log = zones.changed(own, first, keys, 1).union(zones.changed(first, second, keys, 2)).union(zones.changed(first, third, keys, 5))
    assert zones.changed(own, own, keys, 9).count() == 0
    actions = spark.createDataFrame([("b", 1, "edit"), ("b", 2, "edit"), ("b", 3, "undo"), ("b", 4, "undo"), ("b", 5, "edit"), ("b", 6, "redo")], "book string, seq int, action string")
    actions = actions.where("seq <> 4")  # first stands when the third is made
    held = lambda df: sorted(map(str, df.select(own.columns).collect()))
    for at, want in ((0, own), (1, first), (2, second), (3, first), (5, third), (6, third)):
        assert held(zones.as_of(own, log, actions, keys, at)) == held(want), at
