"""Reference lists, contents lists and indexes."""

from __future__ import annotations

import random
import re

from vellumframe.operators import lists, ordered

LINE = "book string, ord int, page int, x0 double, y0 double, x1 double, y1 double, size double, text string, entry string, label string, _prev int"


def frame(spark, rows):
    """rows: (book, x0, text[, page, y0, x1, size]) in order."""
    made = []
    for i, (book, x0, text, *more) in enumerate(rows):
        page, y0, x1, size = (more + [0, 10.0 * i, 150.0, 10.0][len(more) :])[:4]
        made.append((book, i, page, float(x0), float(y0), float(x1), float(y0) + 9, size, text, "e", "l", 1))
    return spark.createDataFrame(made, LINE)


def test_numbered_references(spark):
    rows = [("n", 50, "1. Smith J. One"), ("n", 60, "and more."), ("n", 50, "2. Jones K. Two"), ("n", 50, "Smith AB is no beginning here"), ("n", 50, "[3] Third"), ("u", 50, "Smith J. A title"), ("u", 60, "that goes on."), ("u", 50, "Not an author, but hanging"), ("u", 50, "no stop before"), ("u", 60, "Jones, K. begins by its name"), ("u", 60, "below a gap", 0, 400.0), ("u", 60, "next page", 1, 0.0), ("o", 50, None)]
    got = {(r["book"], r["ord"]): r["entry"] for r in lists.references(frame(spark, rows).drop("entry"), ["book"], 10.0).collect()}
    assert [got["n", i] for i in range(5)] == [0, 0, 1, 1, 2]
    assert [got["u", i] for i in range(5, 12)] == [0, 0, 1, 1, 2, 3, 3]
    assert got["o", 12] == 0 and len(got) == 13
    assert lists.references(frame(spark, rows).drop("entry").limit(0), ["book"], 10.0).count() == 0


def test_contents(spark):
    rows = [
        ("b", 50, "Contents"), ("b", 50, "Chapter 1 The heart ........ 1"), ("b", 70, "Ana Ruiz y Luis Mora"), ("b", 70, "Its valves and"), ("b", 70, "vessels   12"), ("b", 50, "SECTION TWO"), ("b", 50, "Chapter 2. The lung 25"), ("b", 50, ""),
        ("b", 50, "one of a head"), ("b", 50, "two of it"), ("b", 50, "three"), ("b", 50, "four"), ("b", 70, "then the rest"), ("b", 70, "Preface xii"), ("b", 50, "left alone"), ("b", 73, "and this"),
        ("c", 20, "Ana Ruiz"), ("c", 20, "First 1"), ("d", 10, "nothing else"), (None, 10, "12 of a page 3"),
    ]
    found = lists.contents(frame(spark, rows).drop("label"), ["book"]).orderBy("book", "ord").collect()
    got: dict = {}
    for r in found:
        got.setdefault(r["book"], []).append((r["ord"], r["label"], r["title"], r["page"], r["level"]))
    assert got["b"] == [
        (1, "Chapter 1", "The heart Ana Ruiz y Luis Mora", "1", 0), (3, None, "Its valves and vessels", "12", 1), (5, None, "SECTION TWO", None, 0), (6, "Chapter 2.", "The lung", "25", 0),
        (8, None, "one of a head two of it three four", None, 0), (12, None, "then the rest Preface", "xii", 1), (14, None, "left alone", None, 0), (15, None, "and this", None, 1),
    ]
    assert got["c"] == [(16, None, "Ana Ruiz First", "1", 0)] and got["d"] == [(18, None, "nothing else", None, 0)] and got[None] == [(19, "12", "of a page", "3", 0)]


def test_index_parts(spark):
    texts = ["Angina, 12, 45–47", "Heart. See also Angina; Valve", "Corazón, véase Angina", "Plain term", "Aorta, 3, 4. See Vessel", "12", "x iv.", "multi\nword, 7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r[0]) for r in df.select(lists.index_parts(df["t"])).collect()]
    assert got == [("Angina", ["12", "45–47"], [], []), ("Heart", [], [], ["Angina", "Valve"]), ("Corazón", [], ["Angina"], []), ("Plain term", [], [], []), ("Aorta", ["3", "4"], ["Vessel"], []), ("12", [], [], []), ("x", ["iv"], [], []), ("multi\nword", ["7"], [], [])]


def test_index(spark):
    data = ["INDEX", "This line says in many words how the whole index below is to be read by all", "A", "Angina, 12, 45–47", ("acute, 13", 62), ("chronic, 14", 62), ("very, 15", 74), ("stable, 15", 62), "Aorta, 3,", "4, 5", ("too deep to be an entry", 86), "B", ("first, 1", 74), "Bone. See also Joint", "C"]
    rows = [("b", x[1] if isinstance(x, tuple) else 50, x[0] if isinstance(x, tuple) else x, 0, 10.0 * i, 200.0 if i > 11 else 100.0) for i, x in enumerate(data)]
    rows += [("b", 500, "far away, 9", 0, 500.0, 700.0)]
    found = lists.index(frame(spark, rows).drop("label"), ["book"], 10.0).orderBy("ord").collect()
    assert [(r["division"], r["level"], r["term"], r["refs"]) for r in found] == [
        ("A", 0, "Angina", ["12", "45–47"]), ("A", 1, "acute", ["13"]), ("A", 1, "chronic", ["14"]), ("A", 2, "very", ["15"]), ("A", 1, "stable", ["15"]), ("A", 0, "Aorta, 3, 4, 5 too deep to be an entry", []),
        ("B", 0, "first", ["1"]), ("B", 0, "Bone", []), ("C", 0, "far away", ["9"]),
    ]
    assert found[-2]["see_also"] == ["Joint"]
    assert lists.index(frame(spark, rows).drop("label").limit(0), ["book"], 10.0).count() == 0


def test_index_in_buckets(spark, monkeypatch):
    """A long index in small buckets: what is one stretch is found again from the lines themselves."""
    monkeypatch.setattr(ordered, "WIDE", 4)
    monkeypatch.setattr(ordered, "BUCKETS", 16)
    r, rows, want = random.Random(2), [], []
    for i in range(400):
        depth = 0 if i == 0 else r.choice([0, 0, 1, 1, 2])
        open_end = r.random() < 0.2
        rows.append(("b", 50 + 12 * depth, f"term{i}" + (f", {i}," if open_end else f", {i}"), 0, 10.0 * i, 60.0 + (600.0 if i < 41 else 0)))
        before, goes = (want[-1], want[-1]["open"] or depth > want[-1]["level"] + 1) if want else (None, False)
        # Lines end far from the right edge but for the first, so that only open ends and steep steps go on.
        if goes:
            before["raw"] += " " + rows[-1][2]
            before["open"] = open_end
        elif before and 0 < i <= 41 and depth > before["level"]:
            before["raw"] += " " + rows[-1][2]
            before["open"] = open_end
        else:
            want.append({"ord": i, "level": depth, "raw": rows[-1][2], "open": open_end})
    found = lists.index(frame(spark, rows).drop("label"), ["book"], 10.0).orderBy("ord").collect()
    full = max(x[5] for x in rows)
    assert full == 660.0 and [r["ord"] for r in found] == [w["ord"] for w in want]
    refs = lambda raw: re.search(r"((?:\d+, )*\d+)$", raw)
    assert [bool(r["refs"]) for r in found] == [bool(refs(w["raw"])) for w in want]
