"""Pages, marks, contexts and bookmarks on small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumframe.operators import pages
from vellumframe.sources import markup


def rows(df):
    return [tuple(r) for r in df.collect()]


def dom(spark, xml):
    return markup.dom(spark.createDataFrame([(1, xml)], "doc int, x string"), "doc", "x", "xml")


def test_contexts(spark):
    xml = "<b><p><xref/></p><boxed-text><caption><xref/></caption><p><xref/></p></boxed-text><table-wrap><table><fn><xref/></fn></table><xref/></table-wrap><ref><fn><xref/></fn></ref></b>"
    found = sorted(rows(pages.contexts(dom(spark, xml), "doc")))
    assert [c for _, _, c in found] == ["body", "caption", "sidebar", "footnote", "table", "reference"]


def test_before_blocks(spark):
    xml = "<b><fig/><p>One two  three four five six seven eight nine<fig/></p><table-wrap/><fig/><sec><fig/></sec></b>"
    found = [b for _, _, b in sorted(rows(pages.before_blocks(dom(spark, xml), "doc", ["fig", "table-wrap"])))]
    assert found == ["START", "IN-P", "one two three four five six seven eight", "one two three four five six seven eight", "START"]


def test_bookmark_levels(spark):
    marks = spark.createDataFrame([("b", 0, "1. The Heart", 1), ("b", 1, "Valves of the heart and more", 2), ("b", 2, "valves of the heart, again", 3), ("b", 3, "", 4), ("c", 0, "Lungs", 1)], "book string, pos int, text string, level int")
    heads = spark.createDataFrame([("b", 1, "THE HEART"), ("b", 2, "Valves of the heart"), ("b", 3, "Valves"), ("b", 4, "Lungs"), ("c", 5, "Lungs"), ("b", 6, "")], "book string, at int, text string")
    assert {r["at"]: r["level"] for r in pages.bookmark_levels(heads, marks).collect()} == {1: 1, 2: 2, 3: None, 4: None, 5: 1, 6: None}


def test_folios_and_order(spark):
    sizes = spark.createDataFrame([(f, p, 0.0, 100.0) for f in "ab" for p in range(6)], "pdf string, page int, y0 double, y1 double")
    words = spark.createDataFrame([("a", 0, 1.0, 5.0, "17"), ("a", 1, 95.0, 99.0, "18"), ("a", 2, 1.0, 5.0, "3"), ("a", 3, 50.0, 55.0, "99"), ("a", 5, 1.0, 2.0, "400"), ("b", 0, 1.0, 5.0, "x")], "pdf string, page int, y0 double, y1 double, text string")
    assert rows(pages.first_folios(words, sizes)) == [("a", 17)]
    files = spark.createDataFrame([("k", "f", 0, 1, "f", "fm", None), ("k", "x", 1, 1, "x", "ch", 50), ("k", "y", 1, 2, "y", "app", 20), ("k", "z", 1, 3, "z", "ch", 90), ("l", "x", 1, 2, "x", "ch", 5), ("l", "y", 1, 1, "y", "ch", 9)], "book string, pdf string, rank int, number int, name string, code string, start int")
    assert {(r["book"], r["pdf"]): r["seq"] for r in pages.by_folio(files).collect()} == {("k", "f"): 0, ("k", "y"): 1, ("k", "x"): 2, ("k", "z"): 3, ("l", "y"): 0, ("l", "x"): 1}


def test_tabs_and_report(spark):
    df = spark.createDataFrame([(1, 5.0, True, "tab"), (2, 300.0, True, "tab"), (3, 597.0, True, "tab"), (4, 5.0, False, "tab"), (5, 5.0, True, "t" * 60)], "i int, x double, v boolean, t string")
    b, clip = pages.box(F.col("x"), F.lit(0.0), F.col("x") + 8, F.lit(40.0)), pages.box(F.lit(0.0), F.lit(0.0), F.lit(612.0), F.lit(792.0))
    assert [r["i"] for r in df.where(pages.side_tab(b, F.col("v"), F.col("t"), clip)).collect()] == [1, 3]
    states = spark.createDataFrame([(i, "PASS" if i % 2 else "ERROR") for i in range(900)], "page int, status string")
    assert [r["page"] for r in pages.page_report(states, ["page"]).collect()] == list(range(0, 600, 2))


def test_contexts_of_many_move_rows_once(spark):
    """Nested holders and repeated links in several documents, against all pairs; events are exchanged once."""
    import random

    r, data = random.Random(3), []
    for d in ("p", "q", None):
        open_, made = [], []
        for pre in range(200):
            while open_ and r.random() > 0.7:
                made[open_.pop()][2] = pre - 1
            made.append([d, pre, pre, r.choice(["ref", "fn", "caption", "boxed-text", "xref", "xref", "p"])])
            open_.append(pre)
        for i in open_:
            made[i][2] = 199
        data += [tuple(x) for x in made] + [tuple(x) for x in made if x[3] == "xref"][:5]
    names = {"ref": "reference", "fn": "footnote", "caption": "caption", "boxed-text": "sidebar"}
    want = set()
    for d, pre, _, tag in data:
        if tag == "xref":
            around = {t for d2, a, b, t in data if d2 == d and a < pre <= b}
            want.add((str(d), pre, next((names[t] for t in names if t in around), "body")))
    found = pages.contexts(spark.createDataFrame(data, "doc string, pre int, last int, tag string"), "doc")
    assert sorted((str(x["doc"]), x["pre"], x["context"]) for x in found.collect()) == sorted(want) and dict(found.dtypes)["pre"] == "int"
    plan = found._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert plan.count("Exchange hashpartitioning") <= 3 and "Join" not in plan
