"""Units, ownership, contents lists, metadata and the preview."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumframe.operators import units as U
from vellumframe.sources import markup, preview


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_pages_and_units(spark):
    files = spark.createDataFrame([("b", 0, 2), ("b", 1, 0), ("b", 2, 3)], "book_id string, file_idx int, pages int")
    assert sorted((r["file_idx"], r["file_page"], r["page"]) for r in rows(U.page_map(files))) == [(0, 0, 0), (0, 1, 1), (2, 0, 2), (2, 1, 3), (2, 2, 4)]
    lines = spark.createDataFrame([("b", p, n) for p in range(4) for n in range(3)], "book_id string, page int, line_no int")
    units = spark.createDataFrame([("b", 1, 0, 1, None, 0), ("b", 2, 1, 2, 1, None)], "book_id string, unit int, start_page int, end_page int, start_line int, end_line int")
    got = {(r["page"], r["line_no"]): r["unit"] for r in rows(U.unit_of(lines, units))}
    assert [got[(1, n)] for n in range(3)] == [1, 2, 2] and got[(0, 2)] == 1 and got[(2, 0)] == 2 and got[(3, 0)] is None


def test_owners(spark):
    claims = spark.createDataFrame([("b", "0:1", "z2", 2, 0), ("b", "0:1", "z1", 1, 5), ("b", "0:1", "z0", 1, 6)], "book_id string, uid string, zid string, stage int, seq int")
    assert [r["zid"] for r in rows(U.owners(claims))] == ["z1"]


def test_toc_and_outline(spark):
    targets = spark.createDataFrame([("b", "chapter_page", "1", "ch1", 0), ("b", "page", "1", "sec0", 0), ("b", "page", "1", "sec9", 1), ("b", "title", "the lung", "s1", 0), ("b", "title", "the lung", "s2", 1), ("b", "folio", "77", "page77", 0)], "book_id string, kind string, key string, target string, pos int")
    entries = spark.createDataFrame([("b", 0, "Chapter 1", "Heart", "1"), ("b", 1, None, "Heart", "1"), ("b", 2, None, "2. The Lung", "5"), ("b", 3, None, "x", "77"), ("b", 4, None, "x", None)], "book_id string, entry int, label string, title string, page string")
    assert [r["rid"] for r in rows(U.resolve_toc(entries, targets).orderBy("entry"))] == ["ch1", "sec0", "s2", "page77", None]
    outline = spark.createDataFrame([("b", 0, "The lung"), ("b", 1, "Heart"), ("c", 0, "The lung"), ("c", 1, "x"), ("c", 2, "y")], "book_id string, entry int, text string")
    secs = spark.createDataFrame([(b, t, f"{b}-{t}", i) for b in "bc" for i, t in enumerate(["The Lung", "1. Heart"])], "book_id string, title string, target string, pos int")
    assert [(r["book_id"], r["rid"]) for r in rows(U.resolve_outline(outline, secs).orderBy("book_id", "entry"))] == [("b", "b-The Lung"), ("b", "b-1. Heart"), ("c", None), ("c", None), ("c", None)]


def test_book_info(spark):
    found = spark.createDataFrame([("b", "title", "file_name", "x"), ("b", "title", "title_page", "Real"), ("b", "title", "override", " "), ("b", "isbn", "other", "9")], "book_id string, field string, source string, value string")
    assert {r["field"]: (r["value"], r["source"]) for r in rows(U.book_info(found))} == {"title": ("Real", "title_page"), "isbn": ("9", "other")}
    names = spark.createDataFrame([("Ana María de la Cruz",), ("the quick brown fox",), ("Page 12 Jones",), ("Smith",)], "t string").select(U.like_person(F.col("t")).alias("p"))
    assert [r["p"] for r in rows(names)] == [True, False, False, False]


def test_preview(spark):
    dom = markup.dom(spark.createDataFrame([("d", '<sec id="s"><title>T</title><p>a <xref rid="f">1</xref> &lt; <odd/></p></sec>')], "doc string, x string"), "doc", "x", "xml")
    assert rows(preview.html(dom, "doc"))[0]["html"] == '<!DOCTYPE html><html><body><section id="s"><h2>T</h2><p>a <a href="#f">1</a> &lt; <div class="odd"/></p></section></body></html>'
