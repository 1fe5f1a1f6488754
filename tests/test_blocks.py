"""The block machine on a made-up chapter."""

from __future__ import annotations

from vellumframe.operators import blocks as B


def item(text, kind="line", x0=50.0, level=None, starts=False, list_type=None, marker=None, math=False, region=None, page=0):
    return {"kind": kind, "text": text, "page": page, "x0": x0, "level": level, "starts": starts, "list_type": list_type, "marker": marker, "math": math, "region": region}


ITEMS = [
    item("One", level=1, starts=True), item("Two", level=2, starts=True), item("first line", starts=True), item("Figure 1", kind="region", region="fig"), item("goes on"), item("13", kind="page"), item("after the break", page=1),
    item("alpha", list_type="number", marker="1.", x0=50.0), item("hangs", x0=60.0), item("inner", list_type="bullet", marker="•", x0=70.0), item("beta", list_type="number", marker="2.", x0=50.0), item("a = b", math=True),
    item("Side", kind="region", region="box"), item("plain", starts=True), item("Back", level=1, starts=True), item("References", level=2, starts=True), item("Smith J.", starts=True), item("Title. 2010."), item("Lee K.", starts=True), item("End", level=1, starts=True), item("last", starts=True), item("14", kind="page"),
]


def show(nodes):
    return [(n[2], n[5], nodes[n[1]][5] or nodes[n[1]][2] if n[1] is not None else None) for n in nodes]


WANT = [
    ("sec", "One", None), ("sec", "Two", "One"), ("p", "first line goes on[[13]] after the break", "Two"), ("fig", "Figure 1", "Two"), ("list", "", "Two"), ("list-item", "", "list"), ("p", "alpha hangs", "list-item"), ("list", "", "list-item"), ("list-item", "", "list"),
    ("p", "inner", "list-item"), ("list-item", "", "list"), ("p", "beta", "list-item"), ("disp-formula", "a = b", "Two"), ("boxed-text", "Side", "Two"), ("p", "plain", "Two"), ("sec", "Back", None), ("ref-list", "References", "Back"), ("ref", "Smith J. Title. 2010.", "References"), ("ref", "Lee K.", "References"), ("sec", "End", None), ("p", "last[[14]]", "End"),
]


def test_machine():
    assert show(B.blocks(ITEMS, 10.0)) == WANT


def test_units(spark):
    data = [("b", 1, i, x["kind"], x["text"], x["page"], x["x0"], x["level"], x["starts"], x["list_type"], x["marker"], x["math"], x["region"]) for i, x in enumerate(ITEMS)]
    df = spark.createDataFrame(data + [("b", 2, 0, "line", None, 0, 1.0, 1, True, None, None, False, None)], "book_id string, unit int, ord int, kind string, text string, page int, x0 double, level int, starts boolean, list_type string, marker string, math boolean, region string")
    got = [[r[c] for c in ("node", "parent", "kind", "level", "label", "text", "page")] for r in B.parse(df, 10.0).where("unit = 1").orderBy("node").collect()]
    assert show(got) == WANT
    assert B.parse(df, 10.0).where("unit = 2").first()["kind"] == "#UNIT_FAILED"
