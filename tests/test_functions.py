"""Scalar functions and parsers on the cases that their rules name."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from vellumframe.functions import parsers as P
from vellumframe.functions import text as T
from vellumframe.operators import layout
from vellumframe.sources import inventory


def apply(spark, fn, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", fn(F.col("x")).alias("y")).collect()
    return [r["y"] for r in sorted(rows, key=lambda r: r["i"])]


def test_number_key(spark):
    given = ["3.7", "3–7", "3 -7", "3-72A", "3-7a", "A-1", None]
    want = ["3-7", "3-7", "3-7", "3-72", "3-7", "A-1", None]
    assert apply(spark, T.number_key, given) == want
    assert [P.number_key(x) for x in given[:-1]] == want[:-1]


def test_normalisers(spark):
    assert apply(spark, T.norm_repeat, ["Chapter IV  12", "Civil il", "éil i.v", "", None]) == ["chapter # #", "# #", "éil #.#", "", None]
    assert apply(spark, T.norm_title, ["1.2. Método Ágil", "iv) Über­sicht", "A. Ärzte — Øre"]) == ["metodo agil", "ubersicht", "arzte re"]
    assert apply(spark, T.collapse_spaced, ["T A B L A", "a b", "T A BL"]) == ["TABLA", "a b", "T A BL"]
    assert apply(spark, T.family, ["ABCDEF+Times-Bold", "Arial,Italic", None]) == ["times", "arial", ""]
    assert apply(spark, T.caps_ratio, ["ABcd", "12", "ÉÀ"]) == [0.5, 0.0, 1.0]
    assert apply(spark, T.words, ["Él_1 co­op 中文!"]) == [["él_1", "coop", "中文"]]


def test_romans(spark):
    numbers = list(range(1, 4000, 37)) + [4, 9, 14, 40, 90, 400, 900, 3999]
    made = apply(spark, T.to_roman, numbers, "int")
    assert made[-1] == "mmmcmxcix" and made[-6] == "xiv"
    assert apply(spark, T.roman_value, made) == numbers
    assert apply(spark, T.is_roman, ["xiv", "XIV", "iiii", "", "abc"]) == [True, True, False, False, False]


def test_id_shapes(spark):
    rows = spark.createDataFrame([("martin-ch003-fig007", "martin"), ("x12", None), ("page9", "zz")], "v string, p string").select(T.id_shape(F.col("v"), F.col("p")).alias("s")).collect()
    assert [r["s"] for r in rows] == ["{P}-ch{N3}-fig{N3}", "x{N2}", "page{N1}"]


def test_markers(spark):
    given = ["• a", "1) a", "i. a", "ii. a", "I. a", "– a", "•a", "–a", "a", "12.5 a", "(3) b", "B) c"]
    got = apply(spark, T.marker, given)
    assert [g and g["type"] for g in got] == ["bullet", "number", "alpha-lower", "roman-lower", "alpha-upper", "simple", "bullet", None, None, None, "number", "alpha-upper"]
    assert got[1]["rest"] == "a" and got[10]["marker"] == "(3)"
    rows = spark.createDataFrame([("number", "(3)"), ("alpha-lower", "c)"), ("roman-lower", "xii."), ("bullet", "•")], "t string, m string").select(T.ordinal(F.col("t"), F.col("m")).alias("o")).collect()
    assert [r["o"] for r in rows] == [3, 3, 12, None]


def test_index_pages(spark):
    got = apply(spark, T.page_tokens, ["123–25f", "105b", "xii", "x–y"])
    assert [[tuple(x) for x in g] for g in got] == [[("123", "", "start-of-range"), ("125", "f", "end-of-range")], [("105", "b", None)], [("xii", "", None)], []]

def test_boxes_and_keys(spark):
    assert apply(spark, T.box_type, ["Caso clínico", "Warning!", "Other", "Una guía", None]) == ["case-study", "alert", "sidebar", "guideline", "sidebar"]
    assert apply(spark, T.author_year, ["Smith J. Title. 2010;3:1", "no year", "Álvarez-Gil. 1999b"]) == ["smith|2010", None, "álvarez-gil|1999b"]
    got = apply(spark, layout.label, ["Figure 3.7 A heart", "TABLA 2 Datos", "Cuadro 1-1", "Figures are fun", "text"])
    assert [g and g["kind"] for g in got] == ["fig", "table", "box", None, None] and got[0]["number"].startswith("3.7")


def test_language(spark):
    from test_language_whole import languages

    texts = ["the cat is in the house and the dog is out of it", "短い", None, "Это предложение написано по-русски", "Đây là một câu tiếng Việt được viết ở đây", "der Hund und die Katze sind nicht in dem Haus"]
    found = languages(spark, texts)
    assert found[:3] == [("en", 0.62), (None, 0.0), (None, 0.0)] and [x for x, _ in found[3:]] == ["ru", "vi", "de"]


def test_language_column(spark):
    from test_language_whole import languages

    text = "el perro y el gato están en la casa de la abuela"
    assert [x for x, _ in languages(spark, [text, None])] == ["es", None]
    assert apply(spark, lambda x: T.language(x)["lang"], [text, "short", None]) == ["es", None, None]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see Figs. 3-1, 3-4 and 3-6.", [("fig", "3-1", "Figs. 3-1"), ("fig", "3-4", "3-4"), ("fig", "3-6", "3-6")]),
        ("Figuras 3-1 a 3-4", [("fig", "3-1", "Figuras 3-1 a 3-4")]),
        ("Chapters 1-3", [("chapter", "1-3", "Chapters 1-3")]),
        ("tabla 2 y cuadro 4", [("table", "2", "tabla 2"), ("table-or-box", "4", "cuadro 4")]),
        ("Appendix A", [("app", "A", "Appendix A")]),
        ("known [1, 3] or (4) not f(5)", [("bibr", "1", "1"), ("bibr", "3", "3"), ("bibr-paren", "4", "4")]),
        ("fig. técnica 1.4.3", [("fig", "T1-4-3", "fig. técnica 1.4.3")]),
        ("nothing here", []),
    ],
)
def test_citations(text, want):
    assert [(k, key, text[a:b]) for k, key, a, b in P.citations(text)] == want


def test_citation_styles():
    assert [c[:2] for c in P.citations("12,14", frozenset({"sup"}))] == [("bibr-or-fn", "12"), ("bibr-or-fn", "14")]
    assert [c[:2] for c in P.citations("*", frozenset({"sup"}))] == [("fn", "*")]
    text = "as shown (Smith et al., 2010, 2012a; Díaz 1999)"
    assert [(c[1], text[c[2] : c[3]]) for c in P.citations(text, author_year=True)] == [("Smith|2010", "Smith et al., 2010"), ("Smith|2012a", "2012a"), ("Díaz|1999", "Díaz 1999")]


REFERENCES = [
    ("Hanks SK, Hunter T. The kinase superfamily. FASEB J. 1995;9(8):576-96.", "journal", {"surname": "Hanks", "year": "1995", "volume": "9", "issue": "8", "fpage": "576", "lpage": "96"}),
    ("Benner, P., & Wrubel, J. (1989). The primacy of caring. Nursing Today, 12(3), 45-60.", "journal", {"surname": "Benner", "year": "1989", "volume": "12"}),
    ("Porter R. The greatest benefit. 2nd ed. London: HarperCollins; 1997.", "book", {"publisher-loc": "London", "publisher-name": "HarperCollins", "year": "1997"}),
    ("See https://example.org/x for more.", "web", {"uri": "https://example.org/x"}),
    ("A note without any form", "other", {}),
]


@pytest.mark.parametrize(("text", "kind", "fields"), REFERENCES)
def test_references(text, kind, fields):
    got, segments = P.reference(text)
    assert got == kind and "".join(t for _, t in segments) == text
    found = {}
    for k, t in segments:
        found.setdefault(k, t)
    assert {k: found.get(k) for k in fields} == fields


def test_reference_columns(spark):
    rows = apply(spark, P.reference_segments, [r[0] for r in REFERENCES])
    assert ["".join(s["text"] for s in r) for r in rows] == [r[0] for r in REFERENCES]
    assert P.is_reference_heading("R E F E R E N C E S") and P.is_reference_heading("Bibliografía:") and not P.is_reference_heading("Referring")


def test_mathml():
    assert P.mathml("v = k [E]") == "<mrow><mi>v</mi><mo>=</mo><mi>k</mi><mo>[</mo><mi>E</mi><mo>]</mo></mrow>"
    assert P.mathml("x^2") == "<mrow><msup><mi>x</mi><mn>2</mn></msup></mrow>"
    assert P.linear_math("a+b <c") == "a + b < c"


def test_sql_functions(spark):
    P.register(spark)
    (r,) = spark.sql("select vf_language('the cat is in the house and the dog is out of it') l, vf_citations('Fig. 1')[0].key k, vf_mathml('a=1') m, vf_reference_type('see www.a.b') t").collect()
    assert (r["l"], r["k"], r["t"]) == ("en", "1", "web") and "<mo>=</mo>" in r["m"]


def test_file_parts(spark):
    got = apply(spark, inventory.part_code, ["Book_ch-12", "Book-index", "Book_GLOSS", "Book", "a_sect03", "x-fm", "Book_ch01_app-B"])
    assert [tuple(g) for g in got] == [("ch", "12"), ("index", None), ("gloss", None), ("whole", None), ("sec", "03"), ("fm", None), ("app", "B")]


def test_inventory(spark, tmp_path):
    isbn = "9781234567890"
    for name in (f"split/{isbn}_fm.pdf", f"split/{isbn}_ch01.pdf", f"split/{isbn}_ch02.pdf", "single/a.pdf", "single/b.pdf", f"x/{isbn}.xml", "x/9780000000001.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    files = inventory.files(spark, str(tmp_path))
    assert files.count() == 7
    books = {r["book"].rsplit("/", 1)[-1]: r["kind"] for r in inventory.books(files.where("path like '%.pdf'")).collect()}
    assert books == {"split": "folder", "a.pdf": "file", "b.pdf": "file", "9780000000001.pdf": "file"}
    order = [r["path"].rsplit("_", 1)[-1] for r in inventory.parts(files.where("path like '%split%'")).orderBy("file_idx").collect()]
    assert order == ["fm.pdf", "ch01.pdf", "ch02.pdf"]
    assert {r["isbn"]: r["status"] for r in inventory.samples(files).collect()} == {isbn: "matched", "9780000000001": "pdf_only"}
    assert {r["ext"]: r["n"] for r in inventory.kinds(files).collect()} == {".pdf": 6, ".xml": 1}
    before = inventory.signature(files).first()["signature"]
    (tmp_path / "x/new.pdf").write_bytes(b"1")
    assert inventory.signature(inventory.files(spark, str(tmp_path))).first()["signature"] != before
    head = apply(spark, inventory.xml_head, ['<?xml version="1.0"?>\n<!DOCTYPE book PUBLIC "-//X" "b.dtd"><book/>'])[0]
    assert tuple(head) == ("-//X", "b.dtd", "book")
