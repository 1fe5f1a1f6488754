"""Operators against brute force and hand-made documents."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vellumframe.functions import text as T
from vellumframe.operators import bags, batch, islands, layout, links, modes, ordered, references, tree, validate, words
from vellumframe.sources import markup, page_json
from vellumframe.streaming import ingest


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_sums_before_and_numbers(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), k, rng.randrange(9)) for k in rng.sample(range(-5000, 1 << 40), 300)] + [(None, 5, 1), (None, 7, 2)]
    df = spark.createDataFrame(data, "k string, o long, v long")
    got = {(r["k"], r["o"]): r["s"] for r in rows(ordered.sums_before(df, ["k"], "o", "v", "s"))}
    assert got == {(k, o): sum(v2 for k2, o2, v2 in data if k2 == k and o2 < o) for k, o, _ in data}
    numbers = {(r["k"], r["o"]): r["n"] for r in rows(ordered.numbered(df, ["k"], "o", "n"))}
    assert numbers == {(k, o): sum(k2 == k and o2 < o for k2, o2, _ in data) for k, o, _ in data}


def test_counts_near(spark):
    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.randrange(60)) for _ in range(300)]
    got = {(r["k"], r["p"]): (r["n"], r["near"]) for r in rows(ordered.counts_near(spark.createDataFrame(data, "k string, p long"), ["k"], "p", 5, "near", block=16))}
    assert got == {x: (data.count(x), sum(k == x[0] and abs(p - x[1]) <= 5 for k, p in data)) for x in set(data)}


def test_modes(spark):
    df = spark.createDataFrame([("a", "x", 1.0, 0), ("a", "y", 1.0, 1), ("a", "z", 0.5, 2), ("b", "q", 2.0, 3)], "k string, v string, w double, o long")
    assert {r["k"]: (r["mode"], r["weight"]) for r in rows(modes.weighted_mode(df, ["k"], "v", F.col("w"), F.col("o")))} == {"a": ("x", 1.0), "b": ("q", 2.0)}
    values = spark.createDataFrame([(1, v) for v in (10, 11, 12, 13)] + [(2, v) for v in (5, 5, 5)] + [(3, v) for v in range(20)], "k int, v int")
    assert {r["k"]: r["m"] for r in rows(modes.upper_median(values, ["k"], "v", "m"))} == {1: 12, 2: 5, 3: 10}
    assert {r["k"]: r["m"] for r in rows(modes.right_edge(values, ["k"], "v", "m"))} == {1: 12, 2: 5, 3: 17}
    assert [(r["v"], r["rank"]) for r in sorted(rows(modes.top_counts(df, ["k"], "v", 2, F.col("o"))), key=lambda r: (r["k"], r["rank"]))] == [("x", 1), ("y", 2), ("q", 1)]


def test_bags(spark):
    left = bags.bag(spark.createDataFrame([(0, w) for w in "aab"] + [(1, w) for w in "bb"], "d long, w string"), ["d"], "w")
    right = bags.bag(spark.createDataFrame([(w,) for w in "abb"], "w string"), [], "w")
    assert {r["d"]: (r["words"], r["matched"]) for r in rows(bags.claimed(left, right, "d", "w"))} == {0: (3, 2), 1: (2, 1)}
    assert {r["d"]: (r["words"], r["matched"]) for r in rows(bags.overlap(left, right, ["d"], "w"))} == {0: (3, 2), 1: (2, 2)}


def test_claims_against_a_counter(spark):
    rng = random.Random(3)
    docs = [(d, rng.choice("abcdef")) for d in range(30) for _ in range(rng.randrange(9))]
    bag = Counter(rng.choice("abcdz") for _ in range(40))
    left = bags.bag(spark.createDataFrame(docs, "d long, w string"), ["d"], "w")
    got = {r["d"]: r["matched"] for r in rows(bags.claimed(left, spark.createDataFrame(list(bag.items()), "w string, n long"), "d", "w"))}
    rest, want = Counter(bag), defaultdict(int)
    for d, w in sorted(docs):
        want[d] += rest[w] > 0
        rest[w] -= rest[w] > 0
    assert got == dict(want)


def test_scoped_lookup(spark):
    targets = spark.createDataFrame([("fig", "ch001", "1-1", "A", 0), ("fig", "ch002", "2-1", "B", 1), ("fig", "ch003", "2-1", "C", 2)], "kind string, scope string, key string, target string, pos int")
    asks = spark.createDataFrame([("fig", "ch001", "1-1"), ("fig", "ch009", "1-1"), ("fig", "ch009", "2-1")], "kind string, scope string, key string")
    assert {(r["scope"], r["key"]): r["found"] for r in rows(links.scoped_lookup(asks, targets))} == {("ch001", "1-1"): "A", ("ch009", "1-1"): "A", ("ch009", "2-1"): None}


def test_resolve(spark):
    targets = spark.createDataFrame([("fig", "c1", "1-1", "F1", 0), ("fig", "c1", "1", "F2", 1), ("fig", "c1", "3", "F3", 2), ("table", "c1", "2", "T", 3), ("box", "c2", "4", "B", 4), ("bibr", "c1", "7", "R", 5), ("fn", "c1", "8", "N", 6), ("bibr-ay", "c1", "smith|2010", "S", 7)], "kind string, scope string, key string, target string, pos int")
    asks = [("fig", "c1", "1-1"), ("fig", "c1", "1-3"), ("table-or-box", "c1", "2"), ("table-or-box", "c1", "4"), ("bibr-paren", "c2", "7"), ("bibr-paren", "c1", "7"), ("bibr", "c2", "7-9"), ("bibr-or-fn", "c1", "8"), ("bibr-or-fn", "c1", "99"), ("fig", "c1", "77"), ("bibr-ay", "c1", "Smith|2010"), ("strange", "c1", "1")]
    df = spark.createDataFrame([(i, *a) for i, a in enumerate(asks)], "cite_id int, kind string, scope string, key string")
    got = {r["cite_id"]: (r["rid"], r["severity"]) for r in rows(references.resolve(df, targets))}
    assert [got[i][0] for i in range(len(asks))] == ["F1", "F2", "T", "B", None, "R", "R", "N", None, None, "S", None]
    assert got[9][1] == "warning" and got[8][1] is None and got[4][1] is None and got[0][1] is None


def test_place(spark):
    floats = spark.createDataFrame([("b", 10, 12, "c1", "fig", "1"), ("b", 20, 22, "c1", "fig", "2"), ("b", 30, 31, "c1", "table", "3"), ("b", 40, 41, "c1", "fig", "9")], "book string, pre int, last int, part string, kind string, key string")
    cites = spark.createDataFrame([("b", "c1", 11, 0, 11, 11, False, "fig", "1", "body"), ("b", "c1", 5, 0, 5, 6, False, "fig", "1", "caption"), ("b", "c1", 8, 1, 7, 9, False, "fig", "1", "body"), ("b", "c1", 8, 0, 7, 9, False, "fig", "2", "body"), ("b", "c1", 3, 0, 3, 3, True, "table-or-box", "3", "sidebar"), ("b", "c2", 3, 0, 3, 3, False, "fig", "9", "body")], "book string, part string, pre int, seq int, block int, block_last int, in_list boolean, kind string, key string, ctx string")
    got = {r["pre"]: (r["anchor"], r["where"], r["slot"], r["status"]) for r in rows(references.place(floats, cites))}
    assert got == {10: (7, "after", 0, "PLACED"), 20: (7, "after", 1, "PLACED"), 30: (3, "list-item", None, "PLACED"), 40: (None, "physical", None, "NO_FIRST_CITATION")}


def test_assign_ids(spark):
    df = spark.createDataFrame([("b", "ch001", 1, "fig", 1), ("b", "ch001", 2, "fig", 3), ("b", "ch001", 3, "fig", 3), ("b", "ch002", 1, "fig", 5), ("b", "ch002", 2, "fig", None), ("b", "ch002", 3, "fig", 2)], "book string, part string, pre int, code string, number int")
    got = {(r["part"], r["pre"]): (r["xml_number"], r["collision"]) for r in rows(references.assign_ids(df))}
    assert got == {("ch001", 1): (1, False), ("ch001", 2): (3, False), ("ch001", 3): (4, True), ("ch002", 1): (1, False), ("ch002", 2): (2, False), ("ch002", 3): (3, False)}


def test_islands(spark):
    df = spark.createDataFrame([(1, x, i) for i, x in enumerate([0.0, 1.0, 2.0, 9.0, 10.0, 30.0])], "k int, x double, o int")
    assert [(r["start"], r["end"], r["n"]) for r in sorted(rows(islands.merged(df, ["k"], "x", 3.0, ["o"])), key=lambda r: r["run"])] == [(0.0, 2.0, 3), (9.0, 10.0, 2), (30.0, 30.0, 1)]
    spans = spark.createDataFrame([(1, 0, 4), (1, 2, 10), (1, 12, 14), (1, 30, 31), (1, 3, 5)], "k int, a int, b int")
    assert [(r["gap_start"], r["gap_end"]) for r in rows(islands.gutters(spans, ["k"], "a", "b", 6))] == [(14, 30)]


def test_hyphens(spark):
    lines = spark.createDataFrame([("conversion and well known",), ("well known well known well",), ("known known",), ("long-term view",), ("long-term care-",)], "text string")
    lexicon = words.lexicon(lines)
    counted = {(r["word"], r["compound"]): r["n"] for r in rows(lexicon)}
    assert counted[("long-term", True)] == 2 and counted[("long", False)] == 2 and counted[("care", False)] == 1
    pairs = spark.createDataFrame([("conver", "sion"), ("well", "known"), ("long", "term"), ("Jean", "Paul"), ("ab", "1x"), ("un", "heard")], "left string, right string")
    assert {(r["left"], r["right"]): r["joined"] for r in rows(words.joins(pairs, lexicon))} == {("conver", "sion"): True, ("well", "known"): False, ("long", "term"): False, ("Jean", "Paul"): False, ("ab", "1x"): False, ("un", "heard"): True}


XML = """<book><book-part id="x-ch001"><book-part-meta><book-part-id>1</book-part-id></book-part-meta><body>
<sec id="x-ch001-sec001"><title>A <i>first</i> title</title><p id="x-ch001-p001">a<i>b</i>c <xref ref-type="fig" rid="x-ch001-fig001">Fig 1</xref> <xref ref-type="fig" rid="nowhere">Fig 9</xref></p>
<fig id="x-ch001-fig001"><label>Figure 1-1</label><graphic/></fig><fig id="x-ch001-fig001"><label>Figure 1-2</label></fig><table-wrap id="bad id" specific-use="inline"><label>Table 1</label></table-wrap>
<p id="odd"/><xref ref-type="table" rid="x-ch001-p001">Table 1</xref></sec></body></book-part><book-part id="x-ch002"/></book>"""


def xml_dom(spark, *texts):
    return markup.dom(spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc string, xml string"), "doc", "xml", "xml")


def test_xml_keeps_mixed_content(spark):
    dom = xml_dom(spark, "<p>a<i>b</i>c</p>", "<p>not closed", None, "")
    assert [(r["tag"], r["text"], r["tail"], r["pre"], r["last"], r["parent"]) for r in sorted(rows(dom.where("doc = 'd0'")), key=lambda r: r["pre"])] == [("p", "a", "", 0, 1, None), ("i", "b", "c", 1, 1, 0)]
    assert [(r["doc"], r["tag"]) for r in rows(dom.where("doc <> 'd0'"))] == [("d1", "#error")]
    assert {r["pre"]: r["text"] for r in rows(validate.texts(xml_dom(spark, "<r><p>a<i>b<b>c</b>d</i>e</p>f</r>"), "doc", "p"))} == {1: "abcde"}


def test_html_soup():
    found = markup.html_rows('<!DOCTYPE html><html><head><script>var t="</p>";</script></head><body><p><b>bold<br><p>next</p><ul><li>1<li>2</ul></body></html>')
    tags = [(r["tag"], r["depth"]) for r in found]
    assert ("script", 2) in tags and tags.count(("li", 3)) == 2 or [t for t, _ in tags].count("li") == 2
    assert all(r["parent"] is None or found[r["parent"]]["pre"] < r["pre"] <= found[r["parent"]]["last"] for r in found)


def test_validators(spark):
    dom = xml_dom(spark, XML).cache()
    assert sorted((r["id"], r["defect"]) for r in rows(validate.ids(dom, "doc", "x"))) == [("bad id", "invalid"), ("odd", "pattern"), ("x-ch001-fig001", "duplicate")]
    assert sorted((r["rid"], r["status"]) for r in rows(validate.links(dom, "doc"))) == [("nowhere", "broken"), ("x-ch001-fig001", "valid"), ("x-ch001-p001", "wrong_type")]
    assert [r["id"] for r in rows(validate.unlinked(dom, "doc"))] == ["bad id"]
    assert sorted((r["id"], r["issue"]) for r in rows(validate.structure(dom, "doc"))) == [("bad id", "neither table nor graphic"), ("odd", "empty paragraph"), ("x-ch001-fig001", "no graphic"), ("x-ch002", "lacks book-part-id")]
    (counted,) = rows(validate.counts(dom, "doc"))
    assert counted["p"] == 2 and counted["fig"] == 2 and counted["xref"] == 3
    allowed = spark.createDataFrame([("book", "book-part"), ("book-part", "body")], "parent string, child string")
    assert ("body", "sec") in {(r["parent_tag"], r["child_tag"]) for r in rows(validate.disallowed(dom, "doc", allowed))}
    ancestors = tree.nearest_ancestor(dom.where("tag = 'i'"), dom.where("tag in ('sec', 'title', 'p')"), ["doc"])
    assert sorted(r["ancestor"] for r in rows(ancestors)) == sorted(r["parent"] for r in rows(dom.where("tag = 'i'")))


def test_compare(spark):
    golden = xml_dom(spark, XML)
    same = {r["what"]: (r["recall"], r["precision"]) for r in rows(validate.compare(golden, golden, "doc"))}
    assert same["words"] == (1.0, 1.0) and same["figures"] == (1.0, 1.0) and same["index terms"] == (0.0, 0.0)
    other = validate.compare(golden, xml_dom(spark, XML.replace("Figure 1-2", "Figure 7").replace(" title", " heading")), "doc")
    got = {r["what"]: (r["recall"], r["precision"]) for r in rows(other)}
    assert got["figures"] == (0.5, 0.5) and got["section titles"] == (0.0, 0.0) and 0.7 < got["words"][0] < 1
    assert rows(validate.score(other))[0]["score"] == pytest.approx(sum([got["words"][0], got["words"][1], *got["section titles"], *(got[n][0] for n in ("paragraph starts", "figures", "tables", "references", "index terms"))]) / 9)


def test_coverage(spark):
    bag = spark.createDataFrame([("a", 1), ("b", 2)], "word string, n long")
    lines = spark.createDataFrame([(0, 0, "body", "a a b"), (1, 0, "body", "b"), (1, 1, "header", "b b"), (1, 2, "body", "b")], "page long, line_no int, role string, text string")
    got = {r["page"]: (r["words"], r["matched"]) for r in rows(validate.coverage(validate.page_words(lines.where("not (page = 1 and line_no = 2)")), bag))}
    assert got == {0: (3, 2), 1: (1, 1)}


def test_page_words_carry(spark):
    lines = [(0, 0, "a conver-"), (0, 1, "sion of in-"), (0, 2, "ter-"), (0, 3, "est"), (0, 4, "end-"), (1, 0, "next"), (1, 1, ""), (1, 2, "co-"), (1, 3, ""), (1, 4, "op 3-"), (1, 5, "4")]
    df = spark.createDataFrame([(p, n, "body", t) for p, n, t in lines], "page long, line_no int, role string, text string")
    got = Counter({(r["page"], r["word"]): r["n"] for r in rows(validate.page_words(df))})
    assert got == Counter([(0, "a"), (0, "conversion"), (0, "of"), (0, "interest"), (0, "end"), (1, "next"), (1, "coop"), (1, "3"), (1, "4")])


def test_gate(spark):
    base = {"dtd_errors": 0, "duplicate_ids": 0, "invalid_ids": 0, "broken_links": 0, "wrong_links": 0, "missing_images": 0, "coverage": 1.0, "failed_pages": 0, "errors": 0, "warnings": 0, "pattern_ids": 0}
    cases = [base, base | {"warnings": 1}, base | {"errors": 1}, base | {"coverage": 0.96}]
    df = spark.createDataFrame([tuple(c.values()) for c in cases], ", ".join(f"{k} {'double' if k == 'coverage' else 'int'}" for k in base))
    assert [r["status"] for r in rows(validate.gate(df))] == ["PASS", "PASS WITH WARNINGS", "FAILED", "FAILED"]


def test_batch(spark):
    state = spark.createDataFrame([("a", 1, "RUNNING", "h"), ("a", 2, "FAILED", "h"), ("b", 1, "PASS", "old"), ("c", 1, "RUNNING", "h")], "book string, version int, status string, input_hash string")
    inputs = spark.createDataFrame([(b, "h") for b in "abcd"], "book string, input_hash string")
    assert sorted(r["book"] for r in rows(batch.pending(inputs, state))) == ["b", "c", "d"]
    assert [r["book"] for r in rows(batch.interrupted(state))] == ["c"]


def page(number, lines, trim=(0, 0, 400, 600), pdf="b.pdf"):
    made = [{"b": list(b), "r": role, "c": 0.9, "o": False, "s": [[t, font, size, False, False, False, False, False, False, 0, list(b)] for t in ([text] if isinstance(text, str) else text)]} for text, b, font, size, role in lines]
    return {"v": "1", "pdf": pdf, "pdf_page": number, "w": 400, "h": 600, "trim": list(trim), "rot": 0, "ocr": False, "errors": [], "images": [{"bbox": [0, 0, 400, 400], "xref": 1, "w": 10, "h": 10, "full": [0, 0, 1, 1], "std": 2.0}] if number == 5 else [], "drawings": [], "lines": made}


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    """Ten pages: a running head that names the page, a folio, body lines of 10 points 12 apart; page 3 lacks its folio,
    page 6 has a wrong one."""
    pages = []
    for n in range(10):
        lines = [(f"Chapter {n} of all", (50, 10, 300, 20), "Head", 8.0, "body")]
        lines += [(f"body line {k} of page {n} with words", (50, 100 + 12 * k, 350, 110 + 12 * k), "Body-Roman", 10.0, "body") for k in range(8)]
        if n != 3:
            lines.append((str(99 if n == 6 else n + 12), (200, 580, 210, 590), "Body-Roman", 9.0, "body"))
        if n == 2:
            lines.append(("Figure 1 a caption", (50, 12, 300, 22), "Head", 8.0, "body"))
        pages.append(page(n, lines))
    path = tmp_path_factory.mktemp("pages") / "book.jsonl"
    path.write_text("\n".join(map(json.dumps, pages)) + "\n{broken\n")
    return page_json.read(spark, str(path)).cache()


def test_page_json(spark, book):
    lines = page_json.lines(book.where("_corrupt_record is null"))
    assert lines.count() == 100 and page_json.pages(book).count() == 10 and page_json.failures(book).count() == 1
    (first,) = rows(lines.where("page = 0 and line_no = 1"))
    assert (first["text"], first["main_font"], first["main_size"], first["all_bold"], first["uid"]) == ("body line 0 of page 0 with words", "Body-Roman", 10.0, False, "0:1")
    assert page_json.images(book).count() == 1
    kinds = {r["page"]: r["kind"] for r in rows(page_json.needs_ocr(page_json.pages(book), lines, page_json.images(book)))}
    assert set(kinds.values()) == {"text"}


def test_layout(spark, book):
    book = book.where("_corrupt_record is null")
    lines, pages = page_json.lines(book), page_json.pages(book)
    style = layout.body_style(page_json.spans(lines))
    assert [(r["body_family"], r["body_size"]) for r in rows(style)] == [("body", 10.0)]
    assert rows(layout.line_pitch(lines, style.select("book_id", "body_size")))[0]["pitch"] == 12.0
    marked = layout.running_heads(lines, pages).cache()
    roles = Counter(r["role"] for r in rows(marked))
    assert roles == {"header": 10, "folio": 9, "body": 81}
    got = {r["page"]: (r["folio"], r["conf"]) for r in rows(layout.folios(marked, pages))}
    assert [got[n][0] for n in range(10)] == [str(n + 12) for n in range(10)]
    assert got[3][1] == 0.7 and got[6][1] == 0.6


def test_folio_fixture(spark, tmp_path):
    folios = [None, "12", "13", "99", "15"]
    pages = [page(n, [("text", (50, 300, 100, 310), "F", 10.0, "body")] + ([(f, (200, 580, 210, 590), "F", 9.0, "folio")] if f else [])) for n, f in enumerate(folios)]
    path = tmp_path / "f.jsonl"
    path.write_text("\n".join(map(json.dumps, pages)))
    df = page_json.read(spark, str(path))
    got = {r["page"]: (r["folio"], r["conf"]) for r in rows(layout.folios(page_json.lines(df), page_json.pages(df)))}
    assert got == {0: ("11", 0.7), 1: ("12", 0.9), 2: ("13", 0.9), 3: ("14", 0.6), 4: ("15", 0.9)}


def test_streaming(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(source)
    stream = ingest.files(spark, source, "id long")
    ingest.upsert(stream, out, str(tmp_path / "state"), lambda b: b.withColumn("twice", F.col("id") * 2)).awaitTermination()
    assert spark.read.parquet(out).agg(F.sum("twice")).first()[0] == 90
    spark.range(10, 12).write.mode("append").parquet(source)
    ingest.upsert(ingest.files(spark, source, "id long"), out, str(tmp_path / "state"), lambda b: b.withColumn("twice", F.col("id") * 2)).awaitTermination()
    assert spark.read.parquet(out).count() == 12


def test_fold_table(spark):
    import unicodedata

    sample = "ÀÉîõüçñŠžőďạệøß"
    got = spark.createDataFrame([(sample,)], "x string").select(T.fold(F.col("x")).alias("y")).first()["y"]
    assert got == "".join(c for c in unicodedata.normalize("NFKD", sample) if not unicodedata.combining(c))
