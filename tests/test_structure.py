"""Structure, mining, zones and the XML sink on hand-made documents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vellumframe.operators import mining, structure, zones
from vellumframe.sources import markup, xml_out

LINE = "book_id string, page int, ord int, line_no int, col int, bbox struct<x0: double, y0: double, x1: double, y1: double>, text string, main_font string, main_size double, main_color int, all_bold boolean, all_italic boolean, role string, spans array<struct<text: string, sup: boolean>>"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def line(n, x0, y0, text, x1=350.0, page=0, size=10.0, font="Body", bold=False, sup=None):
    return ("b", page, n, n, 0, (float(x0), float(y0), float(x1), float(y0 + 10)), text, font, size, 0, bold, False, "body", ([(sup, True)] if sup else []) + [(text, False)])


def test_paragraphs(spark):
    data = [line(0, 50, 100, "A first line of text that runs"), line(1, 50, 112, "on to the end of it.", x1=200), line(2, 50, 124, "Next paragraph after a short line"), line(3, 50, 136, "goes on"), line(4, 65, 148, "An indented one"), line(5, 50, 160, "goes on here"), line(6, 50, 190, "After a gap"), line(7, 50, 202, "unfinished"), line(8, 50, 100, "continued on the next page", page=1), line(9, 50, 112, "HEAD", page=1, size=14.0)]
    data += [line(20 + k, 65, 300 + 12 * k, "indented filler") for k in range(2)]
    style = spark.createDataFrame([("b", 10.0, 12.0)], "book_id string, body_size double, pitch double")
    got = {r["ord"]: (r["new"], r["conf_new"], r["para"]) for r in rows(structure.paragraphs(spark.createDataFrame(data[:10], LINE), style))}
    assert [n for n, g in sorted(got.items()) if g[0]] == [0, 2, 4, 6, 9]
    assert got[2][1] == 0.8 and got[6][1] == 0.93 and got[9][1] == 0.85 and got[8] == (False, 0.9, 4)


def test_columns(spark):
    data = [line(2 * k, 50, 100 + 12 * k, "left column text", x1=180) for k in range(10)] + [line(2 * k + 1, 210, 100 + 12 * k, "right column text", x1=340) for k in range(10)]
    pages = spark.createDataFrame([("b", 0, (0.0, 0.0, 400.0, 600.0)), ("b", 1, (0.0, 0.0, 400.0, 600.0))], "book_id string, page int, trim struct<x0: double, y0: double, x1: double, y1: double>")
    got = rows(structure.columns(spark.createDataFrame(data, LINE), pages).orderBy("page", "col"))
    assert [(r["page"], r["col"]) for r in got] == [(0, 0), (0, 1), (1, 0)]
    assert 178 <= got[0]["x1"] <= 182 and 208 <= got[1]["x0"] <= 212 and (got[2]["x0"], got[2]["x1"]) == (0.0, 400.0)


def test_captions_and_footnotes(spark):
    data = [line(0, 50, 100, "running text"), line(1, 50, 130, "Figure 3.1 A heart", size=8.0, font="Cap"), line(2, 50, 141, "in two lines", size=8.0, font="Cap"), line(3, 50, 152, "Figure 3.2 Another", size=8.0, font="Cap"), line(4, 50, 190, "text"), line(5, 50, 196, "words", sup="1"), line(6, 50, 560, "1 A note", size=8.0), line(7, 50, 571, "that goes on", size=8.0), line(8, 50, 592, "9 no mark", size=8.0)]
    df = spark.createDataFrame(data, LINE)
    got = {r["line_no"]: r["caption"] for r in rows(structure.captions(df, spark.createDataFrame([("b", 12.0)], "book_id string, pitch double")))}
    assert got == {0: None, 1: 1, 2: 1, 3: 3, 4: None, 5: None, 6: None, 7: None, 8: None}
    pages = spark.createDataFrame([("b", 0, (0.0, 0.0, 400.0, 600.0))], "book_id string, page int, trim struct<x0: double, y0: double, x1: double, y1: double>")
    notes = rows(structure.footnotes(df, pages, spark.createDataFrame([("b", 10.0, 12.0)], "book_id string, body_size double, pitch double")))
    assert sorted((r["line_no"], r["label"]) for r in notes) == [(6, "1"), (7, "1")]


def test_heading_styles(spark):
    style = spark.createDataFrame([("b", "body", 10.0, 0)], "book_id string, body_family string, body_size double, body_color int")

    def learn(data):
        return {(r["size"], r["bold"]): (r["n"], r["level"]) for r in rows(structure.heading_styles(spark.createDataFrame(data, LINE), style))}

    plain = [line(k, 50, 0, f"Large head {'abcdefgh'[k]}", size=14.0, bold=True) for k in range(5)] + [line(10 + k, 50, 0, f"Small head {'abcdefgh'[k]}", bold=True) for k in range(6)] + [line(30 + k, 50, 0, "A bold sentence that ends.", size=11.0, bold=True) for k in range(6)]
    assert learn(plain) == {(14.0, True): (5, 1), (10.0, True): (6, 2)}
    schemes = [line(k, 50, 0, f"{'ABCDE'[k]}. Upper", size=12.0, bold=True) for k in range(5)] + [line(10 + k, 50, 0, f"{'I' * (k % 3 + 1)}. Roman", size=11.0, bold=True) for k in range(5)]
    assert learn(schemes) == {(12.0, True): (5, 2), (11.0, True): (5, 1)}


XML = """<book><book-part id="m-ch001" book-part-type="chapter"><body><sec id="m-ch001-sec001"><title>T</title>
<p id="m-ch001-p001">See <xref rid="m-ch001-fig001" ref-type="fig">Fig 1</xref>.</p><fig id="m-ch001-fig001"><label>Fig. 1</label></fig><p>between</p><p>x <xref rid="m-ch001-fig002" ref-type="fig">Fig 2</xref></p><p>one</p><p>two</p><fig id="m-ch001-fig002"><label>Fig. 2</label></fig>
<fig id="m-ch001-fig003"><label>Fig. 3</label></fig><p>late <xref rid="m-ch001-fig003" ref-type="fig">Fig 3</xref> <xref rid="gone" ref-type="fig">Fig 9</xref></p><p>inside <xref rid="m-ch001-fig004" ref-type="fig">4</xref><fig id="m-ch001-fig004"/></p><fig id="m-ch001-fig005"><label>Fig. 5</label></fig></sec></body></book-part></book>"""


@pytest.fixture(scope="module")
def dom(spark):
    return markup.dom(spark.createDataFrame([("d", XML)], "doc string, xml string"), "doc", "xml", "xml").cache()


def test_mining(spark, dom):
    assert {r["tag"]: r["n"] for r in rows(mining.elements(dom, "doc"))}["fig"] == 5
    shapes = {(r["tag"], r["shape"]): (r["n"], r["example"]) for r in rows(mining.id_shapes(dom, "doc"))}
    assert shapes[("fig", "{P}-ch{N3}-fig{N3}")] == (5, "m-ch001-fig001")
    assert {(r["link"], r["target"]): r["n"] for r in rows(mining.link_patterns(dom, "doc"))} == {("xref[fig]", "fig"): 4, ("xref[fig]", "<BROKEN>"): 1}
    found = {(r["metric"], r["value"]): r["n"] for r in rows(mining.structure(dom, "doc"))}
    assert found[("fig has label", "yes")] == 4 and found[("label shape", "fig: Fig. #")] == 4 and found[("book-part type", "chapter")] == 1
    assert {r["id"][-3:]: r["relation"] for r in rows(mining.placement(dom, "doc"))} == {"001": "immediately_after_citing_block", "002": "after_citing_block_+2blocks", "003": "before_first_citation", "004": "inside_citing_paragraph_end", "005": "no_citation"}
    assert [r["tags"] for r in rows(mining.profiles(dom, "doc"))] == [["textbook"]]
    values = {(r["tag"], r["attr"], r["value"]): r["n"] for r in rows(mining.attributes(dom))}
    assert values[("xref", "rid", "<value>")] == 5 and values[("xref", "ref-type", "fig")] == 5
    best = rows(mining.evidence(mining.structure(dom, "doc"), ["metric"], "value").where("metric = 'fig has label'"))[0]
    assert (best["pattern"], best["n"], best["total"], best["conflict"]) == ("yes", 4, 5, True)


def test_xml_out(spark, dom, tmp_path):
    (made,) = rows(xml_out.serialize(dom, "doc", "<!DOCTYPE book>"))
    assert made["xml"].split("\n", 2)[2] == XML.replace('rid="m-ch001-fig001" ref-type="fig"', 'ref-type="fig" rid="m-ch001-fig001"').replace('id="m-ch001" book-part-type="chapter"', 'book-part-type="chapter" id="m-ch001"').replace('rid="m-ch001-fig002" ref-type="fig"', 'ref-type="fig" rid="m-ch001-fig002"').replace('rid="m-ch001-fig003" ref-type="fig"', 'ref-type="fig" rid="m-ch001-fig003"').replace('rid="gone" ref-type="fig"', 'ref-type="fig" rid="gone"').replace('rid="m-ch001-fig004" ref-type="fig"', 'ref-type="fig" rid="m-ch001-fig004"')
    xml_out.write(dom, "doc", str(tmp_path / "out"))
    assert "".join(r["value"] for r in spark.read.option("wholetext", True).text(str(tmp_path / "out")).collect()).count("<fig") == 5
    odd = markup.dom(spark.createDataFrame([("d", '<a x="1&quot;&lt;&amp;">&lt;b&gt;<c/>t</a>')], "doc string, xml string"), "doc", "xml", "xml")
    assert rows(xml_out.serialize(odd, "doc"))[0]["xml"].endswith('<a x="1&quot;&lt;&amp;">&lt;b&gt;<c/>t</a>')


def test_zones(spark):
    own = spark.createDataFrame([("b", f"0:{i}", 0, i, z, k, lvl) for i, (z, k, lvl) in enumerate([("z1", "sec", 1), ("z2", "p", None), ("z2", "p", None), ("z3", "p", None), ("z4", "sec", 2)])], "book string, uid string, page int, ord int, zid string, kind string, level int")

    def state(df):
        return [(r["zid"], r["kind"], r["level"]) for r in rows(df.orderBy("ord"))]

    assert state(zones.retag(own, spark.createDataFrame([("b", "z3", "sec", 3)], "book string, zid string, new_kind string, new_level int")))[3] == ("z3", "sec", 3)
    assert [z for z, _, _ in state(zones.merge(own, spark.createDataFrame([("b", "z3", "z2")], "book string, zid string, into string")))] == ["z1", "z2", "z2", "z2", "z4"]
    cut = "book string, zid string, at_uid string, new_zid string"
    assert [z for z, _, _ in state(zones.split(own, spark.createDataFrame([("b", "z2", "0:2", "z9")], cut)))] == ["z1", "z2", "z9", "z3", "z4"]
    assert state(zones.split(own, spark.createDataFrame([("b", "z2", "0:1", "z9")], cut))) == state(own)
    less = zones.delete(own, spark.createDataFrame([("b", "z3")], "book string, zid string"))
    assert [r["uid"] for r in rows(zones.unowned(own.select("book", "uid"), less))] == ["0:3"]
    secs = spark.createDataFrame([("b", f"s{i}", i, lvl) for i, lvl in enumerate([1, 2, 3, 2, 1, 3])], "book string, zid string, ord int, level int")
    assert [r["parent"] for r in rows(zones.renest(secs).orderBy("ord"))] == [None, "s0", "s1", "s0", None, "s4"]
    boxed = spark.createDataFrame([("b", "z", 0, 0, (0.0, 0.0, 5.0, 10.0)), ("b", "z", 0, 1, (1.0, 12.0, 6.0, 22.0)), ("b", "z", 0, 2, (0.0, 90.0, 5.0, 100.0)), ("b", "z", 1, 3, (0.0, 0.0, 5.0, 10.0))], "book string, zid string, page int, ord int, bbox struct<x0: double, y0: double, x1: double, y1: double>")
    assert [(r["page"], r["x1"], r["y1"]) for r in rows(zones.boxes(boxed).orderBy("run"))] == [(0, 6.0, 22.0), (0, 5.0, 100.0), (1, 5.0, 10.0)]
    review = spark.createDataFrame([("z1", 1, ["x"], 0.9, False), ("z2", 0, [], 0.5, False), ("z3", 0, [], 0.9, False), ("z4", 0, ["x"], 0.1, True)], "zid string, page int, flags array<string>, conf double, reviewed boolean")
    assert [r["zid"] for r in rows(zones.flagged(review))] == ["z2", "z1"]
