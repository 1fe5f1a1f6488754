"""Runs from files to verdicts, rule tables and settings."""

from __future__ import annotations

import json

from vellumframe.plans import runs
from vellumframe.sources import dtd, markup
from vellumframe.sources.config import Config, merged

GOOD = '<book><book-part id="m-ch001"><body><sec id="m-sec001"><p id="m-ch001-p001">a <xref rid="m-ch001-fig001" ref-type="fig">F</xref></p><fig id="m-ch001-fig001"/></sec></body></book-part></book>'


def test_corpus_runs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, text in {"a.xml": GOOD, "b.xml": GOOD, "c.xml": GOOD.replace('rid="m-ch001-fig001"', 'rid="gone"'), "d.xml": "<open>"}.items():
        (tmp_path / "in" / name).write_text(text)
    dom = runs.read_markup(spark, str(tmp_path / "in")).cache()
    verdicts = {r["doc"].rsplit("/", 1)[-1]: (r["status"], r["critical"]) for r in runs.check(dom, "m").collect()}
    assert verdicts == {"a.xml": ("PASS WITH WARNINGS", []), "c.xml": ("FAILED", ["broken links"]), "d.xml": ("FAILED", ["DTD invalid"])}
    # What wasn't measured is a finding; what was counts.
    docs = [r["doc"] for r in dom.select("doc").distinct().collect()]
    first = [d for d in docs if d.endswith("a.xml")]
    assert {tuple(r["unmeasured"]) for r in runs.check(dom, "m").collect()} == {("coverage not measured", "pages not measured")}
    measured = {
        "coverage": spark.createDataFrame([(d, 0.99) for d in first], "doc string, coverage double"), "pages": spark.createDataFrame([(d, i, s) for d in docs for i, s in ((0, "PASS"), (1, "PASS" if d in first else "FAIL"))], "doc string, page int, status string"),
    }
    told = {r["doc"].rsplit("/", 1)[-1]: (r["status"], r["critical"], r["unmeasured"]) for r in runs.check(dom, "m", **measured).collect()}
    assert told["a.xml"] == ("PASS", [], []) and told["c.xml"] == ("FAILED", ["broken links", "failed pages"], ["coverage not measured"])
    seen = markup.dom(spark.createDataFrame([("d", '<r id="m-ch001"><graphic href="img/a.png"/><graphic href="b.png"/></r>')], "doc string, x string"), "doc", "x", "xml")
    files = spark.createDataFrame([("d", "x/a.png"), ("e", "b.png")], "doc string, name string")
    (r,) = runs.check(seen, "m", images=files).collect()
    assert r["missing_images"] == 1 and "invalid image references" in r["critical"] and runs.check(seen, "m").first()["unmeasured"] == ["coverage not measured", "images not measured", "pages not measured"]
    paths = runs.analyze(dom.where("tag <> '#error'"), str(tmp_path / "out"))
    assert {r["tag"]: r["docs"] for r in spark.read.parquet(paths["elements"]).collect()}["fig"] == 2
    assert spark.read.parquet(paths["placement"]).count() == 2


def test_dtd(spark):
    text = """<!-- x --><!ENTITY % inline "i | b"><!ELEMENT p (#PCDATA | %inline;)*><!ELEMENT sec (title?, p+)><!ELEMENT br EMPTY>
    <!ATTLIST sec id ID #REQUIRED kind (a | b) "a"><!ATTLIST p id ID #IMPLIED>"""
    elements, children, attributes = dtd.parse(text)
    assert elements == [("p", "(#PCDATA | i | b)*", True), ("sec", "(title?, p+)", False), ("br", "EMPTY", False)]
    assert children == [("p", "i"), ("p", "b"), ("sec", "title"), ("sec", "p")]
    assert ("sec", "id", "ID", True) in attributes and ("p", "id", "ID", False) in attributes
    _, _, rules = dtd.tables(spark, text)
    dom = markup.dom(spark.createDataFrame([("d", '<r><sec id="1"/><sec/></r>')], "doc string, x string"), "doc", "x", "xml")
    assert [(r["pre"], r["attribute"]) for r in dtd.missing_attributes(dom, "doc", rules).collect()] == [(2, "id")]


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"qa": {"content_coverage_min": 0.5}, "new": 1}))
    config = Config.load(str(path), {"layout": {"window": 3}})
    assert (config.get("qa.content_coverage_min"), config.get("qa.page_coverage_warn"), config.get("layout.window"), config.get("a.b", 7)) == (0.5, 0.9, 3, 7)
    before = config.fingerprint()
    config.set("x.y", 1)
    assert config.get("x.y") == 1 and config.fingerprint() != before and len(before) == 12
    assert merged({"a": {"b": 1}}, {"a": {"c": 2}}) == {"a": {"b": 1, "c": 2}}
