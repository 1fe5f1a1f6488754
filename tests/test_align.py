"""Alignment of probes to lines, against a scan of all lines."""

from __future__ import annotations

import random
import re
import statistics

from vellumframe.operators import align
from vellumframe.sources import markup

LINES = "book string, ord long, page int, text string, size double, x0 double, y0 double, y1 double, page_w double, bold boolean, italic boolean, font string, color int, probe string, kind string"


def norm(text: str) -> str:
    return " ".join(re.findall(r"\w+", text.lower()))


def test_first_hits(spark):
    r = random.Random(1)
    stems = ["alpha beta gamma", "alpha beta gamma delta", "the common beginning of many lines that go on for long", "short", "tiny x", "The Common, beginning of many lines that go on for long and longer", "alpha beta"]
    make = lambda: r.choice(stems) + r.choice(["", ".", " more", " more words", f" {r.randint(0, 9)} and on and on until it is long enough"])
    lines = [("b", i, i // 30, make(), r.choice([10.0, 10.0, 12.0]), 50.0, 10.0 * i, 10.0 * i + 9, 600.0, r.random() < 0.5, False, r.choice(["ABCDEF+Body", "Head"]), r.choice([0, 7]), "x", "y") for i in range(300)] + [("c", 0, 0, "alpha beta gamma", 9.0, 0.0, 0.0, 1.0, 100.0, None, True, None, 0, "x", "y"), ("c", 1, 0, None, 9.0, 0.0, 0.0, 1.0, 100.0, None, True, None, 0, "x", "y")]
    probes = [("b", i, r.choice(["title", "p"]), make()) for i in range(200)] + [("c", 0, "title", "Alpha Beta Gamma, and more"), ("c", 1, "title", None), ("d", 0, "p", "alpha beta gamma")]
    want = {}
    for book, probe, kind, text in probes:
        k = norm(text or "")
        for l in lines:
            n = norm(l[3] or "")
            if l[0] == book and len(k) >= 6 and len(n) >= 6 and n[:24][:12] == k[:12] and (k.startswith(n[:40]) or n.startswith(k[:40])):
                want[book, probe] = l[1]
                break
    ldf, pdf = spark.createDataFrame(lines, LINES), spark.createDataFrame(probes, "book string, probe long, kind string, text string")
    found = align.matches(pdf, ldf, ["book"])
    assert {(x["book"], x["probe"]): x["ord"] for x in found.collect()} == want and found.count() == len(want)
    hits = [(b, p, k, want[b, p]) for b, p, k, _ in probes if (b, p) in want]
    for kind in ("title", "p"):
        own = [h for h in hits if h[0] == "b" and h[2] == kind][:20]
        sizes = [round(lines[o][4] / 10.0, 2) for *_, o in own]
        (got,) = [x for x in align.align(pdf, ldf, ["book"], 20).collect() if (x["book"], x["kind"]) == ("b", kind)]
        gaps = [round((lines[o][6] - lines[o - 1][7]) / 10.0, 2) for *_, o in own if o and lines[o - 1][2] == lines[o][2]]
        assert (got["matched"], got["size_ratio_median"], got["size_ratio_max"]) == (len(own), statistics.median(sizes), max(sizes))
        assert got["bold"] == round(sum(lines[o][9] for *_, o in own) / len(own), 2) and got["gap_before_median"] == (statistics.median(gaps) if gaps else None)
        assert got["colored"] == round(sum(lines[o][12] != 0 for *_, o in own) / len(own), 2) and set(got["fonts"]) <= {"Body", "Head"}


XML = """<book><book-part book-part-type="chapter"><book-part-meta><title-group><label>Chapter 1</label><title>The <i>whole</i> heart</title></title-group></book-part-meta><body>
<sec disp-level="2"><title>A section title</title><p>Words of a paragraph, <b>bold</b> too.</p><list list-type="bullet"><list-item><p>first item text</p><p>second one text</p></list-item></list>
<fig><label>Figure 1</label><caption><title>not a kind</title></caption></fig><table-wrap><label>Table 12</label><table><tr><th>head one</th><th>head two</th><th>x</th><th>head four</th></tr></table></table-wrap>
<boxed-text content-type="key"><caption><title>A box title</title></caption></boxed-text></sec><ref-list><ref><label>1</label> Somebody A. Title.</ref></ref-list><fn><p>note of a foot</p></fn>
<index><index-entry><term>angina pectoris</term><index-entry><term>chronic form</term></index-entry></index-entry></index></body></book-part></book>"""


def test_probes(spark):
    dom = markup.dom(spark.createDataFrame([("d", XML)], "doc string, xml string"), "doc", "xml", kind="xml")
    got = [(r["kind"], r["text"]) for r in align.xml_probes(dom, "doc").orderBy("probe").collect()]
    assert got == [
        ("chapter_label", "Chapter 1"), ("chapter_title", "The whole heart"), ("sec_level2", "A section title"), ("body_p", "Words of a paragraph, bold too."), ("list_item[bullet]", "first item text"), ("fig_label", "Figure 1"),
        ("table_label", "Table 12"), ("table_head_cell", "head one"), ("table_head_cell", "head two"), ("box_title[key]", "A box title"), ("reference", "1 Somebody A. Title."), ("footnote", "note of a foot"),
        ("index_entry_level0", "angina pectoris"), ("index_entry_level1", "chronic form"),
    ]
