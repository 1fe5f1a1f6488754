"""Lines from spans, against a walk over each page's fragments."""

from __future__ import annotations

import random
import re

from vellumframe.operators import lines

SPANS = "page long, frag int, span int, x0 double, y0 double, x1 double, y1 double, size double, sup boolean, text string, line string, band int"


def walk(spans: list[tuple]) -> list[tuple]:
    """(box, fragments, text) of each line of one page."""
    by_frag: dict = {}
    for frag, span, *rest in sorted(spans, key=lambda s: s[:2]):
        by_frag.setdefault(frag, []).append([frag, span, *rest])
    marker = re.compile(lines.MARKER)
    found: list[list] = []
    box = lambda g: (min(s[2] for s in g), min(s[3] for s in g), max(s[4] for s in g), max(s[5] for s in g))
    word = lambda g: "".join(s[8] for s in g)
    parts = [g for g in by_frag.values() if word(g).strip(" ")]
    for f in sorted(parts, key=lambda g: (round(box(g)[3]), box(g)[0], g[0][0])):
        b = box(f)
        for g in found[-6:]:
            a = box(g)
            size = max(s[6] for s in f + g)
            over = min(a[2], b[2]) - max(a[0], b[0])
            near = 3.5 if marker.search(word(g) if a[0] <= b[0] else word(f)) and abs(a[3] - b[3]) < 0.6 * size else 0.9
            if min(a[3], b[3]) - max(a[1], b[1]) >= 0.45 * min(a[3] - a[1], b[3] - b[1]) and -over < near * size and over <= 0.6 * size:
                g += f
                break
        else:
            found.append(list(f))
    out = []
    for g in found:
        g = sorted(g, key=lambda s: (s[2], s[0], s[1]))
        plain = [s for s in g if s[8].strip(" ") and not s[7]] or g[:1]
        main = max(plain, key=lambda s: len(s[8]))
        told = []
        for s in g:
            sup, sub = s[7], False
            if s is not main and s[8].strip(" "):
                if s[6] > main[6] * 0.8:
                    sup = False
                elif s[5] < main[5] - main[6] * 0.18:
                    sup = True
                elif s[3] > main[3] + main[6] * 0.3:
                    sup, sub = False, True
            told.append((s, sup or sub))
        text = ""
        for i, (s, script) in enumerate(told):
            if i:
                p, before = told[i - 1]
                need = 0.5 * main[6] if script or before else 0.22 * max(p[6], s[6])
                if s[2] - p[4] > need and not p[8].endswith(" ") and not s[8].startswith(" "):
                    text += " "
            text += s[8]
        out.append((box(g), len({s[0] for s in g}), text))
    return out


def test_against_walk(spark):
    r = random.Random(5)
    rows, pages = [], {}
    for page in range(120):
        n = 0
        for frag in range(r.randint(1, 40 if page % 9 else 200)):
            x, base, size = r.randint(0, 200) * 1.0, 12.0 * r.randint(1, 8) + r.choice([0, 0.25, 0.5, -0.5, 4]), r.choice([6.0, 10.0, 10.0, 12.0])
            for span in range(r.randint(1, 3)):
                w = r.choice([2.0, 9.0, 30.0])
                rows.append((page, frag, span, x, base - size, x + w, base, size, r.random() < 0.1, r.choice(["1.", "•", "ab", "word ", " so", " ", "", "(iv)", "x y"]), "l", 1))
                pages.setdefault(page, []).append(rows[-1][1:10])
                x += w + r.choice([0, 1.0, 4.0])
                n += 1
    got: dict = {}
    for x in lines.build(spark.createDataFrame(rows, SPANS), ["page"]).orderBy("page", "line").collect():
        got.setdefault(x["page"], []).append(((x["x0"], x["y0"], x["x1"], x["y1"]), x["n_frags"], x["text"]))
    # Bands are read from the top, each by itself; the walk reads by rounded bottoms, which is the same order of lines but for
    # those of overlapping heights, so lines are compared as sets.
    assert {p: sorted(x) for p, x in got.items()} == {p: sorted(w) for p, s in pages.items() if (w := walk(s))}


def test_scripts_and_odd_rows(spark):
    rows = [
        (1, 0, 0, 0.0, 90.0, 40.0, 100.0, 10.0, False, "Energy", "", 0), (1, 0, 1, 41.0, 88.0, 44.0, 94.0, 6.0, False, "2", "", 0), (1, 1, 0, 46.0, 96.0, 49.0, 102.0, 6.0, None, "n", "", 0),
        (1, 2, 0, 300.0, 90.0, 340.0, 100.0, 10.0, False, "far", "", 0), (1, 3, 0, 0.0, None, 5.0, 9.0, 1.0, False, "no box", "", 0), (2, 0, 0, 0.0, 0.0, 5.0, 9.0, 1.0, False, None, "", 0),
        (None, 0, 0, 0.0, 0.0, 5.0, 9.0, 9.0, False, "null page", "", 0),
    ]
    df = spark.createDataFrame(rows, SPANS)
    got = {(r["page"], r["line"]): (r["text"], [(s["sup"], s["sub"]) for s in r["spans"]]) for r in lines.build(df, ["page"]).collect()}
    assert got == {(1, 0): ("Energy2n", [(False, False), (True, False), (False, True)]), (1, 1): ("far", [(False, False)]), (None, 0): ("null page", [(False, False)])}
    assert lines.build(df.limit(0), ["page"]).count() == 0
