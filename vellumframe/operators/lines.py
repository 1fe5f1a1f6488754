"""Lines from a page's spans: fragments that stand side by side are joined, scripts are told by geometry, gaps become spaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How many groups a fragment looks back to; shares of heights and sizes by which it joins one; list markers, which
#: stand further apart from their text; sizes and offsets of scripts; gaps that are spaces.
LOOK_BACK, OVERLAP, NEAR, MARKER_NEAR, SAME_BASE, OVER = 6, 0.45, 0.9, 3.5, 0.6, 0.6
MARKER = r"^\s*(?:[•●■□▪◆◇◦○‣∙·►▶✓✔➢➤❑❖–—]|\(?[0-9]{1,3}[.)]|\(?[A-Za-z][.)]|\(?[ivxIVX]{1,4}[.)])\s*$"
SMALL, RAISED, LOWERED, GAP, SCRIPT_GAP = 0.8, 0.18, 0.3, 0.22, 0.5
BOX = ("x0", "y0", "x1", "y1")


def _joins(group: Column, f: Column) -> Column:
    """Whether a fragment stands beside a group: they overlap in height, and the gap between them is small."""
    size = F.greatest(group["size"], f["size"])
    height = F.least(group["y1"] - group["y0"], f["y1"] - f["y0"])
    over = F.least(group["x1"], f["x1"]) - F.greatest(group["x0"], f["x0"])
    left = F.when(group["x0"] <= f["x0"], group["text"]).otherwise(f["text"])
    marked = left.rlike(MARKER) & (F.abs(group["y1"] - f["y1"]) < SAME_BASE * size)
    tall = F.least(group["y1"], f["y1"]) - F.greatest(group["y0"], f["y0"]) >= OVERLAP * height
    return tall & (-over < F.when(marked, MARKER_NEAR * size).otherwise(NEAR * size)) & (over <= OVER * size)


def _with(group: Column, f: Column) -> Column:
    low, high = (lambda n: F.least(group[n], f[n]).alias(n)), (lambda n: F.greatest(group[n], f[n]).alias(n))
    return F.struct(low("x0"), low("y0"), high("x1"), high("y1"), high("size"), F.concat(group["text"], f["text"]).alias("text"), F.concat(group["members"], f["members"]).alias("members"))


def bands(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """fragments (keys, box, ...) with band: stretches of a page's height that no other fragment reaches into, numbered from the
    top. Fragments of two bands never overlap in height, nor do their rounded bottoms, by which they are read, interleave. So
    bands can be read apart, each from its own fragments."""
    base = F.bround("y1")
    rows = fragments.withColumn("_low", F.least("y0", base)).withColumn("_high", F.greatest("y1", base))
    page = Window.partitionBy(*keys).orderBy("_low", "_high").rowsBetween(Window.unboundedPreceding, -1)  # a page is a sheet of paper
    rows = rows.withColumn("_new", F.coalesce(F.col("_low") > F.max("_high").over(page), F.lit(False)).cast("long"))
    return rows.withColumn("band", F.sum("_new").over(Window.partitionBy(*keys).orderBy("_low", "_high"))).drop("_low", "_high", "_new")


def fragments(spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frag, box, size, text, members: the spans of each fragment that shows something, in order."""
    rows = spans.groupBy(*keys, "frag").agg(
        *[F.min(c).alias(c) for c in BOX[:2]], *[F.max(c).alias(c) for c in BOX[2:]], F.max("size").alias("size"),
        F.array_sort(F.collect_list(F.struct("span", *BOX, "size", "sup", "text"))).alias("_spans"),
    )
    rows = rows.withColumn("text", F.array_join(F.transform("_spans", lambda s: s["text"]), ""))
    member = lambda s: F.struct(F.col("frag").alias("frag"), *[s[c].alias(c) for c in ("span", *BOX, "size", "sup", "text")])
    return rows.where(F.trim("text") != "").withColumn("members", F.transform("_spans", member)).drop("_spans")


def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, band, place, group: the lines of each band in the order in which they begin. Fragments come by rounded bottom and left
    edge; each joins the oldest of the last LOOK_BACK lines of its band that it stands beside, or begins one.

    What a fragment joins depends on what the ones before it have joined, so a band is folded; a band is a printed line or a few."""
    part = F.struct(F.bround("y1").alias("at"), "x0", "frag", "y0", "x1", "y1", "size", "text", "members")
    held = rows.groupBy(*keys, "band").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    shape = "array<struct<x0:double,y0:double,x1:double,y1:double,size:double,text:string,members:array<struct<frag:bigint,span:bigint,x0:double,y0:double,x1:double,y1:double,size:double,sup:boolean,text:string>>>>"

    def step(lines: Column, f: Column) -> Column:
        own = F.struct(*[f[c].alias(c) for c in (*BOX, "size", "text", "members")])
        n = F.size(lines)
        recent = F.sequence(F.greatest(n - LOOK_BACK, F.lit(0)), n)  # the last is beyond the lines
        found = F.filter(recent, lambda i: (i < n) & _joins(F.get(lines, i), f))
        put = lambda at: F.when(at.isNull(), F.array_append(lines, own)).otherwise(
            F.concat(F.slice(lines, F.lit(1), at), F.array(_with(F.get(lines, at), own)), F.slice(lines, at + 2, F.greatest(n - at - 1, F.lit(0))))
        )
        return F.get(F.transform(F.array(F.get(found, F.lit(0))), put), F.lit(0))

    folded = held.select(*keys, "band", F.aggregate("parts", F.array().cast(shape), step).alias("lines"))
    return folded.select(*keys, "band", F.posexplode("lines").alias("place", "group"))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finished(spans: Column) -> Column:
    """The spans of a line from left to right, with sup, sub and text: scripts by their size and height against the longest
    span that shows something and is no script, and a space before a span that stands apart from the one before."""
    shown = lambda s: F.trim(s["text"]) != ""

    def main(all_: Column) -> Column:
        plain = F.filter(all_, lambda s: shown(s) & ~s["sup"])
        longer = lambda a, s: F.when(F.length(s["text"]) > F.length(a["text"]), s).otherwise(a)
        return F.when(F.size(plain) > 0, F.aggregate(plain, F.get(plain, F.lit(0)), longer)).otherwise(F.get(all_, F.lit(0)))

    def scripts(all_: Column, m: Column) -> Column:
        def told(s: Column) -> Column:
            small = s["size"] <= SMALL * m["size"]
            up, down = small & (s["y1"] < m["y1"] - RAISED * m["size"]), small & (s["y0"] > m["y0"] + LOWERED * m["size"])
            same = ((s["frag"] == m["frag"]) & (s["span"] == m["span"])) | ~shown(s)
            sup = F.when(same, s["sup"]).when(up, True).when(down | ~small, False).otherwise(s["sup"])
            return F.struct(*[s[c].alias(c) for c in ("frag", "span", *BOX, "size", "text")], sup.alias("sup"), (~same & ~up & down).alias("sub"), m["size"].alias("main"))

        return F.transform(all_, told)

    def spaced(all_: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            def text(p: Column) -> Column:
                script = s["sup"] | s["sub"] | p["sup"] | p["sub"]
                need = F.when(script, SCRIPT_GAP * s["main"]).otherwise(GAP * F.greatest(p["size"], s["size"]))
                apart = (s["x0"] - p["x1"] > need) & ~F.endswith(p["text"], F.lit(" ")) & ~F.startswith(s["text"], F.lit(" "))
                return F.when(F.coalesce(apart, F.lit(False)), F.concat(F.lit(" "), s["text"])).otherwise(s["text"])

            before = F.when(i > 0, F.get(all_, i - 1))
            return F.struct(*[s[c].alias(c) for c in ("frag", "span", *BOX, "size", "sup", "sub")], _let(before, text).alias("text"))

        return F.transform(all_, one)

    in_order = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["x0"].alias("at"), s.alias("s")))), lambda x: x["s"])
    return _let(in_order, lambda all_: _let(_let(main(all_), lambda m: scripts(all_, m)), spaced))


def build(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of pages: keys, line (from 0, in the order in which they begin), box, n_frags, text, spans.

    spans: keys, frag, span (numbers of the fragment and of the span in it), x0 .. y1, size, sup, text. Fragments without a
    character that shows are left out; null texts are empty and null sup is false. Boxes without a size, and pages without
    spans, give no lines. One exchange, by page."""
    d = lambda c: F.col(c).cast("double").alias(c)
    rows = spans.select(*keys, F.col("frag").cast("long").alias("frag"), F.col("span").cast("long").alias("span"), *[d(c) for c in (*BOX, "size")], F.coalesce("sup", F.lit(False)).alias("sup"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where(" and ".join(f"{c} is not null" for c in (*BOX, "size")))
    made = grouped(bands(fragments(rows, keys), keys), keys).select(*keys, "band", "place", F.col("group.*"))
    order = Window.partitionBy(*keys).orderBy("band", "place")
    made = made.withColumn("spans", finished(F.col("members"))).withColumn("line", F.row_number().over(order) - 1)
    return made.select(*keys, "line", *BOX, F.size(F.array_distinct(F.transform("members", lambda s: s["frag"]))).alias("n_frags"), F.array_join(F.transform("spans", lambda s: s["text"]), "").alias("text"), "spans")
