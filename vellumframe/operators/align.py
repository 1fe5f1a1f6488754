"""Alignment: texts that markup knows the kind of are found among a layout's lines, and the lines show what the kind looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumframe.functions import text as T
from vellumframe.operators import ordered, tree
from vellumframe.operators.validate import texts

#: The beginning by which texts meet, what is compared of it, the least of a text, hits that a kind needs at most,
#: the share of capitals from which a line is in capitals, head cells of a table that count, and fonts named for a kind.
BLOCK, COMPARED, LEAST, PER_KIND, CAPITALS, HEAD_CELLS, FONTS = 12, 40, 6, 400, 0.85, 3, 3


def key(text: Column) -> Column:
    """The words of a text, joined by one space: what texts are compared by."""
    return F.array_join(T.words(F.coalesce(text, F.lit(""))), " ")


def _beginnings(text: Column) -> Column:
    """All beginnings of a text from BLOCK characters on, itself included."""
    n = F.length(text)
    return F.when(n <= BLOCK, F.array(text)).otherwise(F.transform(F.sequence(F.lit(BLOCK), n), lambda i: F.substr(text, F.lit(1), i.cast("int"))))


def matches(probes: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """probes (keys, probe, kind, text) that a line (keys, ord, text) stands for, with ord: the first line whose beginning (of
    COMPARED characters) begins the probe's, or is begun by it. Both have LEAST characters, and agree in the first BLOCK.

    Both ways are joins by equality: a line's beginning meets all beginnings of probes, a probe's all beginnings of lines. Each
    beginning is kept once, with its first line, before anything is joined, so lines that begin alike by the million, and
    probes too, cost no product."""
    cut = lambda df: df.withColumn("_key", F.substring(key(F.col("text")), 1, COMPARED)).where(F.length("_key") >= LEAST)
    asked = cut(probes)
    first = cut(lines).groupBy(*keys, "_key").agg(F.min("ord").alias("ord"))
    wanted = asked.select(*keys, "_key").distinct()
    of = [F.col(k).alias(f"_p_{k}") for k in keys]
    same = lambda a, b: tree.same(keys, "_p_") & (F.col(a) == F.col(b))
    short = wanted.select(*of, F.col("_key").alias("_probe"), F.explode(_beginnings(F.col("_key"))).alias("_begin"))
    begun = first.join(short, same("_key", "_begin")).select(*keys, "_probe", "ord")
    # An equal text has been met above; here the line is the longer one.
    longer = first.select(*keys, F.explode(_beginnings(F.col("_key"))).alias("_begin"), "ord").groupBy(*keys, "_begin").agg(F.min("ord").alias("ord"))
    begins = longer.join(wanted.select(*of, F.col("_key").alias("_probe")), same("_begin", "_probe")).select(*keys, "_probe", "ord")
    hit = begun.unionByName(begins).groupBy(*keys, "_probe").agg(F.min("ord").alias("ord")).select(*of, "_probe", "ord")
    return asked.join(hit, same("_key", "_probe")).select(*probes.columns, "ord")


def firsts(found: DataFrame, keys: list[str], most: int = PER_KIND) -> DataFrame:
    """The first `most` hits of each kind, by probe: more don't change what a kind looks like. Numbered over buckets."""
    return ordered.numbered(found, [*keys, "kind"], "probe", "_n").where(F.col("_n") < most).drop("_n")


def features(found: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """found with what its line looks like: size_ratio (to the size of most characters), bold, italic, all_caps, gap_before (to the
    line before on its page), x0_rel, font, color. lines: keys, ord, page, text, size, x0, y0, y1, page_w, bold, italic, font, color."""
    sizes = lines.groupBy(*keys, "size").agg(F.sum(F.length("text")).alias("_n"), F.min("ord").alias("_first"))
    body = sizes.groupBy(*keys).agg(F.max_by("size", F.struct("_n", -F.col("_first"))).alias("_body")).select(*[F.col(k).alias(f"_p_{k}") for k in keys], "_body")
    placed = ordered.running_before(lines.withColumn("_end", F.struct("ord", "page", "y1")), keys, "ord", "_end", "_before", "last")
    placed = placed.join(body, tree.same(keys, "_p_")).drop(*[f"_p_{k}" for k in keys])
    gap = F.when(F.col("_before.page").eqNullSafe(F.col("page")) & F.col("_before").isNotNull(), F.round((F.col("y0") - F.col("_before.y1")) / F.col("_body"), 2))
    shown = placed.select(
        *[F.col(k).alias(f"_p_{k}") for k in keys], F.col("ord").alias("_ord"), F.round(F.col("size") / F.col("_body"), 2).alias("size_ratio"), "bold", "italic",
        (T.caps_ratio(F.col("text")) > CAPITALS).alias("all_caps"), gap.alias("gap_before"), F.round(F.col("x0") / F.col("page_w"), 3).alias("x0_rel"), T.clean_font(F.col("font")).alias("font"), "color",
    )
    return found.join(shown, tree.same(keys, "_p_") & (F.col("ord") == F.col("_ord"))).drop("_ord", *[f"_p_{k}" for k in keys])


def signatures(shown: DataFrame, keys: list[str]) -> DataFrame:
    """keys, kind: matched, size_ratio_median, its range, shares of bold, italic, all_caps and coloured lines, gap_before_median,
    and the fonts of most lines. Medians are exact, from counted values."""
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 2)
    by = [*keys, "kind"]
    out = shown.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matched"), F.percentile("size_ratio", 0.5).alias("size_ratio_median"), F.min("size_ratio").alias("size_ratio_min"), F.max("size_ratio").alias("size_ratio_max"),
        share(F.col("bold")).alias("bold"), share(F.col("italic")).alias("italic"), share(F.col("all_caps")).alias("all_caps"), F.percentile("gap_before", 0.5).alias("gap_before_median"), share(F.col("color") != 0).alias("colored"),
    )
    counted = shown.groupBy(*by, "font").agg(F.count(F.lit(1)).alias("_n"), F.min("probe").alias("_first"))
    best = counted.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("n"), F.col("_first").alias("first"), "font"))), 1, FONTS).alias("_f"))  # fonts of a kind
    fonts = best.select(*[F.col(k).alias(f"_p_{k}") for k in by], F.transform("_f", lambda x: x["font"]).alias("fonts"))
    return out.join(fonts, tree.same(by, "_p_")).drop(*[f"_p_{k}" for k in by])


def align(probes: DataFrame, lines: DataFrame, keys: list[str], most: int | None = PER_KIND) -> DataFrame:
    """signatures of the kinds of probes, from the lines that stand for them. most: hits of a kind that count, all if None."""
    found = matches(probes, lines, keys)
    return signatures(features(found if most is None else firsts(found, keys, most), lines, keys), keys)


def xml_probes(dom: DataFrame, doc: str) -> DataFrame:
    """doc, probe, kind, text: texts of a golden document by kind, of LEAST characters and more. probe is their place (pre), by which
    those of a kind stand in order.

    Titles and labels of parts, titles of sections by level, labels of figures and tables, the first head cells of tables,
    titles of boxes, first paragraphs of list items, references, paragraphs of sections, index terms by depth, footnotes. Of
    elements that a kind takes once for each holder, the first counts."""
    d = F.col(doc)
    above = dom.select(d.alias("_ad"), F.col("pre").alias("_ap"), F.col("tag").alias("_at"), F.col("attrs").alias("_aa"), F.col("parent").alias("_app"))

    def holder(rows: DataFrame, at: str, name: str) -> DataFrame:
        x = above.select("_ad", "_ap", F.struct(F.col("_ap").alias("pre"), F.col("_at").alias("tag"), F.col("_aa").alias("attrs"), F.col("_app").alias("parent")).alias(name))
        return rows.join(x, (d == F.col("_ad")) & (F.col(at) == F.col("_ap")), "left").drop("_ad", "_ap")

    rows = dom.where(F.col("tag").isin("title", "label", "p", "ref", "fn", "term"))
    rows = holder(holder(holder(rows, "parent", "h1"), "h1.parent", "h2"), "h2.parent", "h3")
    tag, h1, h2, h3 = F.col("tag"), F.col("h1"), F.col("h2"), F.col("h3")
    of = lambda h, name, none: F.coalesce(F.element_at(h["attrs"], name), F.lit(none))
    in_part = (h1["tag"] == "title-group") & (h2["tag"] == "book-part-meta") & (h3["tag"] == "book-part")
    kind = (
        F.when(tag.isin("title", "label") & in_part, F.concat(of(h3, "book-part-type", "part"), F.lit("_"), tag))
        .when((tag == "title") & (h1["tag"] == "sec"), F.concat(F.lit("sec_level"), of(h1, "disp-level", "?")))
        .when((tag == "label") & (h1["tag"] == "fig"), "fig_label").when((tag == "label") & (h1["tag"] == "table-wrap"), "table_label")
        .when((tag == "title") & (h1["tag"] == "caption") & (h2["tag"] == "boxed-text"), F.concat(F.lit("box_title["), of(h2, "content-type", "None"), F.lit("]")))
        .when((tag == "p") & (h1["tag"] == "list-item"), F.concat(F.lit("list_item["), of(h2, "list-type", "None"), F.lit("]")))
        .when((tag == "p") & (h1["tag"] == "sec"), "body_p").when(tag == "ref", "reference").when(tag == "fn", "footnote")
        .when((tag == "term") & (h1["tag"] == "index-entry"), "index_entry_level")
    )
    named = rows.withColumn("kind", kind).where("kind is not null").select(doc, "pre", "parent", "kind", h1["pre"].alias("_holder"))
    many = F.col("kind").isin("body_p", "reference", "footnote")
    once = named.where(~many).groupBy(doc, "kind", F.col("_holder").alias("parent")).agg(F.min("pre").alias("pre"))
    found = named.where(many).select(doc, "pre", "kind").unionByName(once.select(doc, "pre", "kind"))
    entries = dom.where("tag = 'index-entry'")
    terms = tree.around(found.where("kind = 'index_entry_level'"), entries, [doc], "_depth")
    terms = terms.select(doc, "pre", F.concat("kind", (F.col("_depth") - 1).cast("string")).alias("kind"))
    cells = tree.within(dom.where("tag = 'table-wrap'"), dom.where("tag = 'th'"), [doc])
    cells = ordered.numbered(cells, [doc, "outer_pre"], "inner_pre", "_n").where(F.col("_n") < HEAD_CELLS).select(doc, F.col("inner_pre").alias("pre"), F.lit("table_head_cell").alias("kind"))
    found = found.where("kind <> 'index_entry_level'").unionByName(terms).unionByName(cells).select(d.alias("_fd"), F.col("pre").alias("probe"), "kind")
    all_ = texts(dom, doc, "title", "label", "p", "ref", "fn", "term", "th")
    met = found.join(all_.select(doc, "pre", "text"), (F.col("_fd") == d) & (F.col("probe") == F.col("pre")))
    return met.select(doc, "probe", "kind", T.squeeze(F.col("text")).alias("text")).where(F.length(key(F.col("text"))) >= LEAST)
