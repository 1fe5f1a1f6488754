"""Conventions mined from a corpus of markup: inventories, shapes, links, structure, placement, and their evidence.

All take dom tables of many documents; what a document adds is counted before anything is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumframe.functions import text as T
from vellumframe.operators import modes, tree

#: Elements that float, blocks, and what holds blocks.
FLOATS = ["fig", "table-wrap", "fig-group", "boxed-text"]
HOLDERS = ["sec", "body", "named-book-part-body", "boxed-text", "app", "ack"]
PARTS = ["sec", "book-part"]
NAVIGATION = ["toc", "toc-entry", "index", "index-entry", "nav-pointer-group"]


def attr(name: str):
    return F.element_at("attrs", name)


def elements(dom: DataFrame, doc: str) -> DataFrame:
    """tag, n, docs."""
    return dom.groupBy("tag", doc).agg(F.count(F.lit(1)).alias("m")).groupBy("tag").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("docs"))


def attributes(dom: DataFrame, longest: int = 60) -> DataFrame:
    """tag, attr, value, n: ids, references and long values are masked."""
    rows = dom.select("tag", F.explode("attrs").alias("attr", "v"))
    value = F.when(F.col("attr").isin("id", "rid", "href") | (F.length("v") > longest), "<value>").otherwise(F.col("v"))
    return rows.groupBy("tag", "attr", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def with_parent(dom: DataFrame, doc: str) -> DataFrame:
    """dom with parent_tag."""
    above = dom.select(F.col(doc).alias("_doc"), F.col("pre").alias("_pre"), F.col("tag").alias("parent_tag"))
    return dom.join(above, (F.col(doc) == F.col("_doc")) & (F.col("parent") == F.col("_pre")), "left").drop("_doc", "_pre")


def id_shapes(dom: DataFrame, doc: str) -> DataFrame:
    """tag, shape, n, example: ids with the document's most frequent prefix and the widths of numbers in place of both.
    The example is the first in order."""
    rows = dom.select(doc, "pre", "tag", attr("id").alias("id")).where("id is not null")
    prefix = modes.weighted_mode(rows.withColumn("p", T.id_prefix(F.col("id"))).where("p is not null"), [doc], "p", F.lit(1).cast("long"), F.col("pre").cast("long")).select(F.col(doc).alias("_doc"), "mode")
    met = rows.join(prefix, F.col(doc) == F.col("_doc"), "left")
    return met.groupBy("tag", T.id_shape(F.col("id"), F.col("mode")).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min_by("id", F.struct(doc, "pre")).alias("example"))


def link_patterns(dom: DataFrame, doc: str) -> DataFrame:
    """link, target, n: what elements references of each type name, <BROKEN> where nothing has the id."""
    targets = dom.select(F.col(doc).alias("_doc"), attr("id").alias("_id"), "pre", F.when(F.col("tag") == "target", F.concat(F.lit("target["), F.coalesce(attr("target-type"), F.lit("")), F.lit("]"))).otherwise(F.col("tag")).alias("t")).where("_id is not null").groupBy("_doc", "_id").agg(F.max_by("t", "pre").alias("target"))
    rows = dom.where("tag in ('xref', 'nav-pointer', 'answer', 'question')").select(doc, F.concat("tag", F.lit("["), F.coalesce(attr("ref-type"), attr("specific-use"), F.lit("")), F.lit("]")).alias("link"), attr("rid").alias("rid")).where("rid is not null")
    met = rows.join(targets, (F.col(doc) == F.col("_doc")) & (F.col("rid") == F.col("_id")), "left")
    return met.groupBy("link", F.coalesce("target", F.lit("<BROKEN>")).alias("target")).agg(F.count(F.lit(1)).alias("n"))


def external_links(dom: DataFrame, doc: str) -> DataFrame:
    """link, kind, n of ext-link elements: internal, uri or unresolved."""
    ids = dom.select(F.col(doc).alias("_doc"), attr("id").alias("_id")).where("_id is not null").distinct()
    rows = dom.where("tag = 'ext-link'").select(doc, F.concat(F.lit("ext-link["), F.coalesce(attr("ext-link-type"), F.lit("")), F.lit("]")).alias("link"), F.coalesce(attr("href"), F.lit("")).alias("href"))
    met = rows.join(ids, (F.col(doc) == F.col("_doc")) & (F.col("href") == F.col("_id")), "left")
    kind = F.when(F.col("_id").isNotNull(), "internal").when(F.contains("href", F.lit("://")) | F.startswith("href", F.lit("www")), "uri").otherwise("unresolved")
    return met.groupBy("link", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def structure(dom: DataFrame, doc: str) -> DataFrame:
    """metric, value, n: what parts, sections, lists, tables, figures, references and index entries are like."""
    kids = dom.where("parent is not null").groupBy(F.col(doc).alias("_doc"), F.col("parent").alias("_pre")).agg(F.collect_set("tag").alias("kids"), F.min_by("tag", "pos").alias("first_kid"), F.count(F.lit(1)).alias("n_kids"))
    rows = with_parent(dom, doc).join(kids, (F.col(doc) == F.col("_doc")) & (F.col("pre") == F.col("_pre")), "left")
    has = lambda t: F.when(F.coalesce(F.array_contains("kids", t), F.lit(False)), "yes").otherwise("no")
    shape = lambda c: F.regexp_replace(F.regexp_replace(T.squeeze(c), "[0-9]+", "#"), r"\b[IVXLC]+\b", "#")
    tag = F.col("tag")
    metric = lambda when, name, value: F.when(when, F.struct(F.lit(name).alias("metric"), F.coalesce(value.cast("string"), F.lit("<none>")).alias("value")))
    found = F.array(
        metric(tag == "book-part", "book-part type", attr("book-part-type")),
        metric(tag == "book-part", "book-part parent", F.col("parent_tag")),
        metric(tag == "sec", "sec depth", F.col("depth")),
        metric(tag == "sec", "sec level", attr("disp-level")),
        metric(tag == "sec", "sec has title", has("title")),
        metric(tag == "list", "list type", attr("list-type")),
        metric(tag == "list", "list parent", F.col("parent_tag")),
        metric(tag == "list-item", "list-item first child", F.col("first_kid")),
        metric(tag == "list-item", "list-item has label", has("label")),
        metric(tag == "fig", "fig has label", has("label")),
        metric(tag == "fig", "fig has caption", has("caption")),
        metric(tag == "fig", "fig parent", F.col("parent_tag")),
        metric(tag == "table-wrap", "table-wrap has label", has("label")),
        metric(tag == "table-wrap", "table-wrap has table", has("table")),
        metric(tag == "table-wrap", "table-wrap has graphic", has("graphic")),
        metric(tag == "table-wrap", "table-wrap has foot", has("table-wrap-foot")),
        metric(tag == "table-wrap", "table-wrap parent", F.col("parent_tag")),
        metric(tag == "boxed-text", "boxed-text type", attr("content-type")),
        metric(tag == "boxed-text", "boxed-text has caption", has("caption")),
        metric(tag == "disp-formula", "disp-formula parent", F.col("parent_tag")),
        metric(tag == "ref", "ref has label", has("label")),
        metric(tag == "ref-list", "ref-list parent", F.col("parent_tag")),
        metric(tag == "mixed-citation", "citation type", attr("publication-type")),
        metric(tag == "fn", "fn parent", F.col("parent_tag")),
        metric(tag == "fn", "fn has label", has("label")),
        metric(tag == "index-entry", "index-entry children", F.col("n_kids")),
        metric(tag == "index-entry", "index-entry has see", has("see-entry")),
        metric(tag == "nav-pointer", "nav-pointer parent", F.col("parent_tag")),
        metric(tag == "target", "target type", attr("target-type")),
        metric(tag == "target", "target parent", F.col("parent_tag")),
        metric(tag == "graphic", "graphic parent", F.col("parent_tag")),
        metric(tag == "label", "label shape", F.concat_ws(": ", "parent_tag", shape(F.col("text")))),
        metric(tag == "title", "title parent", F.col("parent_tag")),
    )
    return rows.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).groupBy("x.metric", "x.value").agg(F.count(F.lit(1)).alias("n"))


def placement(dom: DataFrame, doc: str) -> DataFrame:
    """doc, pre, id, kind, relation: where a float stands in relation to the block that first cites it.

    References inside the float, and those of contents lists and indexes, don't count. Ancestors are found by the
    levels that are open (tree.py); distances count a parent's children that don't float.
    """
    d = F.col(doc)
    label = dom.where("tag = 'label'").select(d.alias("_ld"), F.col("parent").alias("_lp")).distinct()
    floats = with_parent(dom, doc).where(F.col("tag").isin(*FLOATS) & attr("id").isNotNull() & ~((F.col("tag") == "fig") & (F.col("parent_tag") == "fig-group")))
    floats = floats.join(label, (d == F.col("_ld")) & (F.col("pre") == F.col("_lp")), "left").select(doc, "pre", "last", "parent", "parent_tag", "pos", "tail", attr("id").alias("id"), F.concat("tag", F.when(F.col("_lp").isNull() & (F.col("tag") != "boxed-text"), "(unlabeled)").otherwise("")).alias("kind"))
    xrefs = tree.around(dom.where("tag = 'xref'").select(doc, "pre", attr("rid").alias("rid")), dom.where(F.col("tag").isin(*NAVIGATION)), [doc], "_nav")
    xrefs = xrefs.where("_nav = 0").select(doc, F.col("pre").alias("x"), "rid")
    cites = xrefs.select(d.alias("_xd"), "x", "rid").join(floats.select(doc, "id", "pre", "last"), (F.col("_xd") == d) & (F.col("rid") == F.col("id")) & ~F.col("x").between(F.col("pre"), F.col("last")))
    first = cites.groupBy(F.col("_xd").alias("_cd"), F.col("pre").alias("_cp")).agg(F.min("x").alias("x"))
    rows = floats.join(first, (d == F.col("_cd")) & (F.col("pre") == F.col("_cp")), "left").drop("_cd", "_cp")

    around = with_parent(dom, doc).select(d.alias("_ad"), F.col("pre").alias("a"), F.col("tag").alias("at"), F.col("parent").alias("ap"), F.col("pos").alias("apos"), F.col("parent_tag").alias("apt"))

    def up(rows: DataFrame, at: str, name: str) -> DataFrame:
        """Adds the block around a node (nearest node whose parent holds blocks), its parent and place, and the parts around it."""
        asked = rows.where(F.col(at).isNotNull()).select(doc, "pre", F.col(at).alias("_at"))
        nodes = asked.select(doc, F.col("_at").alias("pre")).distinct()
        pairs = tree.within(dom, nodes, [doc]).unionByName(nodes.select(doc, F.col("pre").alias("outer_pre"), F.col("pre").alias("inner_pre")))
        pairs = pairs.select(d.alias("_pd"), "outer_pre", "inner_pre")
        met = asked.join(pairs, (d == F.col("_pd")) & (F.col("_at") == F.col("inner_pre"))).join(around, (F.col("_pd") == F.col("_ad")) & (F.col("outer_pre") == F.col("a")))
        found = met.groupBy(d.alias("_ud"), F.col("pre").alias("_up")).agg(
            F.max(F.when(F.col("apt").isin(*HOLDERS) & ~F.col("at").isin("xref"), F.struct("a", "ap", "apos"))).alias(f"{name}_block"),
            F.sort_array(F.collect_list(F.when(F.col("at").isin(*PARTS), F.struct("a", "at"))), asc=False).alias(f"{name}_parts"),
            F.max(F.when(F.col("at").isin("p", "title", "td", "th"), F.struct("a", "at"))).alias(f"{name}_para"),
        )
        return rows.join(found, (d == F.col("_ud")) & (F.col("pre") == F.col("_up")), "left").drop("_ud", "_up")

    rows = up(up(rows, "x", "cite"), "pre", "own")
    # Children of each holder that don't float, numbered, so that the distance of two is a difference.
    counted = with_parent(dom, doc).where(F.col("parent").isNotNull()).select(d.alias("_kd"), F.col("parent").alias("_kp"), F.col("pos").alias("_kpos"), F.sum((~F.col("tag").isin(*FLOATS)).cast("int")).over(Window.partitionBy(doc, "parent").orderBy("pos")).alias("_rank"))
    for name in ("cite", "own"):
        k = counted.withColumnRenamed("_rank", f"{name}_rank")
        rows = rows.join(k, (d == F.col("_kd")) & (F.col(f"{name}_block.ap") == F.col("_kp")) & (F.col(f"{name}_block.apos") == F.col("_kpos")), "left").drop("_kd", "_kp", "_kpos")
    end = dom.where("parent is not null").groupBy(d.alias("_ed"), F.col("parent").alias("_ep")).agg(F.max("pos").alias("_last_pos"))
    rows = rows.join(end, (d == F.col("_ed")) & (F.col("parent") == F.col("_ep")), "left").drop("_ed", "_ep")
    hops = F.greatest(F.lit(0), F.col("own_rank") - F.col("cite_rank") - F.when(F.col("kind").rlike("^(fig|table-wrap|boxed-text)"), 0).otherwise(1))
    cite_part, own_part = F.get("cite_parts", F.lit(0)), F.get("own_parts", F.lit(0))
    has = lambda parts, part: F.exists(parts, lambda p: p["a"] == part["a"])
    common = F.get(F.filter("cite_parts", lambda p: F.exists("own_parts", lambda q: q["a"] == p["a"])), F.lit(0))
    inside = (F.col("cite_para.at") == "p") & (F.col("parent") == F.col("cite_para.a"))
    relation = (
        F.when(F.col("x").isNull(), "no_citation")
        .when(inside, F.when((F.col("pos") == F.col("_last_pos")) & (F.trim("tail") == ""), "inside_citing_paragraph_end").otherwise("inside_citing_paragraph_mid"))
        .when(F.col("cite_block.a") == F.col("own_block.a"), "citation_inside_target_block")
        .when(F.col("own_block.a") < F.col("cite_block.a"), "before_first_citation")
        .when(F.col("own_block.ap") == F.col("cite_block.ap"), F.when(hops == 0, "immediately_after_citing_block").otherwise(F.concat(F.lit("after_citing_block_+"), F.least(hops, F.lit(5)).cast("string"), F.lit("blocks"))))
        .when(has(F.col("own_parts"), cite_part), "later_in_descendant_sec")
        .when(has(F.col("cite_parts"), own_part), "after_in_ancestor_sec")
        .when(common["at"] == "book-part", "later_in_other_sec_same_chapter")
        .otherwise("different_book_part")
    )
    return rows.select(doc, "pre", "id", "kind", relation.alias("relation"))


def evidence(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, pattern, n, total, share, alternatives: the dominant value of each convention and what speaks for it. counts has n."""
    best = counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", value)).alias("pattern"), F.max("n").alias("n"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("values"))
    return best.withColumn("share", F.col("n") / F.col("total")).withColumn("conflict", F.col("values") > 1)


#: Counts above which a book has a tag.
PROFILE = [("fig", 300, "figure-heavy"), ("table-wrap", 100, "table-heavy"), ("ref", 500, "reference-heavy"), ("index-entry", 3000, "index-heavy"), ("question-wrap", 20, "quiz"), ("boxed-text", 150, "box-heavy")]


def profiles(dom: DataFrame, doc: str) -> DataFrame:
    """doc, tags."""
    counted = dom.groupBy(doc).agg(*[F.count_if(F.col("tag") == t).alias(f"n_{i}") for i, (t, _, _) in enumerate(PROFILE)])
    tags = F.filter(F.array(*[F.when(F.col(f"n_{i}") > n, name) for i, (_, n, name) in enumerate(PROFILE)]), lambda x: x.isNotNull())
    return counted.select(doc, F.when(F.size(tags) == 0, F.array(F.lit("textbook"))).otherwise(tags).alias("tags"))
