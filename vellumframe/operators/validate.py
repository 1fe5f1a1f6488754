"""Validation of markup: ids, links, structure, content coverage, comparison with a golden document, the verdict.

All take dom tables as markup.dom gives them: (doc, pre, last, parent, depth, pos, tag, attrs, text, tail).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumframe.functions import text as T
from vellumframe.operators import bags, tree
from vellumframe.shared import written

#: Elements that a reference of a type may name, and the elements that are counted.
EXPECTED = {"fig": ["fig"], "table": ["table-wrap"], "box": ["boxed-text"], "bibr": ["ref"], "fn": ["fn"], "sec": ["sec"], "chapter": ["book-part"], "app": ["book-part", "app"], "disp-formula": ["disp-formula"]}
COUNTED = ["book-part", "sec", "p", "list", "fig", "table-wrap", "boxed-text", "ref", "fn", "disp-formula", "index-entry", "toc-entry", "target", "xref", "nav-pointer"]
ID_SYNTAX = r"^[A-Za-z_][A-Za-z0-9._-]*$"
COVERAGE_LEAST = 0.97


def attr(name: str):
    return F.element_at("attrs", name)


def ids(dom: DataFrame, doc: str, prefix: str) -> DataFrame:
    """doc, id, n, defect: each id that occurs more than once, that isn't an XML name, or that no pattern of ids has."""
    pattern = rf"^(?:{prefix}-[a-z]+[0-9]{{3,}}(?:-[a-z-]+[0-9]{{3,}})*(?:-fn[0-9]{{3,}})?|{prefix}-(?:cover|thumbnail|per|license)|page[0-9a-z]+|{prefix}-fm001-cap000)$"
    counted = dom.select(doc, attr("id").alias("id")).where("id is not null").groupBy(doc, "id").agg(F.count(F.lit(1)).alias("n"))
    defects = F.array(F.when(F.col("n") > 1, "duplicate"), F.when(~F.col("id").rlike(ID_SYNTAX), "invalid").when(~F.col("id").rlike(pattern), "pattern"))
    return counted.select(doc, "id", "n", F.explode(F.filter(defects, lambda d: d.isNotNull())).alias("defect"))


def links(dom: DataFrame, doc: str) -> DataFrame:
    """doc, pre, element, ref_type, rid, target, status: valid, broken or wrong_type. Of elements with one id the last counts."""
    targets = dom.select(doc, attr("id").alias("_id"), "pre", "tag").where("_id is not null").groupBy(F.col(doc).alias("_doc"), "_id").agg(F.max_by("tag", "pre").alias("target"))
    rows = dom.where("tag in ('xref', 'nav-pointer', 'answer', 'question')").select(doc, "pre", F.col("tag").alias("element"), attr("ref-type").alias("ref_type"), attr("rid").alias("rid")).where("rid is not null")
    met = rows.join(targets, (F.col(doc) == F.col("_doc")) & (F.col("rid") == F.col("_id")), "left").drop("_doc", "_id")
    right = F.lit(True)
    for kind, tags in EXPECTED.items():
        right = F.when(F.col("ref_type") == kind, F.col("target").isin(*tags)).otherwise(right)
    return met.withColumn("status", F.when(F.col("target").isNull(), "broken").when(right, "valid").otherwise("wrong_type"))


def unlinked(dom: DataFrame, doc: str) -> DataFrame:
    """doc, id, tag of figures and tables that no valid link names."""
    named = links(dom, doc).where("status = 'valid'").select(F.col(doc).alias("_doc"), F.col("rid").alias("_rid")).distinct()
    rows = dom.where("tag in ('fig', 'table-wrap')").select(doc, attr("id").alias("id"), "tag")
    return rows.join(named, (F.col(doc) == F.col("_doc")) & (F.col("id") == F.col("_rid")), "left_anti")


def structure(dom: DataFrame, doc: str) -> DataFrame:
    """doc, pre, id, issue: tables without table or graphic, figures without graphic, parts without id, empty paragraphs."""
    kids = dom.where("parent is not null").groupBy(F.col(doc).alias("_doc"), F.col("parent").alias("_pre")).agg(F.collect_set("tag").alias("_kids"))
    meta = dom.where("tag = 'book-part-id'").select(F.col(doc).alias("_d2"), F.col("parent").alias("_meta"))
    grand = dom.where("tag = 'book-part-meta'").join(meta, (F.col(doc) == F.col("_d2")) & (F.col("pre") == F.col("_meta"))).select(F.col(doc).alias("_d3"), F.col("parent").alias("_part")).distinct()
    watched = dom.where("tag in ('table-wrap', 'fig', 'book-part', 'p')")
    rows = watched.join(kids, (F.col(doc) == F.col("_doc")) & (F.col("pre") == F.col("_pre")), "left").join(grand, (F.col(doc) == F.col("_d3")) & (F.col("pre") == F.col("_part")), "left")
    has = lambda t: F.coalesce(F.array_contains("_kids", t), F.lit(False))
    found = F.array(
        F.when((F.col("tag") == "table-wrap") & ~has("table") & ~has("graphic"), "neither table nor graphic"),
        F.when((F.col("tag") == "table-wrap") & ~F.coalesce(attr("specific-use") == "inline", F.lit(False)), "missing specific-use=inline"),
        F.when((F.col("tag") == "fig") & ~has("graphic"), "no graphic"),
        F.when((F.col("tag") == "book-part") & F.col("_part").isNull(), "lacks book-part-id"),
        F.when((F.col("tag") == "p") & F.col("_kids").isNull() & (F.trim("text") == ""), "empty paragraph"),
    )
    return rows.select(doc, "pre", attr("id").alias("id"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("issue"))


def counts(dom: DataFrame, doc: str) -> DataFrame:
    """doc and the number of each counted element."""
    return dom.groupBy(doc).agg(*[F.count_if(F.col("tag") == t).alias(t) for t in COUNTED])


def disallowed(dom: DataFrame, doc: str, allowed: DataFrame) -> DataFrame:
    """doc, parent_tag, child_tag, n of children that a rule table (parent, child) doesn't allow."""
    above = dom.select(F.col(doc).alias("_doc"), F.col("pre").alias("_pre"), F.col("tag").alias("parent_tag"))
    pairs = dom.join(above, (F.col(doc) == F.col("_doc")) & (F.col("parent") == F.col("_pre"))).groupBy(doc, "parent_tag", F.col("tag").alias("child_tag")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(allowed.select(F.col("parent").alias("_p"), F.col("child").alias("_c")).distinct(), (F.col("parent_tag") == F.col("_p")) & (F.col("child_tag") == F.col("_c")), "left_anti")


def page_words(lines: DataFrame, exclude: tuple[str, ...] = ("header", "footer", "folio", "slug", "figure-text")) -> DataFrame:
    """page, word, n: the words of pages' lines (page, line_no, role, text). The last word of a line that ends in a
    letter and a hyphen is put before the first word of the page's next line that has words."""
    rows = lines.where(~F.col("role").isin(*exclude)).withColumn("_w", T.words(F.col("text"))).where("size(_w) > 0").select("page", "line_no", "text", "_w")
    order = Window.partitionBy("page").orderBy("line_no")
    split = F.rtrim("text").rlike(r"\p{L}-$")
    # A line whose only word is carried gives it on with what was carried to it; runs of such lines are put together.
    rows = rows.withColumns({"_split": split, "_only": split & (F.size("_w") == 1)})
    rows = rows.withColumn("_run", F.sum(F.when(F.lag("_only", 1, False).over(order), 0).otherwise(1)).over(order))
    runs = rows.groupBy("page", "_run").agg(F.min("line_no").alias("line_no"), F.sort_array(F.collect_list(F.struct("line_no", "_w", "_split"))).alias("_l"))
    last = F.element_at("_l", -1)
    glued = F.concat_ws("", F.flatten(F.transform(F.slice("_l", 1, F.size("_l") - 1), lambda x: x["_w"])), F.get(last["_w"], F.lit(0)))
    words = F.concat(F.array(glued), F.slice(last["_w"], 2, F.size(last["_w"])))
    runs = runs.select("page", "line_no", words.alias("_w"), last["_split"].alias("_split"))
    runs = runs.withColumn("_carry", F.lag(F.when(F.col("_split"), F.element_at("_w", -1))).over(order)).withColumn("_next", F.lead("line_no").over(order))
    kept = F.when(F.col("_split") & F.col("_next").isNotNull(), F.slice("_w", 1, F.size("_w") - 1)).otherwise(F.col("_w"))
    body = F.when(F.col("_carry").isNotNull() & (F.size(kept) > 0), F.concat(F.array(F.concat("_carry", F.get(kept, F.lit(0)))), F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))))).when(F.col("_carry").isNotNull(), F.array("_carry")).otherwise(kept)
    return runs.select("page", F.explode(body).alias("word")).groupBy("page", "word").agg(F.count(F.lit(1)).alias("n"))


def coverage(pages: DataFrame, xml_words: DataFrame) -> DataFrame:
    """page, words, matched, coverage: pages in order take words from the document's bag (word, n), each once."""
    found = bags.claimed(pages, xml_words, "page", "word")
    return found.withColumn("coverage", F.when(F.col("words") > 0, F.round(F.col("matched") / F.col("words"), 4)).otherwise(1.0))


def _own_text(dom: DataFrame, doc: str, *tags: str) -> DataFrame:
    """doc, pre, parent, tag, text of elements of some tags: all text below them, in order."""
    heads = dom.where(F.col("tag").isin(*tags)).select(doc, F.col("pre").alias("_pre"), F.col("last").alias("_last"), F.col("parent").alias("_parent"), F.col("tag").alias("_tag"))
    below = dom.select(F.col(doc).alias("_doc"), "pre", "last", "text", "tail")
    own = heads.select(doc, F.col("_pre").cast("long").alias("_outer"), F.col("_pre").cast("long").alias("_inner"))
    pairs = tree.within(heads.select(doc, F.col("_pre").alias("pre"), F.col("_last").alias("last")), dom, [doc]).toDF(doc, "_outer", "_inner").unionByName(own)
    pairs = pairs.withColumnRenamed(doc, "_of")
    met = heads.join(pairs, (F.col(doc) == F.col("_of")) & (F.col("_pre") == F.col("_outer"))).join(below, (F.col("_of") == F.col("_doc")) & (F.col("_inner") == F.col("pre")))
    # A text stands at the element's start, a tail at its end: after all that is below, so after an earlier start's.
    parts = met.select(doc, "_pre", "_parent", "_tag", F.explode(F.array(F.struct((F.col("pre") * 2).alias("at"), F.lit(0).alias("up"), F.col("text").alias("t")), F.when(F.col("pre") > F.col("_pre"), F.struct((F.col("last") * 2 + 1).alias("at"), (-F.col("pre")).alias("up"), F.col("tail").alias("t"))))).alias("p")).where("p is not null")
    return parts.groupBy(doc, "_pre", "_parent", "_tag").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), "").alias("text")).select(doc, F.col("_pre").alias("pre"), F.col("_parent").alias("parent"), F.col("_tag").alias("tag"), "text")


def texts(dom: DataFrame, doc: str, *tags: str) -> DataFrame:
    """doc, pre, parent, tag, text of elements of some tags: all text below them, in order."""
    return _own_text(dom, doc, *tags)


def _recall(golden: DataFrame, made: DataFrame, name: str) -> DataFrame:
    """One row: recall and precision of one bag (word, n) against another."""
    right = made.select(F.col("word").alias("_w"), F.col("n").alias("_n"))
    both = golden.join(right, F.col("word") == F.col("_w"), "full").agg(F.sum("n").alias("g"), F.sum("_n").alias("m"), F.sum(F.least(F.coalesce("n", F.lit(0)), F.coalesce("_n", F.lit(0)))).alias("b"))
    over = lambda c: F.coalesce("b", F.lit(0)) / F.greatest(F.lit(1), F.coalesce(c, F.lit(0)))
    return both.select(F.lit(name).alias("what"), over("g").alias("recall"), over("m").alias("precision"))


def compare(golden: DataFrame, made: DataFrame, doc: str) -> DataFrame:
    """what, recall, precision for words, section titles, paragraph starts, labelled figures and tables, references and
    index terms of one document against its golden form."""

    def bag(dom: DataFrame, rows: DataFrame) -> DataFrame:
        return rows.groupBy("word").agg(F.count(F.lit(1)).cast("long").alias("n"))

    def all_words(dom, own):
        return bag(dom, dom.select(F.explode(T.ascii_words(F.concat_ws(" ", "text", "tail"))).alias("word")))

    def titles(dom, own):
        secs = dom.where("tag = 'sec'").select(F.col(doc).alias("_d"), F.col("pre").alias("_p"))
        rows = own.where(F.col("tag") == "title").join(secs, (F.col(doc) == F.col("_d")) & (F.col("parent") == F.col("_p")))
        return bag(dom, rows.select(F.array_join(T.ascii_words(F.col("text")), " ").alias("word")).where("word <> ''"))

    def starts(dom, own):
        return bag(dom, own.where(F.col("tag") == "p").select(F.array_join(F.slice(T.ascii_words(F.col("text")), 1, 8), " ").alias("word")).where("word <> ''"))

    def labels(tag):
        def of(dom, own):
            holder = dom.where(F.col("tag") == tag).select(F.col(doc).alias("_d"), F.col("pre").alias("_p"))
            rows = own.where(F.col("tag") == "label").join(holder, (F.col(doc) == F.col("_d")) & (F.col("parent") == F.col("_p")))
            key = F.translate(F.regexp_extract("text", r"([A-Z]?[0-9]+(?:[.\-–][0-9]+)*)", 1), ".–", "--")
            return rows.select(key.alias("word")).where("word <> ''").distinct().withColumn("n", F.lit(1).cast("long"))

        return of

    def xrefs(dom, own):
        kind = dom.where("tag = 'xref'").select(F.col(doc).alias("_d"), F.col("pre").alias("_p"), attr("ref-type").alias("_k"))
        rows = own.where(F.col("tag") == "xref").join(kind, (F.col(doc) == F.col("_d")) & (F.col("pre") == F.col("_p")))
        return bag(dom, rows.select(F.concat_ws("|", F.coalesce("_k", F.lit("")), F.array_join(T.ascii_words(F.col("text")), " ")).alias("word")))

    def terms(dom, own):
        entry = dom.where("tag = 'index-entry'").select(F.col(doc).alias("_d"), F.col("pre").alias("_p"))
        rows = own.where(F.col("tag") == "term").join(entry, (F.col(doc) == F.col("_d")) & (F.col("parent") == F.col("_p")))
        return bag(dom, rows.select(F.array_join(T.ascii_words(F.col("text")), " ").alias("word")))

    said = [written(_own_text(df, doc, "title", "p", "label", "xref", "term"), "texts") for df in (golden, made)]
    out = None
    for name, of in (("words", all_words), ("section titles", titles), ("paragraph starts", starts), ("figures", labels("fig")), ("tables", labels("table-wrap")), ("references", xrefs), ("index terms", terms)):
        row = _recall(of(golden, said[0]), of(made, said[1]), name)
        out = row if out is None else out.union(row)
    return out


def score(comparison: DataFrame) -> DataFrame:
    """One row: the mean of nine shares of a comparison."""
    one = lambda name, column: F.max(F.when(F.col("what") == name, F.col(column)))
    parts = [one("words", "recall"), one("words", "precision"), one("section titles", "recall"), one("section titles", "precision"), *[one(n, "recall") for n in ("paragraph starts", "figures", "tables", "references", "index terms")]]
    return comparison.agg((sum(parts[1:], parts[0]) / len(parts)).alias("score"))


def gate(df: DataFrame) -> DataFrame:
    """df with critical and status, from columns dtd_errors, duplicate_ids, invalid_ids, broken_links, wrong_links, missing_images,
    coverage, failed_pages, errors, warnings, pattern_ids."""
    critical = F.filter(
        F.array(
            F.when(F.col("dtd_errors") > 0, "DTD invalid"), F.when(F.col("duplicate_ids") + F.col("invalid_ids") > 0, "duplicate/invalid IDs"), F.when(F.col("broken_links") + F.col("wrong_links") > 0, "broken links"),
            F.when(F.col("missing_images") > 0, "invalid image references"), F.when(F.col("coverage") < COVERAGE_LEAST, "content coverage"), F.when(F.col("failed_pages") > 0, "failed pages"), F.when(F.col("errors") > 0, "errors"),
        ),
        lambda x: x.isNotNull(),
    )
    rows = df.withColumn("critical", critical)
    return rows.withColumn("status", F.when(F.size("critical") > 0, "FAILED").when((F.col("warnings") > 0) | (F.col("pattern_ids") > 0), "PASS WITH WARNINGS").otherwise("PASS"))


def page_qa(pages: DataFrame) -> DataFrame:
    """pages with status, from words, coverage, errors and warnings."""
    status = F.when(F.col("errors") > 0, "ERROR").when((F.col("warnings") > 0) | ((F.col("coverage") < 0.9) & (F.col("words") > 20)), "WARNING").otherwise("PASS")
    return pages.withColumn("status", status)
