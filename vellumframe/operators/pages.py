"""Pages: rotation and trim, page marks and the text between them, the state of lines and pages, order by printed numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumframe.functions import text as T
from vellumframe.operators import ordered
from vellumframe.shared import dealt, written

#: Tolerance of the trim, the outer share of a page where side tabs stand, shares of matched words of a line,
#: rows of a page report, and the pages and zone in which a file's first printed number is looked for.
TRIM_TOLERANCE, SIDE_SHARE, MATCHED, CHANGED, REPORT_ROWS, FIRST_PAGES, EDGE_SHARE = 2.0, 0.12, 0.9, 0.4, 300, 4, 0.1
#: What an element's ancestors make its context, the first that applies.
CONTEXTS = [("reference", ["ref"]), ("footnote", ["fn"]), ("table", ["table-wrap", "table"]), ("caption", ["caption"]), ("sidebar", ["boxed-text"])]


def box(x0, y0, x1, y1) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def upright(b: Column, rotation: Column, width: Column, height: Column) -> Column:
    """The box in a frame where text turned by 90 or -90 degrees runs from left to right; others stay."""
    return F.when(rotation == 90, box(height - b["y1"], b["x0"], height - b["y0"], b["x1"])).when(rotation == -90, box(b["y0"], width - b["x1"], b["y1"], width - b["x0"])).otherwise(b)


def turned_back(b: Column, rotation: Column, width: Column, height: Column) -> Column:
    """The inverse of upright."""
    return F.when(rotation == 90, box(b["y0"], height - b["x1"], b["y1"], height - b["x0"])).when(rotation == -90, box(width - b["y1"], b["x0"], width - b["y0"], b["x1"])).otherwise(b)


def inside(b: Column, clip: Column, tolerance: float = TRIM_TOLERANCE) -> Column:
    """Whether a box's centre lies in the clip, or next to it."""
    x, y = (b["x0"] + b["x1"]) / 2, (b["y0"] + b["y1"]) / 2
    return x.between(clip["x0"] - tolerance, clip["x1"] + tolerance) & y.between(clip["y0"] - tolerance, clip["y1"] + tolerance)


def side_tab(b: Column, vertical: Column, text: Column, clip: Column, longest: int = 40) -> Column:
    """Whether a short vertical line stands in the outer share of the trim on either side."""
    edge, x = SIDE_SHARE * (clip["x1"] - clip["x0"]), (b["x0"] + b["x1"]) / 2
    return vertical & (F.length(F.trim(text)) <= longest) & ((x < clip["x0"] + edge) | (x > clip["x1"] - edge))


def dominant_rotation(spans: DataFrame, keys: list[str], rotation: str, text: str) -> DataFrame:
    """keys, rotation: that of most characters of a page if it has half of them or more, else 0. Of equal ones the smaller."""
    counted = spans.groupBy(*keys, F.col(rotation).alias("_r")).agg(F.sum(F.length(text)).alias("_n"))
    best = counted.groupBy(*keys).agg(F.max_by("_r", F.struct("_n", -F.col("_r"))).alias("_best"), F.max("_n").alias("_most"), F.sum("_n").alias("_all"))
    return best.select(*keys, F.when((F.col("_most") * 2 >= F.col("_all")) & (F.col("_all") > 0), F.col("_best")).otherwise(0).alias("rotation"))


def contexts(dom: DataFrame, doc: str, tag: str = "xref") -> DataFrame:
    """doc, pre, context of each element of a tag: what the elements around it make it, body where none counts."""
    rank = F.lit(None).cast("int")
    for i, (_, tags) in reversed(list(enumerate(CONTEXTS))):
        rank = F.when(F.col("tag").isin(*tags), i).otherwise(rank)
    # Beginnings and ends of holders and what is asked for stand in one order; a running count for each rank tells what is open. It
    # runs over buckets of the order, and what is open where a bucket begins is one more row of it, so rows are moved once.
    spans = dom.select(doc, rank.alias("_rank"), "pre", "last").where("_rank is not null").groupBy(doc, "_rank", "pre").agg(F.max("last").alias("last"))
    edge = lambda order, kind, step: F.struct(order.cast("long").alias("_order"), F.lit(kind).alias("_kind"), F.lit(step).alias("_step"))
    edges = spans.select(doc, "_rank", F.inline(F.array(edge(2 * F.col("pre"), 1, 1), edge(2 * F.col("last") + 1, 2, -1))))
    asked = dom.where(F.col("tag") == tag).select(doc, F.lit(None).cast("int").alias("_rank"), (2 * F.col("pre")).cast("long").alias("_order"), F.lit(0).alias("_kind"), F.lit(0).alias("_step"))
    events = written(asked.unionByName(edges), "contexts")
    rows = events.withColumn("_bucket", ordered.bucket(F.col("_order"), ordered.cuts(events, "_order")))
    ranks = [f"_{i}" for i in range(len(CONTEXTS))]
    steps = [F.when(F.col("_rank") == i, F.col("_step")).otherwise(0).cast("long").alias(c) for i, c in enumerate(ranks)]
    rows = rows.select(doc, "_bucket", "_order", "_kind", *steps)
    earlier = Window.partitionBy(doc).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(doc, "_bucket").agg(*[F.sum(c).alias(c) for c in ranks])
    base = sums.select(doc, "_bucket", F.lit(None).cast("long").alias("_order"), F.lit(-1).alias("_kind"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ranks])
    placed = dealt(rows.unionByName(base), events.count(), doc, "_bucket")
    at = Window.partitionBy(doc, "_bucket").orderBy(F.col("_order").asc_nulls_first(), "_kind")
    open_ = at.rowsBetween(Window.unboundedPreceding, 0)
    again = F.lag("_kind").over(at).eqNullSafe(F.lit(0)) & F.lag("_order").over(at).eqNullSafe(F.col("_order"))
    found = placed.select(doc, "_order", "_kind", again.alias("_again"), *[F.sum(c).over(open_).alias(c) for c in ranks]).where("_kind = 0 and not _again")
    context = F.lit("body")
    for c, (name, _) in reversed(list(zip(ranks, CONTEXTS, strict=True))):
        context = F.when(F.col(c) > 0, name).otherwise(context)
    return found.select(doc, F.expr("_order div 2").cast(dom.schema["pre"].dataType).alias("pre"), context.alias("context"))


def marks(targets: DataFrame, lines: DataFrame) -> DataFrame:
    """book, folio, at, placed: of a page's marks (book, folio, at) the first, and for pages without one the first of the
    page's lines (book, folio, at)."""
    first = lambda df, placed: df.where("folio is not null").groupBy("book", "folio").agg(F.min("at").alias("at")).withColumn("placed", F.lit(placed))
    said, missing = first(targets, False), first(lines, True)
    return said.unionByName(missing.join(said.select("book", "folio"), ["book", "folio"], "left_anti"))


def page_bags(rows: DataFrame, keys: list[str], order: str, target: str, text: str) -> DataFrame:
    """keys, target, word, n: the words between one page target and the next, in order; those before the first have target null.
    rows: (keys, order, target or null, text). The target of a row is the last one at or before it."""
    placed = ordered.running_before(rows.withColumn("_at", F.when(F.col(target).isNotNull(), F.col(order)).otherwise(F.lit(-1)).cast("long")), keys, order, "_at", "_seen", "max")
    page = F.greatest(F.col("_at"), F.coalesce("_seen", F.lit(-1)))
    named = rows.where(F.col(target).isNotNull()).select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col(order).alias("_t_at"), F.col(target).alias("_t"))
    words = placed.select(*keys, page.alias("_page"), F.explode(T.words(F.col(text))).alias("word")).groupBy(*keys, "_page", "word").agg(F.count(F.lit(1)).alias("n"))
    on = F.col("_page") == F.col("_t_at")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    return words.join(named, on, "left").select(*keys, F.col("_t").alias(target), "word", "n")


def line_states(lines: DataFrame, words: DataFrame, keys: list[str], text: str) -> DataFrame:
    """lines with share and state: the share of a line's different words that the page's text (keys, word) has, and whether that
    makes it matched, changed or missing. Lines without words are matched. Rows of lines differ in some column."""
    names = lines.columns
    each = lines.select(*names, F.explode_outer(F.array_distinct(T.words(F.col(text)))).alias("_word"))
    has = words.select(*[F.col(k).alias(f"_w_{k}") for k in keys], F.col("word").alias("_has")).distinct()
    on = F.col("_word") == F.col("_has")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_w_{k}"))
    counted = each.join(has, on, "left").groupBy(*names).agg(F.count("_word").alias("_all"), F.count("_has").alias("_hit"))
    share = F.when(F.col("_all") > 0, F.col("_hit") / F.col("_all")).otherwise(1.0)
    return counted.withColumn("share", share).withColumn("state", F.when(F.col("share") >= MATCHED, "matched").when(F.col("share") >= CHANGED, "changed").otherwise("missing")).drop("_all", "_hit")


def page_report(pages: DataFrame, order: list[str], limit: int = REPORT_ROWS) -> DataFrame:
    """The first pages whose status isn't PASS, as a report shows them."""
    return pages.where("status <> 'PASS'").orderBy(*order).limit(limit)


def bookmark_levels(headings: DataFrame, bookmarks: DataFrame, least: int = 10) -> DataFrame:
    """headings (book, at, text) with level: that of the bookmark (book, pos, text, level) with the same normalised title, else of
    the first that begins with it, where the title has `least` characters or more. Both meet by the title or by its first
    characters."""
    norm = T.norm_title(F.col("text"))
    own = headings.withColumn("_t", norm)
    marked = bookmarks.select(F.col("book").alias("_book"), "pos", F.col("level").alias("_level"), norm.alias("_b")).where("_b <> ''")
    same = marked.groupBy("_book", "_b").agg(F.min_by("_level", "pos").alias("_same"))
    met = own.join(same, (F.col("book") == F.col("_book")) & (F.col("_t") == F.col("_b")), "left").drop("_book", "_b")
    long = marked.select(F.col("_book").alias("_book2"), "pos", "_level", "_b", F.substring("_b", 1, least).alias("_head"))
    wide = own.where(F.length("_t") >= least).select("book", "_t").distinct().withColumn("_own", F.substring("_t", 1, least))
    longer = wide.join(long, (F.col("book") == F.col("_book2")) & (F.col("_own") == F.col("_head")) & F.startswith("_b", F.col("_t")))
    longer = longer.groupBy(F.col("book").alias("_book3"), F.col("_t").alias("_t3")).agg(F.min_by("_level", "pos").alias("_longer"))
    met = met.join(longer, (F.col("book") == F.col("_book3")) & (F.col("_t") == F.col("_t3")), "left")
    return met.select(*headings.columns, F.coalesce("_same", "_longer").alias("level"))


def first_folios(words: DataFrame, pages: DataFrame) -> DataFrame:
    """pdf, start: the printed number of a file's first page, by most votes of numbers in the head and foot of its first pages for
    number less page; of equal votes the smaller. words: (pdf, page, y0, y1, text); pages: (pdf, page, y0, y1)."""
    edges = pages.select(F.col("pdf").alias("_pdf"), F.col("page").alias("_page"), (F.col("y0") + EDGE_SHARE * (F.col("y1") - F.col("y0"))).alias("_head"), (F.col("y1") - EDGE_SHARE * (F.col("y1") - F.col("y0"))).alias("_foot"))
    rows = words.where((F.col("page") < FIRST_PAGES) & F.col("text").rlike("^[0-9]{1,4}$")).join(edges, (F.col("pdf") == F.col("_pdf")) & (F.col("page") == F.col("_page")))
    votes = rows.where((F.col("y1") <= F.col("_head")) | (F.col("y0") >= F.col("_foot"))).select("pdf", (F.col("text").cast("long") - F.col("page")).alias("start")).where("start > 0")
    counted = votes.groupBy("pdf", "start").agg(F.count(F.lit(1)).alias("_n"))
    return counted.groupBy("pdf").agg(F.max_by("start", F.struct("_n", -F.col("start"))).alias("start"))


def by_folio(files: DataFrame, share: float = 0.8) -> DataFrame:
    """files (book, pdf, rank, number, name, code, start) with seq: their place in the book. They stand by rank, number and name;
    the body files (rank 1) of a book with two codes or more, of which `share` have a printed start, by that start first."""
    body = files.where("rank = 1").groupBy(F.col("book").alias("_book")).agg(F.countDistinct("code").alias("_codes"), F.avg(F.col("start").isNotNull().cast("double")).alias("_share"))
    rows = files.join(body, F.col("book") == F.col("_book"), "left")
    printed = F.when((F.col("rank") == 1) & (F.col("_codes") >= 2) & (F.col("_share") >= share), F.col("start"))
    place = Window.partitionBy("book").orderBy("rank", printed.asc_nulls_last(), "number", "name")  # a book has files by the hundred
    return rows.withColumn("seq", F.row_number().over(place) - 1).select(*files.columns, "seq")


def before_blocks(dom: DataFrame, doc: str, floats: list[str], words: int = 8) -> DataFrame:
    """doc, pre, before of each float: the first words of the sibling before it that is no float, START where there is none, IN-P in
    a paragraph."""
    kids = dom.select(doc, "pre", "parent", "pos", "tag", "text")
    holder = dom.select(F.col(doc).alias("_doc"), F.col("pre").alias("_pre"), F.col("tag").alias("_holder"))
    at = Window.partitionBy(doc, "parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # children of one element
    start = F.array_join(F.slice(T.words(F.col("text")), 1, words), " ")
    rows = kids.withColumn("_said", F.last(F.when(~F.col("tag").isin(*floats), start), ignorenulls=True).over(at)).where(F.col("tag").isin(*floats))
    met = rows.join(holder, (F.col(doc) == F.col("_doc")) & (F.col("parent") == F.col("_pre")), "left")
    return met.select(doc, "pre", F.when(F.col("_holder") == "p", "IN-P").otherwise(F.coalesce("_said", F.lit("START"))).alias("before"))
