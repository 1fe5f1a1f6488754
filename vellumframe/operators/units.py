"""Units of a book, who owns its lines, what contents lists and outlines point to, and a book's metadata with their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumframe.functions import text as T
from vellumframe.operators.ordered import first_of


def page_map(files: DataFrame) -> DataFrame:
    """book_id, file_idx, file_page, page: pages of a book numbered through its files, of which each has `pages`."""
    start = F.coalesce(F.sum("pages").over(Window.partitionBy("book_id").orderBy("file_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("_start", start).where("pages > 0").select("book_id", "file_idx", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("file_page"), "_start").withColumn("page", (F.col("_start") + F.col("file_page")).cast("int")).drop("_start")


def unit_of(lines: DataFrame, units: DataFrame) -> DataFrame:
    """lines (book_id, page, line_no) with unit: units (book_id, unit, start_page, end_page, start_line, end_line) may begin and
    end inside a page. Each page of a unit is a row, so this is an equi-join."""
    spread = units.select(F.col("book_id").alias("_b"), "unit", "start_page", "end_page", F.coalesce("start_line", F.lit(0)).alias("_from"), F.coalesce("end_line", F.lit(1 << 30)).alias("_to"), F.explode(F.sequence("start_page", "end_page")).alias("_p"))
    met = lines.join(spread, (F.col("book_id") == F.col("_b")) & (F.col("page") == F.col("_p")), "left")
    here = ((F.col("page") > F.col("start_page")) | (F.col("line_no") >= F.col("_from"))) & ((F.col("page") < F.col("end_page")) | (F.col("line_no") <= F.col("_to")))
    first = met.where(here).groupBy("book_id", "page", "line_no").agg(F.min("unit").alias("unit"))
    return lines.join(first, ["book_id", "page", "line_no"], "left")


def owners(claims: DataFrame) -> DataFrame:
    """book_id, uid, zid: of claims (book_id, uid, zid, stage, seq) on a line, that of the first stage, and in it the first."""
    return first_of(claims, ["book_id", "uid"], [F.col("stage"), F.col("seq")], ["zid"])


def resolve_toc(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """entries (book_id, entry, label, title, page) with rid: the chapter on that page if the label says chapter, else what the
    page's first registration is, else the last section of that title, else the page itself.

    targets: (book_id, kind, key, target, pos) with kinds chapter_page, page, title, folio.
    """
    first = first_of(targets.where("kind <> 'title'"), ["book_id", "kind", "key"], [F.col("pos")], ["target"])
    last = targets.where("kind = 'title'").groupBy("book_id", "kind", "key").agg(F.max_by("target", "pos").alias("target"))
    known = first.union(last)

    def lookup(rows: DataFrame, kind: str, key, name: str) -> DataFrame:
        side = known.where(F.col("kind") == kind).select(F.col("book_id").alias("_b"), F.col("key").alias("_k"), F.col("target").alias(name))
        return rows.withColumn("_key", key).join(side, (F.col("book_id") == F.col("_b")) & (F.col("_key") == F.col("_k")), "left").drop("_b", "_k", "_key")

    chapter = F.lower(F.coalesce("label", F.lit(""))).rlike("chapter|cap[íi]tulo")
    rows = entries
    for kind, key, name in (("chapter_page", F.when(chapter, F.col("page")), "_chapter"), ("page", F.col("page"), "_page"), ("title", T.norm_title(F.col("title")), "_title"), ("folio", F.col("page"), "_folio")):
        rows = lookup(rows, kind, key, name)
    return rows.select(*entries.columns, F.coalesce("_chapter", "_page", "_title", "_folio").alias("rid"))


def resolve_outline(outline: DataFrame, sections: DataFrame, least: float = 0.6) -> DataFrame:
    """outline (book_id, entry, text) with rid by normalised title, for books of which `least` of the entries are found;
    others' entries have none. sections: (book_id, title, target, pos)."""
    side = sections.select(F.col("book_id").alias("_b"), T.norm_title(F.col("title")).alias("_t"), "target", "pos").groupBy("_b", "_t").agg(F.min_by("target", "pos").alias("_rid"))
    met = outline.join(side, (F.col("book_id") == F.col("_b")) & (T.norm_title(F.col("text")) == F.col("_t")), "left")
    share = met.groupBy(F.col("book_id").alias("_sb")).agg(F.avg(F.col("_rid").isNotNull().cast("int")).alias("_share"))
    return met.join(share, F.col("book_id") == F.col("_sb")).select(*outline.columns, F.when(F.col("_share") >= least, F.col("_rid")).alias("rid"))


#: Where a value may come from, the first that has one.
EVIDENCE = ["override", "title_page", "bookmark", "pdf_metadata", "file_name"]


def book_info(evidence: DataFrame) -> DataFrame:
    """book_id, field, value, source: of evidence (book_id, field, source, value) the value of the first source."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in EVIDENCE]), F.col("source")), F.lit(0))
    rows = evidence.where("trim(value) <> ''").withColumn("_rank", F.when(rank == 0, 99).otherwise(rank))
    return first_of(rows, ["book_id", "field"], [F.col("_rank"), F.col("value")], ["value", "source"])


def like_person(text):
    """Whether a line names people: most of its words begin with a capital, connectors and degrees aside."""
    words = F.filter(F.split(F.regexp_replace(text, r"[,.;&]", " "), r"\s+"), lambda w: (w != "") & ~F.lower(w).isin("y", "and", "de", "del", "la", "van", "von", "e", "et", "phd", "md", "msc", "rn", "dr", "dra"))
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return (F.size(words) >= 2) & (F.size(words) <= 12) & (capital >= 0.6 * F.size(words)) & ~text.rlike("[0-9]")
