"""Printed lists as relations: entries of reference lists, contents lists and indexes, from their lines.

A list's lines are joined to what stands before them by buckets of their order (ordered.py), so that a list of any length is
divided; what must be read in sequence is a run of lines between two that begin something for certain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumframe.functions import text as T
from vellumframe.operators import ordered, tree
from vellumframe.operators.tables import spaced
from vellumframe.shared import written

#: Labels and beginnings of references, and the share of numbered lines by which a list is numbered.
NUMBER = r"^\s*\[?[0-9]{1,4}[.)\]]?\s+\S"
AUTHOR = r"^[A-ZÁÉÍÓÚÑÄÖÜ][\p{L}\p{N}_'’\-]+(?:\s[A-Z][\p{L}\p{N}_'’\-]+)?,?\s(?:[A-Z]{1,3}(?![\p{L}\p{N}_])|[A-Z]\.)"
NUMBERED, LEAST_NUMBERED, LINES_EACH, LIST_COLUMN = 0.3, 2, 2.5, 80
#: Fixed values of contents lists: titles, page numbers, labels, sections without a page, words that names have in common, the
#: longest title in lines, the share of capitals of an authors' line, and the distance of two indents.
TOC_TITLE = r"(?i)^\s*(contents|table of contents|contenido|contenidos|índice|indice|sumario|inhalt|sommaire|table des mati[èe]res|brief contents|contents in brief)\s*$"
TOC_PAGE = r"(?i)(?:\s*\.{2,}\s*|\s+|\t)([0-9]{1,4}|[ivxlc]{1,6})\s*$"
TOC_LABEL = r"(?i)^\s*((?:chapter|cap[íi]tulo|part|parte|secci[óo]n|section|unit|unidad|ap[ée]ndice|appendix)\s+(?:[0-9]+(?:\.[0-9]+)*|[IVXLA-Z]+)[.:]?|[0-9]{1,3}[.:]?|[IVXL]+[.:])\s+"
TOC_SECTION = r"(?i)^\s*(secci[óo]n|section|part|parte|unit|unidad)(?![\p{L}\p{N}_])"
PARTICLES = ["y", "and", "e", "de", "del", "la", "van", "von", "et", "al"]
WRAPPED, NAMES, INDENT = 4, 0.8, 4
#: Fixed values of indexes: letters over a division, page references and cross references at an entry's end, where columns are, how
#: long a line of an introduction is, and how many lines make an indent.
LETTER = r"^\s*[A-ZÁÉÍÓÚÑ]\s*$|^\s*[A-Z]\s*[-–]\s*[A-Z]\s*$"
PAGE = r"(?:[ivxlc]+|[0-9]{1,4})[a-z]{0,2}(?:\s*[–\-]\s*(?:[0-9]{1,4}|[ivxlc]+)[a-z]{0,2})?"
REFS = rf"^(?s:(.+?))(?:,\s*|\s+)({PAGE}(?:\s*,\s*{PAGE})*)\s*\.?\s*$"
SEE = r"^(?s:(.+?))[.,;]?\s*\(?(see also|See also|see|See|v[ée]ase tambi[ée]n|V[ée]ase tambi[ée]n|v[ée]ase|V[ée]ase|V\. tambi[ée]n|V\.|ver tambi[ée]n|Ver tambi[ée]n|ver|Ver)\s+([^()]+?)\)?\.?\s*$"
INDEX_TITLE = r"(?i)^\s*(index|índice|indice|subject index|author index|índice alfab[ée]tico|índice de materias|índice de pacientes)(?![\p{L}\p{N}_])"
INDEX_COLUMN, INTRODUCTION, SHARED, FULL = 60, 60, 3, 1.5


def _place(lines: DataFrame, keys: list[str], width: int) -> DataFrame:
    """lines with left and right: the smallest left edge of their column of their page, and where nine tenths of its lines end."""
    rows = lines.withColumn("_col", F.bround(F.col("x0") / width))
    ends = F.array_sort(F.collect_list("x1"))  # lines of a column of a page
    at = F.floor(F.lit(0.9) * (F.size("_ends") - 1)).cast("int")
    sides = rows.groupBy(*keys, "page", "_col").agg(F.min("x0").alias("left"), ends.alias("_ends")).withColumn("right", F.get("_ends", at))
    sides = sides.select(*[F.col(k).alias(f"_s_{k}") for k in [*keys, "page", "_col"]], "left", "right")
    return rows.join(sides, tree.same([*keys, "page", "_col"], "_s_")).select(*lines.columns, "left", "right")


def _follow(rows: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """rows with _prev: these columns of the row before by ord, null for the first."""
    return ordered.running_before(rows.withColumn("_own", F.struct(*columns)), keys, "ord", "_own", "_prev", "last").drop("_own")


def references(lines: DataFrame, keys: list[str], body_size: float) -> DataFrame:
    """lines (keys, ord, page, x0, y0, x1, y1, text) with entry: the number of the reference, from 0, that each is part of.

    A list is numbered if a share of its lines have a number; then these begin entries. Else a line begins one where it stands at
    the left of its column after a line that ends with a stop, or opens with an author's name; or below a gap on its page. ord
    has no ties in a list. Null texts are empty."""
    rows = lines.withColumn("ord", F.col("ord").cast("long")).withColumn("_text", F.coalesce("text", F.lit(""))).withColumn("_numbered", F.col("_text").rlike(NUMBER).cast("long"))
    counted = rows.groupBy(*keys).agg(F.sum("_numbered").alias("_k"), F.count(F.lit(1)).alias("_n"))
    mode = counted.select(*[F.col(k).alias(f"_m_{k}") for k in keys], (F.col("_k") >= F.greatest(F.lit(LEAST_NUMBERED), NUMBERED * F.col("_n") / LINES_EACH)).alias("_by_number"))
    rows = _place(rows, keys, LIST_COLUMN).join(mode, tree.same(keys, "_m_")).drop(*[f"_m_{k}" for k in keys])
    rows = _follow(rows, keys, "page", "y1", "_text")
    none = F.col("_prev").isNull()
    ended = F.rtrim(F.col("_prev._text")).rlike("[.)]$")
    parted = (F.col("_prev.page") == F.col("page")) & (F.col("_prev.y1") <= F.col("y0")) & (F.col("y0") - F.col("_prev.y1") > 0.5 * body_size)
    free = ((F.col("x0") <= F.col("left") + 1.0) & (none | ended)) | F.trim("_text").rlike(AUTHOR) | parted
    new = none | F.when(F.col("_by_number"), F.col("_numbered") == 1).otherwise(F.coalesce(free, F.lit(False)))
    rows = written(rows.withColumn("_new", new.cast("long")), "references")
    return ordered.sums_before(rows, keys, "ord", "_new", "_before").select(*lines.columns, (F.col("_before") + F.col("_new") - 1).alias("entry"))


def _names_alone(text: Column) -> Column:
    """Whether a line is nothing but names: most of its words, but for particles, begin with a capital; no page, label or capitals all over."""
    words = F.filter(F.transform(F.split(F.trim(text), T.SPACE), lambda w: F.regexp_replace(w, "^[,.;]+|[,.;]+$", "")), lambda w: (w != "") & ~F.lower(w).isin(*PARTICLES))
    first = lambda w: F.substring(w, 1, 1)
    capital = F.size(F.filter(words, lambda w: (first(w) == F.upper(first(w))) & (first(w) != F.lower(first(w)))))
    all_caps = (text == F.upper(text)) & (text != F.lower(text))
    return (F.size(words) > 0) & (capital >= NAMES * F.size(words)) & ~F.trim(text).rlike(TOC_PAGE) & ~F.concat(F.trim(text), F.lit(" ")).rlike(TOC_LABEL) & ~all_caps


def contents(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of contents lists: keys, ord (of their first line), label, title, page, level. lines: keys, ord, x0, text.

    A line that ends with a page number ends an entry. Of the lines before it, back to the last such line, each full WRAPPED that
    others follow are an entry without a page, and the rest begin the entry's title; but names at their head go to the title of
    the entry before, if it has a page, and a section's heading in capitals is an entry of its own. Lines after the last page
    number are entries each. Levels are clusters of left edges. Titles of the list itself and empty lines are left out."""
    rows = lines.select(*keys, F.col("ord").cast("long").alias("ord"), F.col("x0").cast("double").alias("x0"), F.trim(F.coalesce("text", F.lit(""))).alias("_text")).where((F.col("_text") != "") & ~F.col("_text").rlike(TOC_TITLE))
    rows = rows.withColumn("_ends", (F.col("_text").rlike(TOC_PAGE) & (F.length(F.regexp_replace("_text", TOC_PAGE, "")) > 0)).cast("long"))
    rows = ordered.sums_before(written(rows, "contents"), keys, "ord", "_ends", "_run")  # lines up to a page number are a run
    run = [*keys, "_run"]
    # A run is folded into an array: the wrapped lines of one title, or a head without pages.
    line = F.struct("ord", "x0", F.col("_text").alias("text"), "_ends")
    runs = rows.groupBy(*run).agg(F.array_sort(F.collect_list(line)).alias("_all"))
    runs = runs.withColumn("_closed", F.element_at("_all", -1)["_ends"] == 1).withColumn("_open", F.filter("_all", lambda x: x["_ends"] == 0)).withColumn("_n", F.size("_open"))
    full = F.when(F.col("_n") > WRAPPED, F.floor((F.col("_n") - 1) / WRAPPED) * WRAPPED).otherwise(0).cast("int")
    runs = runs.withColumn("_full", full).withColumn("_rest", F.slice("_open", F.col("_full") + 1, F.greatest(F.col("_n") - F.col("_full"), F.lit(0))))
    # Every run but the first has an entry with a page before it.
    other = F.filter(F.transform("_rest", lambda x, i: F.when(~_names_alone(x["text"]), i)), lambda i: i.isNotNull())
    names = F.when(F.col("_closed") & (F.col("_full") == 0) & (F.col("_run") > 0), F.coalesce(F.get(other, F.lit(0)), F.size("_rest"))).otherwise(0)
    runs = runs.withColumn("_names", names).withColumn("_title", F.slice("_rest", F.col("_names") + 1, F.greatest(F.size("_rest") - F.col("_names"), F.lit(0))))
    head = F.get("_title", F.lit(0))["text"]
    runs = runs.withColumn("_section", F.coalesce(F.col("_closed") & head.rlike(TOC_SECTION) & (head == F.upper(head)) & (head != F.lower(head)), F.lit(False)))
    runs = runs.withColumn("_wrapped", F.slice("_title", F.when(F.col("_section"), 2).otherwise(1), F.size("_title")))
    said = lambda parts: F.array_join(F.transform(parts, lambda x: x["text"]), " ")
    plain = lambda x: F.struct(x["ord"].alias("ord"), x["x0"].alias("x0"), x["text"].alias("text"), F.lit(None).cast("string").alias("page"))
    blocks = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.col("_full") - WRAPPED, F.lit(0)), F.lit(WRAPPED)), lambda i: i < F.col("_full")), lambda i: F.struct(F.get("_open", i)["ord"].alias("ord"), F.get("_open", i)["x0"].alias("x0"), said(F.slice("_open", i + 1, WRAPPED)).alias("text"), F.lit(None).cast("string").alias("page")))
    last = F.element_at("_all", -1)
    whole = F.trim(F.regexp_replace(F.concat_ws(" ", F.transform("_wrapped", lambda x: x["text"]), F.trim(F.regexp_replace(last["text"], TOC_PAGE, ""))), r"\s*\.{2,}\s*$", ""))
    first = F.when(F.size("_wrapped") > 0, F.get("_wrapped", F.lit(0))).otherwise(last)
    entry = F.struct(first["ord"].alias("ord"), first["x0"].alias("x0"), whole.alias("text"), F.regexp_extract(last["text"], TOC_PAGE, 1).alias("page"))
    made = F.concat(blocks, F.when(F.col("_section"), F.transform(F.slice("_title", 1, 1), plain)).otherwise(F.array().cast("array<struct<ord:bigint,x0:double,text:string,page:string>>")), F.when(F.col("_closed"), F.array(entry)).otherwise(F.transform("_title", plain)))
    runs = written(runs.select(*run, made.alias("_made"), said(F.slice("_rest", 1, F.col("_names"))).alias("_authors")), "runs")
    more = runs.where("_authors <> ''").select(*[F.col(k).alias(f"_a_{k}") for k in keys], (F.col("_run") - 1).alias("_a_run"), "_authors")
    found = runs.select(*run, F.explode("_made").alias("e")).select(*run, "e.*")
    found = found.join(more, tree.same(keys, "_a_") & (F.col("_run") == F.col("_a_run")) & F.col("page").isNotNull(), "left")
    label = F.when(F.col("page").isNotNull() & F.col("text").rlike(TOC_LABEL), F.trim(F.regexp_extract("text", TOC_LABEL, 1)))
    title = F.when(label.isNotNull(), F.trim(F.regexp_replace("text", TOC_LABEL, ""))).otherwise(F.col("text"))
    found = found.select(*keys, "ord", "x0", label.alias("label"), F.concat_ws(" ", title, "_authors").alias("title"), "page").withColumn("_x", F.bround("x0").cast("int"))
    edges = found.groupBy(*keys).agg(spaced(F.array_sort(F.collect_set("_x")), INDENT).alias("_edges")).select(*[F.col(k).alias(f"_e_{k}") for k in keys], "_edges")  # points of a page's width
    far = F.transform("_edges", lambda e: F.abs(e - F.col("x0")))
    level = (F.array_position(far, F.array_min(far)) - 1).cast("int")
    return found.join(edges, tree.same(keys, "_e_")).select(*keys, "ord", "label", "title", "page", level.alias("level"))


def index_parts(text: Column) -> Column:
    """term, refs, see, see_also of an index entry's text: what it refers to stands at its end, pages before other entries."""
    none = F.array().cast("array<string>")
    pieces = lambda t, by: F.filter(F.transform(F.split(t, by), lambda x: F.trim(x)), lambda x: x != "")
    whole = F.rtrim(F.regexp_replace(text, r"\s+$", ""))
    kind, to = F.regexp_extract(whole, SEE, 2), F.regexp_extract(whole, SEE, 3)
    cut = F.when(kind != "", F.regexp_replace(F.regexp_extract(whole, SEE, 1), r"[ ,.;(]+$", "")).otherwise(whole)
    also = kind.rlike("(?i)also|tambi")
    refs = F.regexp_extract(cut, REFS, 2)
    term = F.when(refs != "", F.regexp_replace(F.regexp_extract(cut, REFS, 1), "[ ,]+$", "")).otherwise(cut)
    return F.struct(
        term.alias("term"), F.when(refs != "", pieces(refs, ",")).otherwise(none).alias("refs"), F.when((kind != "") & ~also, pieces(to, ";")).otherwise(none).alias("see"),
        F.when((kind != "") & also, pieces(to, ";")).otherwise(none).alias("see_also"),
    )


def _has(parts: Column) -> Column:
    return (F.size(parts["refs"]) > 0) | (F.size(parts["see"]) > 0) | (F.size(parts["see_also"]) > 0)


def index(lines: DataFrame, keys: list[str], body_size: float) -> DataFrame:
    """Entries of indexes: keys, ord (of their first line), division, level, term, refs, see, see_also. lines: keys, ord, page, x0, x1, text.

    The smallest indent that SHARED lines have is the step of levels. A line at level 0 begins an entry unless the one before ends
    openly; so do lines after a division's letter. Between two such, each line is read after the ones before it: it goes on with
    the entry if that one's last line ends openly, or is full and the entry has references and a smaller level, or if
    the level would rise by more than one. Such a stretch is an entry with what is below it, and is folded. Long lines without
    references before the first entry are an introduction, and lines there that name an index, in body size or larger (where
    lines have a size), its title. In the end a level is at most one below the entry before."""
    sized = F.col("size") >= body_size if "size" in lines.columns else F.lit(False)
    rows = lines.withColumn("ord", F.col("ord").cast("long")).withColumn("_text", F.trim(F.coalesce("text", F.lit("")))).where("_text <> ''").withColumn("_titled", F.coalesce(sized, F.lit(False)) & F.col("_text").rlike(INDEX_TITLE))
    rows = _place(rows, keys, INDEX_COLUMN).withColumn("_indent", F.col("x0") - F.col("left"))
    shared = rows.where("_indent > 1").groupBy(*keys, F.bround("_indent").alias("_d")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= SHARED)
    steps = shared.groupBy(*keys).agg(F.min("_d").alias("_d")).select(*[F.col(k).alias(f"_s_{k}") for k in keys], "_d")
    rows = rows.join(steps, tree.same(keys, "_s_"), "left").drop(*[f"_s_{k}" for k in keys])
    step = F.greatest(F.coalesce("_d", F.lit(float(body_size))), F.lit(0.6 * body_size))
    rows = rows.withColumn("_level", F.greatest(F.lit(0), F.bround(F.col("_indent") / step)).cast("int")).withColumn("_letter", F.col("_text").rlike(LETTER))
    rows = rows.withColumn("_parts", index_parts(F.col("_text"))).withColumn("_full", F.col("x1") >= F.col("right") - FULL * body_size).withColumn("_ends_open", F.rtrim("text").rlike("[,(;–-]$"))
    starts = F.when(~F.col("_titled") & (F.col("_letter") | _has(F.col("_parts")) | (F.length("_text") <= INTRODUCTION)), F.col("ord"))
    begun = rows.groupBy(*keys).agg(F.min(starts).alias("_first")).select(*[F.col(k).alias(f"_s_{k}") for k in keys], "_first")
    rows = rows.join(begun, tree.same(keys, "_s_")).where(F.col("ord") >= F.col("_first")).drop("_first", *[f"_s_{k}" for k in keys])
    rows = _follow(written(rows, "index"), keys, "_ends_open", "_letter")
    sure = F.col("_letter") | F.col("_prev").isNull() | F.col("_prev._letter") | ((F.col("_level") == 0) & ~F.col("_prev._ends_open"))
    rows = rows.withColumn("_sure", sure.cast("long")).withColumn("_mark", F.when(F.col("_letter"), F.col("ord")))
    rows = ordered.sums_before(written(rows, "sure"), keys, "ord", "_sure", "_b").withColumn("_part", F.col("_b") + F.col("_sure"))
    line = F.struct("ord", F.col("_level").alias("level"), F.col("_text").alias("raw"), F.col("_full").alias("full"), F.col("_ends_open").alias("open"), F.col("_letter").alias("letter"))
    held = rows.groupBy(*keys, "_part").agg(F.array_sort(F.collect_list(line)).alias("_all"))
    shape = "array<struct<ord:bigint,level:int,raw:string,full:boolean,open:boolean>>"
    entry = lambda o, level, raw, l: F.struct(o.alias("ord"), level.alias("level"), raw.alias("raw"), l["full"].alias("full"), l["open"].alias("open"))

    def fold(found: Column, l: Column) -> Column:
        e = F.element_at(found, -1)
        on = e["open"] | (e["full"] & (l["level"] > e["level"]) & _has(index_parts(e["raw"]))) | (l["level"] > e["level"] + 1)
        joined = F.concat(e["raw"], F.when(F.endswith(e["raw"], F.lit("-")), "").otherwise(" "), l["raw"])
        return F.when(F.size(found) > 0, F.when(on, F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(entry(e["ord"], e["level"], joined, l)))).otherwise(F.array_append(found, entry(l["ord"], l["level"], l["raw"], l)))).otherwise(F.array(entry(l["ord"], l["level"], l["raw"], l)))

    plain = F.filter("_all", lambda l: ~l["letter"])
    found = held.select(*keys, "_part", F.explode(F.aggregate(plain, F.array().cast(shape), fold)).alias("e")).select(*keys, "_part", "e.*").withColumn("_parts", index_parts(F.col("raw")))
    letters = rows.where("_letter").select(*keys, F.col("ord").alias("ord"), F.struct("ord", F.col("_text").alias("text")).alias("_mark"))
    both = found.select(*keys, "_part", "ord", "level", "_parts").unionByName(letters, allowMissingColumns=True)
    # The last letter before an entry: orders are longs, and a letter's number is larger than those of the letters before it.
    both = written(both.withColumn("_at", F.when(F.col("_mark").isNotNull(), F.col("ord"))), "entries")
    marked = ordered.running_before(both, keys, "ord", "_at", "_of", "max").where("_mark is null")
    named = letters.select(*[F.col(k).alias(f"_l_{k}") for k in keys], F.col("ord").alias("_l_ord"), F.col("_mark.text").alias("division"))
    marked = marked.join(named, tree.same(keys, "_l_") & (F.col("_of") == F.col("_l_ord")), "left").drop(*[f"_l_{k}" for k in keys], "_l_ord")
    # An entry is at most one below the one before: level less place is at most the least of those before, so that
    # a stretch from one of level 0 on is enough.
    run = Window.partitionBy(*keys, "_part").orderBy("ord")
    place = F.row_number().over(run) - 1
    marked = marked.withColumn("_place", place)
    allowed = F.least(F.min(F.col("level") - F.col("_place")).over(run.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_place"), F.col("_place"))
    return marked.withColumn("level", allowed.cast("int")).select(*keys, "ord", "division", "level", "_parts.*")
