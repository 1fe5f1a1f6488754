"""Statistics of page layout: body style, line pitch, running heads, printed page numbers, paragraph starts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumframe.functions import text as T
from vellumframe.operators import modes
from vellumframe.operators.ordered import counts_near

#: Fixed values of the rules below.
ZONE, WINDOW, REPEATS, HEAD_CHARS = 0.085, 12, 3, 160
DISPLAY_RATIO, DISPLAY_CHARS = 1.4, 120
SAME_COLUMN, SAME_SIZE = 30, 0.6
#: Words that begin captions, and words that alone are display labels.
LABELS = {
    "fig": r"FIGURA\s+T[ÉE]CNICA|Figura\s+t[ée]cnica|Fig\.\s+t[ée]cnica|FIGURA(?:\s+DE\s+REVISI[ÓO]N)?|Figura(?:\s+de\s+revisi[óo]n)?|FIGURES?|Figures?|FIG\.|Fig\.|FIGURE|Ilustraci[óo]n|L[áa]mina|Plate|PLATE|Image|IMAGEN|Imagen|Abbildung|Abb\.|Gráfico|Gráfica",
    "table": r"TABLA|Tabla|TABLE|Table|TABELLE|Tabelle|Tableau|TABLEAU|Tabela|TABELA",
    "box": r"BOX|Box|RECUADRO|Recuadro|CUADRO|Cuadro|ENCUADRE|Encuadre|Communication in Action|Evidence-Based Practice|Clinical Problem",
}
NUMBER = r"(?:[A-Z]{1,2}[-.–]?)?[0-9]+(?:\s?[.\-–]\s?[0-9]+)*[A-Za-z]?"
NUMERIC = r"^[0-9]{1,4}$"


def label(line):
    """STRUCT<kind, word, number> of a caption's label at the start of a line, or null."""
    found = F.lit(None).cast("struct<kind: string, word: string, number: string>")
    for kind, words in reversed(LABELS.items()):
        pattern = rf"^\s*({words})\s*({NUMBER})"
        found = F.when(line.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, pattern, 1).alias("word"), F.regexp_extract(line, pattern, 2).alias("number"))).otherwise(found)
    return found


def body_style(spans: DataFrame) -> DataFrame:
    """book_id, body_family, body_size: the family and size, to half points, that most characters of body text have."""
    rows = spans.where("role = 'body' and not sup and not sub").select("book_id", F.struct(T.family(F.col("font")).alias("family"), (F.bround(F.col("size") * 2) / 2).alias("size")).alias("style"), F.length(F.trim("text")).cast("long").alias("w"), (F.col("page").cast("long") * (1 << 32) + F.col("line_no") * (1 << 12) + F.col("span_no")).alias("at"))
    return modes.weighted_mode(rows, ["book_id"], "style", F.col("w"), F.col("at")).select("book_id", F.col("mode.family").alias("body_family"), F.col("mode.size").alias("body_size"))


def line_pitch(lines: DataFrame, style: DataFrame, pages: int | None = None) -> DataFrame:
    """book_id, pitch: the upper median of the steps between body lines of a column, else 1.2 times the size. style: one
    row for each book. pages: only lines of a book's first pages count, if given; 400 is what makers of such rules take."""
    rows = lines.where(F.col("role") == "body" if pages is None else (F.col("role") == "body") & (F.col("page") < pages)).join(style, "book_id")
    before = lambda c: F.lag(c).over(Window.partitionBy("book_id", "page").orderBy(F.bround(F.col("bbox.x0") / 40), "bbox.y1", "line_no"))
    near = lambda c: F.abs(c - F.col("body_size")) <= SAME_SIZE
    rows = rows.withColumn("step", F.col("bbox.y1") - before(F.col("bbox.y1"))).withColumn("ok", near(F.col("main_size")) & near(before(F.col("main_size"))) & (F.abs(F.col("bbox.x0") - before(F.col("bbox.x0"))) < SAME_COLUMN))
    steps = rows.where(F.col("ok") & (F.col("step") > 0.8 * F.col("body_size")) & (F.col("step") < 2.2 * F.col("body_size")))
    found = modes.upper_median(steps, ["book_id"], "step", "pitch").select("book_id", "pitch")
    return style.join(found, "book_id", "left").select("book_id", F.coalesce("pitch", F.col("body_size") * 1.2).alias("pitch"))


def zones(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines that lie in a page's head or foot zone, with `zone`; vertical marks on the margin are in neither."""
    trim = pages.select(F.col("book_id").alias("_b"), F.col("page").alias("_p"), F.col("trim.y0").alias("_top"), F.col("trim.y1").alias("_foot"))
    rows = lines.join(trim, (F.col("book_id") == F.col("_b")) & (F.col("page") == F.col("_p")))
    depth = ZONE * (F.col("_foot") - F.col("_top"))
    zone = F.when(F.col("bbox.y1") <= F.col("_top") + depth + 2, "header").when(F.col("bbox.y0") >= F.col("_foot") - depth - 2, "footer")
    return rows.withColumn("zone", F.when(F.col("role") != "slug", zone)).drop("_b", "_p", "_top", "_foot")


def page_number(text):
    return text.rlike(NUMERIC) | T.is_roman(text)


def running_heads(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """lines with role header, footer or folio where a line is one.

    In the zones: numbers and numerals are folios; display sizes and captions stay; what recurs on REPEATS pages within
    WINDOW pages, but for numbers, is a running head; so is what has the font, size and height of REPEATS of these.
    Repeats are counted before any role changes.
    """
    rows = zones(lines, pages).withColumn("_text", F.trim("text")).withColumn("_norm", T.norm_repeat(F.col("text")))
    median = modes.upper_median(lines.where("role not in ('slug', 'rotated-margin')"), ["book_id", "page"], "main_size", "_median").drop("at").select(F.col("book_id").alias("_b"), F.col("page").alias("_p"), "_median")
    near = counts_near(rows.where("zone is not null"), ["book_id", "zone", "_norm"], "page", WINDOW, "_near").select(F.col("book_id").alias("_b2"), F.col("zone").alias("_z"), F.col("_norm").alias("_n"), F.col("page").alias("_p2"), "_near")
    rows = rows.join(median, (F.col("book_id") == F.col("_b")) & (F.col("page") == F.col("_p")), "left").drop("_b", "_p")
    rows = rows.join(near, (F.col("book_id") == F.col("_b2")) & (F.col("zone") == F.col("_z")) & (F.col("_norm") == F.col("_n")) & (F.col("page") == F.col("_p2")), "left").drop("_b2", "_z", "_n", "_p2")
    closed = T.collapse_spaced(F.col("_text"))
    caption = label(F.col("_text")).isNotNull() | label(closed).isNotNull() | closed.rlike("^(?i)(tabla|table|figura|figure|cuadro|box|recuadro)$")
    display = (F.col("main_size") >= DISPLAY_RATIO * F.col("_median")) & (F.length("_text") < DISPLAY_CHARS)
    margin = F.when(F.col("role") == "rotated-margin", F.when(page_number(F.col("_text")), "folio").otherwise("header"))
    first = F.coalesce(margin, F.when(F.col("zone").isNull(), F.col("role")).when(page_number(F.col("_text")), "folio").when(F.coalesce(display, F.lit(False)) | caption, F.col("role")).when((F.col("_near") >= REPEATS) & (F.length("_text") < HEAD_CHARS), F.col("zone")).otherwise(F.col("role")))
    rows = rows.withColumn("_first", first).withColumn("_sign", F.struct("zone", F.get("spans", F.lit(0))["font"].alias("font"), F.bround("main_size", 1).alias("size"), F.bround(F.col("bbox.y0") / 2).alias("at")))
    signs = rows.where("_first = zone").groupBy("book_id", "_sign").agg(F.count(F.lit(1)).alias("_like")).select(F.col("book_id").alias("_b"), F.col("_sign").alias("_s"), "_like")
    rows = rows.join(signs, (F.col("book_id") == F.col("_b")) & (F.col("_sign") == F.col("_s")), "left")
    role = F.when(F.col("zone").isNotNull() & ~F.col("_first").isin("header", "footer", "folio") & (F.length("_text") < HEAD_CHARS) & (F.col("_like") >= REPEATS), F.col("zone")).otherwise(F.col("_first"))
    return rows.withColumn("role", role).select(*lines.columns)


def folios(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """book_id, page, folio, conf: printed page numbers, read and fitted to each file's sequence.

    lines have roles; pages have pdf and page. The first number of a page counts (0.9 if it is the only one, else 0.6).
    The most frequent offset from the page fills missing numbers (0.7) and, where at least three agree, repairs others
    (0.6); numerals stand before the numbered pages. Of pages of a book with one folio the first keeps it.
    """
    roles = ("folio", "header", "footer", "header-iso", "footer-iso")
    text = F.trim("text")
    edge = F.coalesce(F.nullif(F.regexp_extract(text, r"^([0-9]{1,4})\s+\S", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"\S\s+([0-9]{1,4})$", 1), F.lit("")))
    span = lambda i: F.when(F.trim(F.element_at("spans", i)["text"]).rlike(NUMERIC), F.trim(F.element_at("spans", i)["text"]))
    found = F.when(page_number(text), F.lower(text)).when(F.col("role") != "folio", F.coalesce(edge, span(1), span(-1)))
    read = lines.where(F.col("role").isin(*roles)).withColumn("f", found).where("f is not null").groupBy("book_id", "page").agg(F.min_by("f", "line_no").alias("folio"), F.countDistinct("f").alias("n"))
    rows = pages.select("book_id", "pdf", "page").join(read, ["book_id", "page"], "left").withColumn("conf", F.when(F.col("folio").isNotNull(), F.when(F.col("n") == 1, 0.9).otherwise(0.6))).drop("n")
    number = F.when(F.col("folio").rlike("^[0-9]+$"), F.col("folio").try_cast("int"))
    numeral = F.when(F.col("folio").isNotNull() & number.isNull(), T.roman_value(F.col("folio")))
    rows = rows.withColumns({"num": number, "rom": numeral})
    offset = lambda column, name: modes.weighted_mode(rows.where(F.col(column).isNotNull()).withColumn("off", F.col(column) - F.col("page")), ["book_id", "pdf"], "off", F.lit(1).cast("long"), F.col("page").cast("long")).select("book_id", "pdf", F.col("mode").alias(f"{name}_off"), F.col("weight").alias(f"{name}_n"))
    rows = rows.join(offset("num", "num"), ["book_id", "pdf"], "left").join(offset("rom", "rom"), ["book_id", "pdf"], "left")
    rows = rows.withColumn("expect", F.col("page") + F.col("num_off"))
    starts = rows.where("num = expect").groupBy("book_id", "pdf").agg(F.min("page").alias("first"))
    rows = rows.join(starts, ["book_id", "pdf"], "left")
    in_run = F.col("num_off").isNotNull() & (F.col("expect") >= 1) & ~((F.col("page") < F.col("first")) & F.col("rom_off").isNotNull())
    fill = in_run & F.col("num").isNull() & (F.col("rom").isNull() | (F.col("page") >= F.col("first")))
    fix = in_run & F.col("num").isNotNull() & (F.col("num") != F.col("expect")) & (F.col("num_n") >= 3)
    rows = rows.withColumns({"folio2": F.when(fill | fix, F.col("expect").cast("string")).otherwise(F.col("folio")), "conf2": F.when(fill, 0.7).when(fix, 0.6).otherwise(F.col("conf"))})
    earlier = rows.where("folio2 rlike '^[0-9]+$'").groupBy("book_id", "pdf").agg(F.min("page").alias("numbered"))
    rows = rows.join(earlier, ["book_id", "pdf"], "left")
    roman = F.col("folio2").isNull() & F.col("rom_off").isNotNull() & (F.col("page") + F.col("rom_off") >= 1) & (F.col("numbered").isNull() | (F.col("numbered") > F.col("page")))
    rows = rows.withColumns({"folio3": F.when(roman, T.to_roman(F.col("page") + F.col("rom_off"))).otherwise(F.col("folio2")), "conf3": F.when(roman, 0.6).otherwise(F.col("conf2"))})
    keep = rows.where("folio3 is not null").groupBy("book_id", "folio3").agg(F.min(F.struct("pdf", "page")).alias("kept"))
    rows = rows.join(keep, ["book_id", "folio3"], "left")
    again = F.col("folio3").isNotNull() & (F.struct("pdf", "page") != F.col("kept"))
    return rows.select("book_id", "pdf", "page", F.when(~again, F.col("folio3")).alias("folio"), F.when(again, F.least("conf3", F.lit(0.3))).otherwise(F.col("conf3")).alias("conf"), F.when(again, F.concat(F.lit("DUPLICATE_FOLIO:"), "folio3")).alias("error"))
