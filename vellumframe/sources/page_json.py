"""Pages of extracted layout as JSON, one object a line or a file, read with a fixed schema into flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spans are arrays of eleven places, of several types; read as text and projected by index.
SCHEMA = """v string, pdf string, pdf_page int, w double, h double, trim array<double>, rot int, orig array<double>,
    ocr boolean, ocr_conf double, errors array<string>,
    images array<struct<bbox: array<double>, xref: int, w: int, h: int, full: array<double>, std: double>>,
    drawings array<struct<bbox: array<double>, n: int, kinds: string, fill: boolean, hline: boolean, vline: boolean>>,
    lines array<struct<b: array<double>, r: string, c: double, o: boolean, s: array<array<string>>>>, _corrupt_record string"""


def read(spark: SparkSession, path: str, book: Column | None = None) -> DataFrame:
    """Page objects; a record that can't be read keeps its text in _corrupt_record. book: by default the file's name."""
    rows = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.withColumn("book_id", book if book is not None else F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.jsonl?)?$", 1))


def box(values) -> Column:
    return F.struct(*[F.get(values, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


def span(s) -> Column:
    at = lambda i: F.get(s, F.lit(i))
    flag = lambda i: F.lower(at(i)).isin("true", "1")
    names = ("bold", "italic", "sup", "sub", "sc", "mono")
    return F.struct(at(0).alias("text"), at(1).alias("font"), at(2).try_cast("double").alias("size"), *[flag(3 + i).alias(n) for i, n in enumerate(names)], at(9).try_cast("int").alias("color"), box(F.from_json(at(10), "array<double>")).alias("bbox"))


def pages(df: DataFrame) -> DataFrame:
    """One row per page. The page of a book is the number of its record by file and place there."""
    return df.where("_corrupt_record is null").select("book_id", "pdf", F.col("pdf_page").alias("page"), F.col("w").alias("width"), F.col("h").alias("height"), box("trim").alias("trim"), F.coalesce("rot", F.lit(0)).alias("rot"), F.coalesce("ocr", F.lit(False)).alias("is_ocr"), "ocr_conf", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))


def lines(df: DataFrame) -> DataFrame:
    """One row per line: text is its spans put together; main is the first longest span that is no script nor blank."""
    rows = df.select("book_id", "pdf", F.col("pdf_page").alias("page"), F.posexplode("lines").alias("line_no", "l"))
    rows = rows.select("book_id", "pdf", "page", "line_no", F.concat_ws(":", "page", "line_no").alias("uid"), box("l.b").alias("bbox"), F.coalesce("l.r", F.lit("body")).alias("role"), F.col("l.c").alias("conf"), F.coalesce("l.o", F.lit(False)).alias("ocr"), F.transform("l.s", span).alias("spans"))
    plain = F.filter("spans", lambda s: ~s["sup"] & ~s["sub"] & (F.trim(s["text"]) != ""))
    from_ = F.when(F.size(plain) > 0, plain).otherwise(F.col("spans"))
    main = F.aggregate(from_, F.get(from_, F.lit(0)), lambda a, s: F.when(F.length(s["text"]) > F.length(a["text"]), s).otherwise(a))
    main = F.when(F.size(plain) > 0, main).otherwise(F.get(F.col("spans"), F.lit(0)))
    chars = lambda test: F.aggregate("spans", F.lit(0), lambda a, s: a + F.when((F.trim(s["text"]) != "") & test(s), F.length(s["text"])).otherwise(0))
    total = chars(lambda s: F.lit(True))
    share = lambda name: (total > 0) & (chars(lambda s: s[name]) >= 0.85 * total)
    rows = rows.withColumn("main", main)
    return rows.select("*", F.array_join(F.transform("spans", lambda s: s["text"]), "").alias("text"), F.col("main.font").alias("main_font"), F.col("main.size").alias("main_size"), F.col("main.color").alias("main_color"), share("bold").alias("all_bold"), share("italic").alias("all_italic")).drop("main")


def spans(lines_df: DataFrame) -> DataFrame:
    return lines_df.select("book_id", "page", "line_no", "role", F.posexplode("spans").alias("span_no", "s")).select("book_id", "page", "line_no", "role", "span_no", "s.*")


def images(df: DataFrame) -> DataFrame:
    return df.select("book_id", F.col("pdf_page").alias("page"), F.posexplode("images").alias("idx", "i")).select("book_id", "page", "idx", box("i.bbox").alias("bbox"), "i.xref", "i.w", "i.h", "i.std")


def drawings(df: DataFrame) -> DataFrame:
    return df.select("book_id", F.col("pdf_page").alias("page"), F.posexplode("drawings").alias("idx", "d")).select("book_id", "page", "idx", box("d.bbox").alias("bbox"), "d.n", "d.kinds", "d.fill", "d.hline", "d.vline")


def failures(df: DataFrame) -> DataFrame:
    """Records that couldn't be read, as issues."""
    return df.where("_corrupt_record is not null").select("book_id", F.lit("PAGE_FAILED").alias("code"), F.lit("error").alias("severity"), F.substring("_corrupt_record", 1, 200).alias("message"))


def needs_ocr(pages_df: DataFrame, lines_df: DataFrame, images_df: DataFrame, least: int = 40) -> DataFrame:
    """book_id, page, needs_ocr, kind: few characters, and an image over half of the trimmed page."""
    chars = lines_df.where("role <> 'slug'").groupBy("book_id", "page").agg(F.sum(F.length(F.trim("text"))).alias("_chars"))
    area = images_df.groupBy("book_id", "page").agg(F.max((F.col("bbox.x1") - F.col("bbox.x0")) * (F.col("bbox.y1") - F.col("bbox.y0"))).alias("_area"))
    rows = pages_df.join(chars, ["book_id", "page"], "left").join(area, ["book_id", "page"], "left")
    trim = (F.col("trim.x1") - F.col("trim.x0")) * (F.col("trim.y1") - F.col("trim.y0"))
    few, large = F.coalesce("_chars", F.lit(0)) < least, F.coalesce(F.col("_area") > 0.5 * trim, F.lit(False))
    kind = F.when(few & large, "scanned").when(~few, "text").when(F.col("_area").isNotNull(), "image-only").otherwise("blank")
    return rows.select("book_id", "page", (few & large).alias("needs_ocr"), kind.alias("kind"))
