"""Files as rows: what they are, which book they belong to, and inventories of a project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

#: Part codes of split deliveries with their order in a book.
ORDER = {"fm": 0, "pt": 1, "part": 1, "unit": 1, "sec": 1, "ch": 1, "app": 2, "gloss": 3, "bm": 4, "index": 5, "whole": 1}
PART = r"(?i)(?:^|[-_ .])(fm|bm|ch|sect|sec|pt|part|unit|app|idx)[-_ ]?([0-9]{1,3}|[A-Z](?![A-Za-z]))?(?=[-_. ]|HR|$)"
ISBN = r"(97[89][0-9]{10})"


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modified of files below a folder; contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))


def stem(path) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def part_code(name) -> Column:
    """STRUCT<code, num> of a file's stem: index and glossary first, else the last part code, else whole."""
    codes = F.regexp_extract_all(name, F.lit(PART), F.lit(1))
    numbers = F.regexp_extract_all(name, F.lit(PART), F.lit(2))
    code = F.lower(F.element_at(codes, -1))
    code = F.when(code == "sect", "sec").when(code == "idx", "index").otherwise(code)
    number = F.nullif(F.element_at(numbers, -1), F.lit(""))
    none = F.lit(None).cast("string")
    return (
        F.when(name.rlike(r"(?i)[-_](IND|INDEX|IDX)(?=[-_.]|HR|$)|index"), F.struct(F.lit("index").alias("code"), none.alias("num")))
        .when(name.rlike(r"(?i)[-_](GLOSS|GLOSSARY)"), F.struct(F.lit("gloss").alias("code"), none.alias("num")))
        .when(F.size(codes) > 0, F.struct(code.alias("code"), number.alias("num")))
        .otherwise(F.struct(F.lit("whole").alias("code"), none.alias("num")))
    )


def parts(df: DataFrame) -> DataFrame:
    """path with folder, code, num, isbn and its place in the folder's book."""
    rows = df.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).withColumn("part", part_code(stem(F.col("path")))).withColumn("isbn", F.nullif(F.regexp_extract("path", rf"{ISBN}[^/]*$", 1), F.lit("")))
    rank = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col("part.code")), F.lit(1))
    number = F.when(F.col("part.num").rlike("^[0-9]+$"), F.col("part.num").try_cast("int")).when(F.length("part.num") == 1, F.ascii(F.upper("part.num")) - 64).otherwise(0)
    place = F.row_number().over(Window.partitionBy("folder").orderBy(rank, F.coalesce(number, F.lit(0)), F.lower("path")))
    return rows.select("path", "folder", F.col("part.code").alias("code"), F.col("part.num").alias("num"), "isbn", (place - 1).alias("file_idx"))


def books(df: DataFrame) -> DataFrame:
    """book, kind, n_files: a folder whose files are parts of one ISBN is a book, else each file is one."""
    rows = parts(df)
    split = rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("code") != "whole").alias("n_parts"), F.countDistinct("isbn").alias("n_isbn")).where("n > 1 and n_parts > 0 and n_isbn <= 1")
    single = rows.join(split, "folder", "left_anti").select(F.col("path").alias("book"), F.lit("file").alias("kind"), F.lit(1).cast("long").alias("n_files"))
    return split.select(F.col("folder").alias("book"), F.lit("folder").alias("kind"), F.col("n").alias("n_files")).union(single)


def kinds(df: DataFrame) -> DataFrame:
    """ext, n, bytes: the histogram of a project."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return df.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))


def samples(df: DataFrame) -> DataFrame:
    """isbn, n_pdf, n_xml, status: matched, pdf_only, xml_only or assets_only."""
    rows = df.withColumn("isbn", F.regexp_extract("path", ISBN, 1)).where("isbn <> ''").withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)))
    counts = rows.groupBy("isbn").agg(F.count_if(F.col("ext") == "pdf").alias("n_pdf"), F.count_if(F.col("ext") == "xml").alias("n_xml"), F.count(F.lit(1)).alias("n_files"))
    status = F.when((F.col("n_pdf") > 0) & (F.col("n_xml") > 0), "matched").when(F.col("n_pdf") > 0, "pdf_only").when(F.col("n_xml") > 0, "xml_only").otherwise("assets_only")
    return counts.withColumn("status", status)


def signature(df: DataFrame) -> DataFrame:
    """One row: a digest that changes with any path, size or time. Files are hashed apart and their hashes put together
    by an order-free sum, so nothing is gathered."""
    one = F.conv(F.substring(F.sha1(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modified").cast("string"))), 1, 14), 16, 10).cast("decimal(38,0)")
    return df.agg(F.sha1(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(one), F.lit(0)).cast("string"))).alias("signature"))


def book_hash(df: DataFrame) -> DataFrame:
    """folder, hash: 16 digits over the hashes of a book's files in order. df: folder, file_idx, sha."""
    return df.groupBy("folder").agg(F.substring(F.sha1(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("file_idx", "sha"))), lambda x: x["sha"]), "")), 1, 16).alias("hash"))


def xml_head(text) -> Column:
    """STRUCT<public_id, system_id, root> sniffed from the head of an XML text."""
    doctype = r'<!DOCTYPE\s+\S+\s+PUBLIC\s+"([^"]*)"\s+"([^"]*)"'
    return F.struct(F.nullif(F.regexp_extract(text, doctype, 1), F.lit("")).alias("public_id"), F.nullif(F.regexp_extract(text, doctype, 2), F.lit("")).alias("system_id"), F.nullif(F.regexp_extract(text, r"<([A-Za-z_][\w.:-]*)", 1), F.lit("")).alias("root"))
