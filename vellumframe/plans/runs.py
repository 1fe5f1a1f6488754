"""End-to-end runs: a corpus of markup analysed, documents validated, page layouts read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumframe.operators import layout, mining, validate
from vellumframe.sources import markup, page_json


def read_markup(spark: SparkSession, path: str, kind: str = "xml") -> DataFrame:
    """dom of files below a folder; of files with equal content the first path stays."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{kind}").text(path).select(F.col("_metadata.file_path").alias("doc"), "value")
    first = files.groupBy(F.sha1("value").alias("sha")).agg(F.min_by(F.struct("doc", "value"), "doc").alias("f")).select("f.doc", "f.value")
    return markup.dom(first, "doc", "value", kind)


def analyze(dom: DataFrame, out: str) -> dict[str, str]:
    """Writes the tables that say what a corpus does; name -> path."""
    tables = {
        "elements": mining.elements(dom, "doc"), "attributes": mining.attributes(dom), "id_shapes": mining.id_shapes(dom, "doc"), "link_patterns": mining.link_patterns(dom, "doc"),
        "external_links": mining.external_links(dom, "doc"), "structure": mining.structure(dom, "doc"), "placement": mining.placement(dom, "doc"), "profiles": mining.profiles(dom, "doc"),
    }
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{out}/{name}"
        df.write.mode("overwrite").parquet(paths[name])
    return paths


def check(dom: DataFrame, prefix: str, coverage: DataFrame | None = None, issues: DataFrame | None = None, images: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """doc, counts of defects, critical and status. coverage: doc, coverage. issues: doc, severity. images: doc, name of the files that
    are there. pages: doc, page, status, FAIL for those that failed.

    Images that graphics name (href) are missing unless images has them. What wasn't measured isn't taken as good: a document
    without a coverage, without images or without pages has a finding of its own, "coverage not measured" and the like, among
    its warnings."""
    per = lambda df, **named: df.groupBy("doc").agg(*[F.count_if(cond).alias(n) for n, cond in named.items()])
    ids = per(validate.ids(dom, "doc", prefix), duplicate_ids=F.col("defect") == "duplicate", invalid_ids=F.col("defect") == "invalid", pattern_ids=F.col("defect") == "pattern")
    links = per(validate.links(dom, "doc"), broken_links=F.col("status") == "broken", wrong_links=F.col("status") == "wrong_type")
    parsed = per(dom, dtd_errors=F.col("tag") == "#error")
    rows = parsed.join(ids, "doc", "left").join(links, "doc", "left")
    rows = rows.join(coverage.select("doc", "coverage"), "doc", "left") if coverage is not None else rows.withColumn("coverage", F.lit(None).cast("double"))
    named = dom.where(F.col("tag").isin("graphic", "inline-graphic") & F.col("attrs")["href"].isNotNull()).select("doc", F.regexp_extract(F.col("attrs")["href"], "([^/]*)$", 1).alias("name")).distinct()
    if images is not None:
        there = images.select("doc", F.regexp_extract("name", "([^/]*)$", 1).alias("name")).distinct()
        rows = rows.join(per(named.join(there, ["doc", "name"], "left_anti"), missing_images=F.lit(True)), "doc", "left").withColumn("_images", F.lit(True))
    else:
        rows = rows.join(named.groupBy("doc").agg(F.lit(False).alias("_images")), "doc", "left").withColumn("missing_images", F.lit(0)).withColumn("_images", F.coalesce("_images", F.lit(True)))
    if pages is not None:
        rows = rows.join(pages.groupBy("doc").agg(F.count_if(F.col("status") == "FAIL").alias("failed_pages"), F.lit(True).alias("_pages")), "doc", "left").withColumn("_pages", F.coalesce("_pages", F.lit(False)))
    else:
        rows = rows.withColumns({"failed_pages": F.lit(0), "_pages": F.lit(False)})
    counted = per(issues, errors=F.col("severity").isin("error", "critical"), warnings=F.col("severity") == "warning") if issues is not None else None
    rows = rows.join(counted, "doc", "left") if counted is not None else rows.withColumns({"errors": F.lit(0), "warnings": F.lit(0)})
    unmeasured = F.array_compact(F.array(F.when(F.col("coverage").isNull(), "coverage not measured"), F.when(~F.col("_images"), "images not measured"), F.when(~F.col("_pages"), "pages not measured")))
    rows = rows.withColumn("unmeasured", unmeasured).drop("_images", "_pages")
    numbers = [c for c, t in rows.dtypes if t in ("bigint", "int")]
    rows = rows.na.fill(0, numbers).withColumn("warnings", F.col("warnings") + F.size("unmeasured"))
    return validate.gate(rows.withColumn("_coverage", F.col("coverage")).na.fill(1.0, ["coverage"])).withColumn("coverage", F.col("_coverage")).drop("_coverage")


def read_layout(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """pages, lines with roles, spans, style, pitch, folios and issues of page JSON."""
    book = page_json.read(spark, path)
    good = book.where("_corrupt_record is null")
    pages, lines = page_json.pages(good), page_json.lines(good)
    marked = layout.running_heads(lines, pages)
    style = layout.body_style(page_json.spans(marked))
    return {"pages": pages, "lines": marked, "spans": page_json.spans(marked), "style": style, "pitch": layout.line_pitch(marked, style.select("book_id", "body_size")), "folios": layout.folios(marked, pages), "issues": page_json.failures(book)}
