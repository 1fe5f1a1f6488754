"""Markup written from dom rows: one text for each document, its parts put in order by an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def escaped(text, quote: bool = False):
    t = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(t, F.lit('"'), F.lit("&quot;")) if quote else t


def serialize(dom: DataFrame, doc: str, doctype: str | None = None) -> DataFrame:
    """doc, xml. An element's start stands at its place, its end after all below it; both are rows, sorted in the aggregate
    of one document. Attributes are written by name."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_keys("attrs")), lambda k: F.concat(F.lit(" "), k, F.lit('="'), escaped(F.element_at("attrs", k), True), F.lit('"'))), "")
    empty = (F.col("pre") == F.col("last")) & (F.coalesce("text", F.lit("")) == "")
    tail = escaped(F.coalesce("tail", F.lit("")))
    begin = F.concat(F.lit("<"), "tag", pairs, F.when(empty, "/>").otherwise(F.concat(F.lit(">"), escaped(F.coalesce("text", F.lit(""))))), F.when(empty, tail).otherwise(""))
    end = F.when(~empty, F.concat(F.lit("</"), F.col("tag"), F.lit(">"), tail))
    parts = F.array(F.struct(F.col("pre").alias("at"), F.lit(0).alias("close"), F.lit(0).alias("up"), begin.alias("t")), F.struct(F.col("last").alias("at"), F.lit(1).alias("close"), (-F.col("pre")).alias("up"), end.alias("t")))
    rows = dom.select(doc, F.explode(parts).alias("p")).where("p.t is not null")
    head = F.lit('<?xml version="1.0" encoding="UTF-8"?>\n' + (f"{doctype}\n" if doctype else ""))
    return rows.groupBy(doc).agg(F.concat(head, F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), "")).alias("xml"))


def write(dom: DataFrame, doc: str, path: str, doctype: str | None = None) -> None:
    """A text file set with one document a row, in a folder for each document, by Spark's commit protocol."""
    serialize(dom, doc, doctype).select(F.col(doc).alias("document"), F.col("xml").alias("value")).write.mode("overwrite").partitionBy("document").text(path)
