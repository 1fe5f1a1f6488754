"""Incremental ingest: files of pages or documents that arrive are read once and counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellumframe.sources import page_json


def files(spark: SparkSession, path: str, schema: StructType | str, per_trigger: int = 1000, format: str = "parquet") -> DataFrame:
    """A stream of a folder's files; each trigger takes a bounded number of them."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def pages(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A stream of page JSON."""
    rows = spark.readStream.schema(page_json.SCHEMA).option("maxFilesPerTrigger", per_trigger).json(path)
    return rows.withColumn("book_id", F.regexp_extract(F.input_file_name(), r"([^/]*?)(?:\.jsonl?)?$", 1))


def upsert(stream: DataFrame, path: str, checkpoint: str, transform=None):
    """Writes each batch once: its number names its folder, so a batch that is run again replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        (transform(batch) if transform else batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window, kind, n with a watermark: state of windows older than `late` is dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, length), kind).agg(F.count(F.lit(1)).alias("n"))
