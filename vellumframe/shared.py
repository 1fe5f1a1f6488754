"""Tables written once to the shared folder, so that what is behind them is computed once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a partition, on average: of plain rows, of short texts to parse, of whole texts.
PART_ROWS, SHORT_TEXTS, TEXTS = 100_000, 2_500, 1_000


def dealt(df: DataFrame, rows: int, *keys: str, each: int = PART_ROWS) -> DataFrame:
    """df in partitions by keys, as many as so many rows need: what a task holds keeps its size, and a file that is read as one
    piece is worked on by many tasks."""
    return df.repartition(max(1, -(-rows // each)), *keys)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, as in local tests, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vellumframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows, written as Parquet and read again: later steps read columns of files, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/vellumframe/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
