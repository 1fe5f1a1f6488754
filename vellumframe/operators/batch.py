"""Batches that resume: which inputs are still to do, and their state as a table of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States in which a book is finished.
FINISHED = ("PASS", "PASS WITH WARNINGS", "FAILED")


def latest(state: DataFrame) -> DataFrame:
    """book, status, input_hash: of each book's records the one with the largest version."""
    return state.groupBy("book").agg(F.max_by(F.struct("status", "input_hash"), "version").alias("_s")).select("book", "_s.status", "_s.input_hash")


def pending(inputs: DataFrame, state: DataFrame) -> DataFrame:
    """Inputs (book, input_hash) whose latest record isn't finished with the same hash."""
    done = latest(state).where(F.col("status").isin(*FINISHED)).select("book", "input_hash")
    return inputs.join(done, ["book", "input_hash"], "left_anti")


def interrupted(state: DataFrame) -> DataFrame:
    return latest(state).where("status = 'RUNNING'").select("book")
