"""Gaps and islands: runs of close values, and gaps that no interval covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumframe.operators.ordered import bucket, cuts, running_before, same_bucket


def runs(df: DataFrame, keys: list[str], at: str, gap: float, order: list[str]) -> DataFrame:
    """df with run: 0-based; a new run begins where `at` is more than gap after the row before. `at` holds no nulls.

    Runs are numbered within buckets of a key; buckets know their first and last value and how many runs begin inside, which
    tells how many have begun before each and whether one begins at its head. df is read for the buckets' bounds and then
    once for rows and once for ends."""
    rows = df.withColumn("_at", F.floor(F.col(at)).cast("long"))
    rows = rows.withColumn("_bucket", bucket(F.col("_at"), cuts(rows, "_at")))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(at, *order)
    rows = rows.withColumn("_new", F.coalesce(F.col(at) - F.lag(at).over(inside) > gap, F.lit(False)).cast("long"))
    rows = rows.withColumn("_own", F.sum("_new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(*keys, "_bucket").agg(F.min(at).alias("_first"), F.max(at).alias("_end"), F.max("_own").alias("_inside"))
    along = Window.partitionBy(*keys).orderBy("_bucket")
    ends = ends.withColumn("_head", F.coalesce(F.col("_first") - F.lag("_end").over(along) > gap, F.lit(False)).cast("long"))
    before = F.coalesce(F.sum(F.col("_head") + F.col("_inside")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = ends.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_bucket").alias("_of_bucket"), (before + F.col("_head")).alias("_base"))
    return rows.join(above, same_bucket(keys)).withColumn("run", F.col("_base") + F.col("_own")).drop("_at", "_bucket", "_new", "_own", "_base", "_of_bucket", *[f"_of_{k}" for k in keys])


def merged(df: DataFrame, keys: list[str], at: str, gap: float, order: list[str]) -> DataFrame:
    """keys, run, start, end, n of each run."""
    return runs(df, keys, at, gap, order).groupBy(*keys, "run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count(F.lit(1)).alias("n"))


def gutters(df: DataFrame, keys: list[str], begin: str, end: str, least) -> DataFrame:
    """keys, gap_start, gap_end: stretches of at least `least` between intervals that nothing covers. Equal intervals are
    taken once before the window."""
    rows = df.select(*keys, begin, end).distinct().withColumn("_at", F.floor(F.col(begin)).cast("long"))
    rows = running_before(rows, keys, "_at", end, "gap_start", "max", (begin, end)).withColumn("gap_end", F.col(begin))
    return rows.where(F.col("gap_end") - F.col("gap_start") >= least).select(*keys, "gap_start", "gap_end")


def covered(a0, a1, b0, b1):
    """Length of the overlap of two intervals, at least 0."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
