"""Modes, medians by index, shares and top lists, with the tie rules of a counter that keeps first-seen order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumframe.operators.ordered import bucket, cuts, same_bucket


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight, order) -> DataFrame:
    """keys, mode, weight: the value with the largest sum of weights; of equal sums, the one seen first by order."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("weight"), F.min(order).alias("_first"))
    best = sums.groupBy(*keys).agg(F.max_by(F.struct(F.col(value).alias("mode"), "weight"), F.struct(F.col("weight"), -F.col("_first"))).alias("_best"))
    return best.select(*keys, "_best.mode", "_best.weight")


def shares(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n, total, share of each value within its keys."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("total")).select(*[F.col(k).alias(f"_{k}") for k in keys], "total")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return counted.join(totals, on).select(*keys, value, "n", "total", (F.col("n") / F.col("total")).alias("share"))


def top_counts(df: DataFrame, keys: list[str], value: str, k: int, order) -> DataFrame:
    """The k most frequent values of each group with their rank; ties by first seen."""
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "first", value))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k).select(*keys, value, "n", "rank")


def at_index(df: DataFrame, keys: list[str], value: str, index, name: str) -> DataFrame:
    """The value at a 0-based index of the sorted values of each group; index: a function of their number. Nulls don't count.

    Values are counted first. Sums of buckets of values tell in which bucket of a group the index lies; only that bucket's
    values are put in order.
    """
    here = df.where(F.col(value).isNotNull())
    bounds = cuts(here.select(F.floor(F.col(value)).cast("long").alias("_order")), "_order")
    counted = here.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", bucket(F.floor(F.col(value)), bounds))
    group = Window.partitionBy(*keys)
    sums = counted.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_of_n"))
    sums = sums.withColumn("_base", F.sum("_of_n").over(group.orderBy("_bucket")) - F.col("_of_n")).withColumn("at", index(F.sum("_of_n").over(group)).cast("long"))
    found = sums.where("at >= _base and at < _base + _of_n").select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_bucket").alias("_of_bucket"), "_base", "at")
    near = counted.join(found, same_bucket(keys))
    before = near.withColumn("_before", F.col("_base") + F.sum("_n").over(Window.partitionBy(*keys).orderBy(value)) - F.col("_n"))
    return before.where((F.col("at") >= F.col("_before")) & (F.col("at") < F.col("_before") + F.col("_n"))).select(*keys, F.col(value).alias(name), "at")


def upper_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Of an even number of values the upper middle one: index n // 2."""
    return at_index(df, keys, value, lambda n: F.floor(n / 2), name)


def right_edge(df: DataFrame, keys: list[str], value: str, name: str, part: float = 0.9) -> DataFrame:
    """The value at index int(part * (n - 1))."""
    return at_index(df, keys, value, lambda n: F.floor(F.lit(part) * (n - 1)), name)
