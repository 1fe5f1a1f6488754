"""Order over all rows of a large table without one task that holds them: ids are taken in buckets of buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: An id bucket holds at most 2**10 different ids, a bucket of buckets 2**16 of them, and so on up to all 64 bits.
FIRST, NEXT = 10, 16


def bucket(column, shift: int = FIRST):
    return F.shiftright(column, shift)


def starts(df: DataFrame, key: str, value: str, shift: int = FIRST) -> DataFrame:
    """df with start, the sum of value over all rows with a smaller key (of equal keys in any order). Null keys come first."""
    if shift > 64:  # at most 2**6 keys are left
        before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn("start", F.coalesce(F.sum(value).over(before), F.lit(0).cast("long")))
    b, total, of, base, own = (f"_{x}{shift}" for x in ("bucket", "sum", "of", "before", "own"))
    rows = df.withColumn(b, bucket(key, FIRST if shift == FIRST else NEXT))
    above = starts(rows.groupBy(b).agg(F.sum(value).alias(total)), b, total, shift + NEXT).select(F.col(b).alias(of), F.col("start").alias(base))
    within = Window.partitionBy(b).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn(own, F.coalesce(F.sum(value).over(within), F.lit(0).cast("long")))
    return placed.join(above, F.col(b).eqNullSafe(F.col(of))).withColumn("start", F.col(own) + F.col(base)).drop(b, of, own, base)


def lower_neighbours(keys: DataFrame, key: str, shift: int = FIRST + NEXT) -> DataFrame:
    """For different, non-null keys: key and lower, the next smaller key, null for the smallest."""
    if shift > 64:
        return keys.select(key, F.lag(key).over(Window.orderBy(key)).alias("lower"))
    b, most, of, under, own = (f"_{x}{shift}" for x in ("bucket", "most", "of", "under", "own"))
    rows = keys.select(key, bucket(key, NEXT).alias(b))
    tops = rows.groupBy(b).agg(F.max(key).alias(most))
    chain = lower_neighbours(tops.select(b), b, shift + NEXT).select(F.col(b).alias(of), F.col("lower").alias(under))
    below = chain.join(tops.withColumnRenamed(b, under), under, "left").select(of, most)
    owned = rows.withColumn(own, F.lag(key).over(Window.partitionBy(b).orderBy(key)))
    return owned.join(below, F.col(b) == F.col(of), "left").select(key, F.coalesce(own, most).alias("lower"))
