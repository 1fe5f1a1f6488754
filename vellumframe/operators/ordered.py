"""Ordered computations that hold at scale: a key may own a third of all rows, and no window sees them all at once.

Orders are longs. They are dealt to buckets of about equal numbers of rows, by quantiles of the whole table. A window covers
a bucket of a key; what lies before the bucket comes from sums of buckets, of which a key has BUCKETS at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of an order, in rows of WIDE.
WIDE = 32
BUCKETS = WIDE * WIDE
_LAST = (1 << 63) - 1


def cuts(df: DataFrame, order: str) -> list[int]:
    """BUCKETS ascending upper bounds of buckets of an order. One scan of its column; what comes back has a fixed size."""
    found = df.agg(F.percentile_approx(F.col(order).cast("long"), [i / BUCKETS for i in range(1, BUCKETS)], 10 * BUCKETS)).first()[0] or []
    return [*sorted(found), *[_LAST] * (BUCKETS - len(found))]


def bucket(order: Column, bounds: list[int]) -> Column:
    """How many bounds are smaller than an order: first among the last of each row of bounds, then in its row. Null orders are
    in the first bucket."""
    rows = [bounds[i : i + WIDE] for i in range(0, BUCKETS, WIDE)]
    at = order.cast("long")
    below = lambda values: F.coalesce(F.array_position(F.sort_array(F.array_append(values, at)), at) - 1, F.lit(0)).cast("int")
    row = below(F.lit([r[-1] for r in rows]))
    return row * WIDE + below(F.get(F.array(*[F.lit(r) for r in rows]), row))


def same_bucket(keys: list[str]) -> Column:
    """Joins rows with what is known of their bucket, whose columns begin with _of_."""
    on = F.col("_bucket") == F.col("_of_bucket")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return on


def running_before(df: DataFrame, keys: list[str], order: str, value: str, name: str, how: str = "sum", ties: tuple[str, ...] = (), like: DataFrame | None = None) -> DataFrame:
    """df with `name`, over the rows of the same keys that come before by order (a long) and ties: the sum of value, its
    maximum, or the last one. Without such rows 0 for the sum, else null; value holds no nulls. Rows alike in order and
    ties come in any order. like: a cheaper table whose column `order` is distributed as that of df."""
    over = {"sum": F.sum, "max": F.max, "last": F.last}[how](value)
    first = F.lit(0) if how == "sum" else F.lit(None)
    rows = df.withColumn("_bucket", bucket(F.col(order), cuts(df if like is None else like, order)))
    whole = F.max_by(value, F.struct(order, *ties)) if how == "last" else over
    sums = rows.groupBy(*keys, "_bucket").agg(whole.alias("_all"))
    base = {"sum": F.sum, "max": F.max, "last": F.last}[how]("_all").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    # What lies before a bucket is one more row, at its head: rows are moved once, and not joined.
    above = sums.select(*keys, "_bucket", F.lit(0).alias("_row"), F.coalesce(base, first).alias("_step"))
    both = rows.withColumn("_row", F.lit(1)).withColumn("_step", F.col(value)).unionByName(above, allowMissingColumns=True)
    own = {"sum": F.sum, "max": F.max, "last": F.last}[how]("_step").over(Window.partitionBy(*keys, "_bucket").orderBy("_row", order, *ties).rowsBetween(Window.unboundedPreceding, -1))
    return both.withColumn(name, F.coalesce(own, first)).where("_row = 1").drop("_bucket", "_row", "_step")


def sums_before(df: DataFrame, keys: list[str], order: str, value: str, name: str, like: DataFrame | None = None) -> DataFrame:
    """df with `name`: the sum of value over rows of the same keys with a smaller order. Rows of one order: any order."""
    return running_before(df, keys, order, value, name, like=like)


def numbered(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """df with the 0-based number of each row within its keys, by order. Rows of equal order get numbers in any order."""
    return sums_before(df.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", name).drop("_one")


def counts_near(df: DataFrame, keys: list[str], at: str, radius: int, name: str, block: int = 4096, also: tuple[Column, ...] = ()) -> DataFrame:
    """One row for each of keys and `at`: n rows there, `name` rows with `at` at most radius away, these included, and further
    aggregates of the rows there.

    Rows are counted first. A window covers a block of positions, and positions near a block's end count in both blocks.
    """
    counted = df.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("n"), *also)
    home = F.floor(F.col(at) / block)
    blocks = F.sequence(F.floor((F.col(at) - radius) / block), F.floor((F.col(at) + radius) / block))
    spread = counted.withColumn("_home", home).withColumn("_block", F.explode(blocks))
    near = Window.partitionBy(*keys, "_block").orderBy(F.col(at)).rangeBetween(-radius, radius)
    return spread.withColumn(name, F.sum("n").over(near)).where("_home = _block").drop("_home", "_block")


def first_of(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """The columns of the row that comes first in each group: an aggregate, so a group is never gathered."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
