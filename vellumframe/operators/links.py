"""Targets, links and what they resolve to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumframe.operators.ordered import first_of


def scoped_lookup(asks: DataFrame, targets: DataFrame, kind: str = "kind", scope: str = "scope", key: str = "key", target: str = "target", order: str = "pos") -> DataFrame:
    """asks with `found` and `how`: the first target registered for (kind, scope, key); else the target of (kind, key)
    if that was registered exactly once, repeats of one target included in the count; else null."""
    exact = first_of(targets, [kind, scope, key], [F.col(order)], [target]).select(F.col(kind).alias("_k"), F.col(scope).alias("_s"), F.col(key).alias("_y"), F.col(target).alias("_exact"))
    single = targets.groupBy(kind, key).agg(F.count(F.lit(1)).alias("_n"), F.min(target).alias("_only")).where("_n = 1").select(F.col(kind).alias("_k2"), F.col(key).alias("_y2"), "_only")
    met = asks.join(exact, (F.col(kind) == F.col("_k")) & (F.col(scope) == F.col("_s")) & (F.col(key) == F.col("_y")), "left")
    met = met.join(single, (F.col(kind) == F.col("_k2")) & (F.col(key) == F.col("_y2")), "left")
    how = F.when(F.col("_exact").isNotNull(), "scoped").when(F.col("_only").isNotNull(), "unique").otherwise("none")
    return met.select(*asks.columns, F.coalesce("_exact", "_only").alias("found"), how.alias("how"))


def broken(links: DataFrame, targets: DataFrame, ref: str, key: str) -> DataFrame:
    """Links whose reference names no target."""
    return links.join(targets.select(F.col(key).alias("_key")).distinct(), F.col(ref) == F.col("_key"), "left_anti")


def incoming(links: DataFrame, targets: DataFrame, ref: str, key: str) -> DataFrame:
    """Each target with the number of links to it; counted before the join, so a hot target is one row."""
    counted = links.groupBy(ref).agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed(ref, "_ref")
    return targets.join(counted, F.col(key) == F.col("_ref"), "left").select(*targets.columns, F.coalesce("_n", F.lit(0)).alias("incoming"))


def numbered_ids(df: DataFrame, prefix: str, code: str, number: str):
    """prefix-codeNNN: numbers of at least three digits, never cut."""
    return F.concat(prefix, F.lit("-"), code, F.format_string("%03d", F.col(number)))


def pairing(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """key, status: whether a key is on both sides, or on one only."""
    a, b = left.select(F.col(left_key).alias("_a")).distinct(), right.select(F.col(right_key).alias("_b")).distinct()
    status = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("matched")
    return a.join(b, F.col("_a") == F.col("_b"), "full").select(F.coalesce("_a", "_b").alias("key"), status.alias("status"))
