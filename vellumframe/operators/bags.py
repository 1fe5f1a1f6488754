"""Multisets of words: overlap, precision and recall, and coverage that claims each word once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumframe.operators.ordered import sums_before


def bag(df: DataFrame, keys: list[str], word: str) -> DataFrame:
    return df.groupBy(*keys, word).agg(F.count(F.lit(1)).alias("n"))


def overlap(left: DataFrame, right: DataFrame, keys: list[str], word: str) -> DataFrame:
    """keys, words, matched: of a bag for each of keys, how many words another bag (word, n) has too."""
    other = right.select(F.col(word).alias("_word"), F.col("n").alias("_n"))
    met = left.join(other, F.col(word) == F.col("_word"), "left")
    return met.groupBy(*keys).agg(F.sum("n").alias("words"), F.sum(F.least("n", F.coalesce("_n", F.lit(0)))).alias("matched"))


def claimed(left: DataFrame, right: DataFrame, order: str, word: str, like: DataFrame | None = None) -> DataFrame:
    """order, words, matched: bags in order take words from the other bag until it has none left. left is read more than
    once: give a written table where it costs much. like: a table of the orders."""
    other = right.select(F.col(word).alias("_word"), F.col("n").alias("_n"))
    # Words that the other bag lacks are counted, but need no running sums.
    totals = left.groupBy(order).agg(F.sum("n").alias("words"))
    held = left.join(other, F.col(word) == F.col("_word")).select(order, word, "n", "_n")
    taken = sums_before(held, [word], order, "n", "_before", like=left if like is None else like).select(F.col(order).alias("_of"), F.greatest(F.lit(0), F.least(F.col("n"), F.col("_n") - F.col("_before"))).alias("_hit"))
    hits = taken.groupBy("_of").agg(F.sum("_hit").alias("_hits"))
    return totals.join(hits, F.col(order) == F.col("_of"), "left").select(order, "words", F.coalesce("_hits", F.lit(0)).cast("long").alias("matched"))
