"""Exact dedup: rows meet by a 128-bit hash of their normalised text, and the bytes are compared inside each hash group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs of these count as one space.
WHITE = "[\\x20\\x09-\\x0D]+"


def normalised(text):
    """The text whose equality counts: white-space runs become one space, null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The first aggregate groups by (hash, text): its keys are compared as bytes, so texts that only share the hash stay
    apart, and each task sends a text at most once, however often it repeats. The second aggregate puts a digest of
    each distinct text beside the hash; the join back moves ids and digests only. Its sides are exchanged for the join
    alone, so adaptive execution can split a group that holds a third of all rows.

    Null text equals the empty text. Null ids are no candidates for keep_id unless a group has no other; such a group
    has keep_id null and keeps its rows. Rows that repeat both id and text are one document: all have the same kept.
    An empty table gives no rows. Other columns, whatever their names, are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("hash", F.md5("norm"))
    texts = rows.groupBy("hash", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # Texts whose 128-bit hashes agree but whose bytes differ get numbers; the number of a text is carried by its digest.
    groups = (
        texts.select(F.concat("hash", F.sha2("norm", 256)).alias("g"), "keep_id", "n")
        .groupBy("g").agg(F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
        # Two texts with equal MD5 and SHA-256 can't be told apart by the key below: stop rather than merge them.
        .withColumn("n", F.when(F.col("texts") > 1, F.raise_error(F.lit("texts collide in both digests")).cast("long")).otherwise(F.col("n")))
        .select(F.concat(F.lit("g"), "g").alias("key"), "keep_id", "n")
    )
    keyed = rows.select("id", F.sha2("norm", 256).alias("sha"), "hash").select("id", "sha", F.concat(F.lit("g"), "hash", "sha").alias("key"))
    return keyed.join(groups, "key").select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns. Of rows that repeat an id and text, one stays."""
    names = df.columns
    packed = df.select(F.struct(*names).alias("row"), F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm")).withColumn("hash", F.md5("norm"))
    best = packed.groupBy("hash", "norm").agg(F.min_by("row", F.struct(F.col("id").isNull(), "id")).alias("row"))
    return best.select("row.*")
