"""Line-end hyphens, decided by the corpus itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"


def lexicon(lines: DataFrame, line: str = "text") -> DataFrame:
    """word, n, compound: words of all lines, and compounds, whose parts count as words too. A last hyphen is cut."""
    plain = F.regexp_replace(F.translate(F.lower(line), "­", ""), r"-\s*$", "")
    found = lines.select(F.explode(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))).alias("w"))
    compound = F.contains("w", F.lit("-"))
    parts = F.when(compound, F.concat(F.transform(F.split("w", "-"), lambda p: F.struct(p.alias("word"), F.lit(False).alias("compound"))), F.array(F.struct(F.col("w").alias("word"), F.lit(True).alias("compound"))))).otherwise(F.array(F.struct(F.col("w").alias("word"), F.lit(False).alias("compound"))))
    # Words are counted before they are taken apart, so that a frequent one is one row.
    counted = found.groupBy("w").agg(F.count(F.lit(1)).alias("c"))
    return counted.select(F.explode(parts).alias("p"), "c").groupBy("p.word", "p.compound").agg(F.sum("c").alias("n"))


def joins(pairs: DataFrame, words: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """pairs with `joined`: whether a word broken at a hyphen is one word.

    Not if either side isn't letters there or the right one begins with a capital; not if the compound is more frequent
    than the joined word; yes if the joined word is known; not if both halves are words of three letters or more that
    occur at least twice; else yes.
    """
    counted = pairs.withColumns({"_l": F.lower(left), "_r": F.lower(right)})
    for name, key, compound in (("_c", F.concat_ws("-", "_l", "_r"), True), ("_j", F.concat("_l", "_r"), False), ("_nl", F.col("_l"), False), ("_nr", F.col("_r"), False)):
        side = words.where(F.col("compound") == compound).select(F.col("word").alias(f"{name}_w"), F.col("n").alias(name))
        counted = counted.withColumn(f"{name}_k", key).join(side, F.col(f"{name}_k") == F.col(f"{name}_w"), "left").drop(f"{name}_k", f"{name}_w").withColumn(name, F.coalesce(name, F.lit(0)))
    letters = F.col("_l").rlike(r"\p{L}$") & F.col("_r").rlike(r"^\p{L}") & ~F.col(right).rlike(r"^\p{Lu}")
    halves = (F.length("_l") >= 3) & (F.length("_r") >= 3) & (F.col("_nl") >= 2) & (F.col("_nr") >= 2)
    joined = F.when(~letters, False).when(F.col("_c") > F.col("_j"), False).when(F.col("_j") > 0, True).otherwise(~halves)
    return counted.select(*pairs.columns, joined.alias("joined"))
