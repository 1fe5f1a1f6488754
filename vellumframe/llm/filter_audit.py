"""Filter interaction audit: every order of five filters is replayed over every document's flags, relationally."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumframe.llm.work import cut

WHITE = "[\\x20\\x09-\\x0D]+"
LETTERS = "ABCDE"
#: The failure conditions of A, B, C and D: least words, least percentage of distinct words, most percentage of capitals, marks.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """Whether a text fails A, B, C and D, which look at it alone."""
    words = F.array_remove(F.split(text, WHITE), "")
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > MOST_CAPITALS * F.length(text),
        "D": text.rlike(MARKS),
    }


def bits(failures: dict[str, Column], letters: str = LETTERS) -> Column:
    """One bit for each failure, that of the first letter lowest."""
    total = F.lit(0)
    for letter, failed in failures.items():
        total = total + F.when(failed, 1 << letters.index(letter)).otherwise(0)
    return total


def flags(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, mask: the bits of all five failures of each row. Texts are read once; beside the flags only their digest is
    kept, by which E is found: a row fails it if its id isn't the smallest of its digest. The smallest ids come from an
    aggregate and meet the rows by id, so no task gathers the copies of a text.

    Null text and null part are empty. Rows without an id fail no E, and are no smaller id to others; rows that repeat an id
    and a text don't fail E by each other."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), bits(text_failures(text)).alias("alone"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = cut(rows, "flags")
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("first")).withColumnRenamed("digest", "of")
    met = rows.join(first, (F.col("id") == F.col("first")) & (F.col("digest") == F.col("of")), "left")
    copied = F.col("id").isNotNull() & F.col("first").isNull()
    return met.select("id", "part", (F.col("alone") + F.when(copied, 1 << LETTERS.index("E")).otherwise(0)).alias("mask"))


def replay(flagged: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row for each part,
    order of the letters and step. flagged: (part, mask, good, toxic), without nulls.

    Each row meets all orders, which are broadcast (120 of five letters), finds the step of its first failure and is counted at
    every step. Counts are combined in each task before the exchange, which gets a row for each part, order, step and task at
    most, so a part that holds a third of all rows costs no more than another. An empty table gives no rows."""
    if len(letters) > 6:
        raise ValueError("the orders of more than six filters aren't broadcast")
    n = len(letters)
    steps = [f"_f{i}" for i in range(n)]
    made = [("".join(p), *[1 << letters.index(x) for x in p]) for p in permutations(letters)]
    orders = flagged.sparkSession.createDataFrame(made, "filter_order string, " + ", ".join(f"{s} int" for s in steps))
    met = flagged.select("part", F.col("mask").cast("int").alias("mask"), "good", "toxic").crossJoin(F.broadcast(orders))
    first = F.lit(n)
    for i in reversed(range(n)):
        first = F.when(F.col("mask").bitwiseAND(F.col(steps[i])) != 0, i).otherwise(first)
    each = met.select("part", "filter_order", "mask", "good", "toxic", first.alias("_first"), F.posexplode(F.array(*steps)).alias("_at", "_bit"))
    here, failing = F.col("_first") == F.col("_at"), F.col("mask").bitwiseAND(F.col("_bit")) != 0
    count = lambda condition: F.count(F.when(condition, 1))
    counted = each.groupBy("part", "filter_order", "_at").agg(
        count(F.col("_first") > F.col("_at")).alias("kept"), count(here).alias("removed"), count(failing & (F.col("_first") < F.col("_at"))).alias("redundant"),
        count(F.col("mask") == F.col("_bit")).alias("unique_fails"), count(here & F.col("good")).alias("good_lost"), count(here & F.col("toxic")).alias("toxic_lost"),
    )
    letter = F.substring(F.col("filter_order"), F.col("_at") + 1, F.lit(1))
    share = F.sum("removed").over(Window.partitionBy("part", letter))  # a row for each order
    return counted.select("part", "filter_order", (F.col("_at") + 1).cast("int").alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", share.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The replay of docs by part; labels (id, quality, toxic) say which rows are good or toxic. Rows without a label, without an
    id or with a null label are neither; an id with several labels is good if one says so, and toxic likewise. Columns beside
    those named, whatever their names, are not read."""
    said = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    marked = flags(docs, id_col, text_col, part_col).join(said, F.col("id") == F.col("_id"), "left")
    none = F.lit(False)
    return replay(marked.select("part", "mask", F.coalesce("_good", none).alias("good"), F.coalesce("_toxic", none).alias("toxic")))
