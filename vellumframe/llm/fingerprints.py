"""Document fingerprints: a Merkle tree over blocks of words, paragraphs and sections, by DataFrame functions alone.

A paragraph is a line. Its leaves are blocks of three words with the white space around them. A section is a run of
paragraphs that ends after one whose digest begins with a zero digit, so that a paragraph put in moves no other section's
ends. Each node's digest is the hash of its children's, the root's that of the sections'. As text, a fingerprint is

    root ":" section (";" section)*    a section: paragraph ("," paragraph)*    a paragraph: 8 hex digits of each leaf

so that roots tell whether texts are equal, and sections, paragraphs and leaves that differ tell where.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumframe.llm.ordered import FIRST, NEXT, bucket, lower_neighbours

#: Up to three words, of up to 64 characters at a time, and all white space; every character lies in one match.
LEAF = r"\s*+(?:\S{1,64}\s*+){1,3}|\s++"
LEAF_DIGITS = 8


def with_fingerprint(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """df with the fingerprint of a text column that holds no null. Columns of steps are kept apart so that Catalyst
    evaluates each once; their names begin with the new column's."""
    # A leaf keeps its 32 digits for the nodes above it and shows its first 8.
    leaves = F.transform(F.split(text_col, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.md5(x)))
    paragraphs = F.transform(leaves, lambda x: F.struct(F.md5(F.array_join(x, "")).alias("node"), F.array_join(F.transform(x, lambda y: F.substring(y, 1, LEAF_DIGITS)), "").alias("shown")))
    step = f"{name}__paragraphs"
    ended = lambda field: F.array_join(F.transform(step, lambda x: F.concat(x[field], F.when(x["node"].startswith("0"), ";").otherwise(","))), "")
    sections = F.split(F.regexp_replace(ended("node"), ".$", ""), ";", -1)
    root = F.sha2(F.array_join(F.transform(sections, lambda x: F.md5(x)), ""), 256)
    return df.withColumn(step, paragraphs).withColumn(name, F.concat(root, F.lit(":"), F.regexp_replace(ended("shown"), ".$", ""))).drop(step)


def root(fp):
    return F.substring(fp, 1, 64)


def leaves(fp):
    """The different leaves of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(F.substring(fp, 66, 1 << 30), F.lit(f"[0-9a-f]{{{LEAF_DIGITS}}}"), F.lit(0)))


def likeness(a, b):
    """From 0 to 1: twice the leaves that both fingerprints have over those of either; 1 for equal roots."""
    x, y = leaves(a), leaves(b)
    total = F.size(x) + F.size(y)
    return F.when(root(a) == root(b), 1.0).otherwise(F.coalesce(2.0 * F.size(F.array_intersect(x, y)) / F.when(total > 0, total), F.lit(0.0)))


def differing_sections(a, b):
    """Numbers, from 0, of the sections of fingerprint a that b has not: where a differs from b."""
    x, y = (F.split(F.substring(c, 66, 1 << 30), ";", -1) for c in (a, b))
    return F.when(root(a) == root(b), F.array().cast("array<int>")).otherwise(F.filter(F.transform(x, lambda s, i: F.when(F.array_contains(y, s), -1).otherwise(i)), lambda i: i >= 0))


#: Buckets that rows without an id are dealt to, by their text; a power of two.
NULL_BUCKETS = 4096


def with_next(df: DataFrame, key: str, make, columns: list[str]) -> DataFrame:
    """make(df) with next_<column> of the row with the next smaller key; after the smallest comes the largest.

    Rows are exchanged once, before make adds its columns. Keys are taken in buckets of 2**10, so a task holds a bucket and
    never all rows; only the last row of a bucket looks into the next bucket that has any, and those few rows are joined.
    Rows that repeat a key follow one another in one bucket. Null keys come last, in buckets by a hash of their columns. A
    single row is its own next.
    """
    names = [f"next_{c}" for c in columns]
    # Below all buckets of keys, which are 2**53 at the least.
    unkeyed = F.lit(-(1 << 62)).cast("long") - F.xxhash64(*df.columns).bitwiseAND(NULL_BUCKETS - 1)
    dealt = df.withColumn("_bucket", F.coalesce(bucket(F.col(key)), unkeyed)).repartition("_bucket")
    order = Window.partitionBy("_bucket").orderBy(F.col(key).desc_nulls_last())
    made = make(dealt)
    inner = made.withColumn("_next", F.lead(F.struct(*columns)).over(order)).where("_next is not null")
    inner = inner.select(*[c for c in made.columns if c != "_bucket"], *[F.col("_next")[c].alias(n) for c, n in zip(columns, names, strict=True)])
    heads = make(dealt.withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row"))
    heads = heads.select(F.col("_bucket").alias("_head"), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
    ends = make(dealt.withColumn("_more", F.lead(F.lit(1)).over(order)).where("_more is null").drop("_more"))
    keys = df.select(F.coalesce(bucket(F.col(key)), unkeyed).alias("_bucket")).distinct()
    # The lowest bucket goes on with the highest.
    chain = lower_neighbours(keys, "_bucket", FIRST + NEXT)
    top = keys.agg(F.max("_bucket").alias("_top"))
    after = chain.crossJoin(F.broadcast(top)).select(F.col("_bucket").alias("_from"), F.coalesce("lower", "_top").alias("_head"))
    tails = ends.join(after, F.col("_bucket") == F.col("_from")).join(heads, "_head").select(*[c for c in made.columns if c != "_bucket"], *names)
    return inner.unionByName(tails)


def compare(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third of characters replaced by the first as many of the next document, by descending
    id, an integer. Null text is empty. Rows that repeat an id are neighbours. Other columns aren't read. An empty table
    gives no rows. One exchange moves texts, once; fingerprints are made behind it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = with_next(df.select(F.col(id_col).alias("id"), text.alias("text")), "id", lambda d: with_fingerprint(d, "text", "fp"), ["text", "fp"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.when(third > 0, F.expr("substring(next_text, 1, cast(floor(length(text) / 3) as int))")).otherwise("")))
    made = with_fingerprint(edited, "edited", "edited_fp")
    return made.select(
        F.col("id").alias(id_col), n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
