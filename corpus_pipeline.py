"""The corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, PII, best-fit packing.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all rows that its predecessor kept; its result is
written as Parquet and read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumframe.llm import exact_dedup, packing, pii, quality, simhash
from vellumframe.llm.queries import vocabulary
from vellumframe.llm.work import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. It learns from the labels of documents in this input."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model, name="_score").where(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id."""
    return exact_dedup.keep_first(docs.select(*COLUMNS))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, five words' shingles alike by 0.8 or more, the document with the smallest id; documents
    without an id stay. Rows that repeat an id are told apart by their text, so that unlike ones stay."""
    keyed = docs.select(*COLUMNS).withColumn("_row", F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("text"))))
    groups = simhash.near_copies(keyed, id_col="_row")
    gone = groups.where("_row <> component_id").select(F.col("_row").alias("_gone"))
    return keyed.join(gone, F.col("_row") == F.col("_gone"), "left_anti").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars is that of the new text."""
    return pii.redact(docs.select(*COLUMNS), length_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("simhash near-dedup", near_stage),
    ("pii", pii_stage),
    ("best-fit packing", packing_stage),
]

#: A trained classifier, fingerprints and a vocabulary are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
