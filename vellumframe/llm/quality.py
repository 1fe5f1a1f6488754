"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes the square roots of the shares of its hashed byte pairs, and of how often a word repeats the one before
it or another one. A truncated singular value decomposition of the labelled sample makes latent vectors of it. The
labelled vectors go to every task; each document's cosines with all of them are computed in blocks, and the nearest
vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: The bound of the labelled sample: so many rows of each label, those with the smallest hash of their id.
SAMPLE = 4000
#: Latent dimensions, neighbours that vote, the power of their similarity, and rows whose cosines are computed together.
DIMENSIONS, NEIGHBOURS, POWER, BLOCK = 96, 21, 4, 128
THRESHOLD = 0.3
PAIR_BITS = 10
#: Weights of the two shares of repeated words beside the byte pairs, whose vector has length 1.
REPEATS = 0.7
WIDTH = (1 << PAIR_BITS) + 2
_SLOT = ((np.arange(1 << 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """The vector of a whole text; null is empty."""
    data = np.frombuffer(f" {text or ''} ".encode(), np.uint8).astype(np.int64)
    out = np.zeros(WIDTH, np.float32)
    counts = np.bincount(_SLOT[(data[:-1] << 8) | data[1:]], minlength=WIDTH - 2)
    out[: WIDTH - 2] = np.sqrt(counts / len(data))
    words = (text or "").split()
    if len(words) > 1:
        out[-2] = REPEATS * (sum(map(eq, words, words[1:])) / (len(words) - 1)) ** 0.5
        out[-1] = REPEATS * (1 - len(set(words)) / len(words)) ** 0.5
    return out


@dataclass
class Model:
    mean: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; the prior where no neighbour is similar at all."""
        out = np.full(len(x), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(x), BLOCK):
            near = self.latent(x[at : at + BLOCK]) @ self.vectors.T
            best = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
            weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(np.float64) ** POWER
            total = weight.sum(axis=1)
            votes = (weight * self.labels[best]).sum(axis=1)
            out[at : at + BLOCK] = np.where(total > 0, votes / np.maximum(total, 1e-300), self.prior)
        return np.clip(out, 0, 1)


def held_out(id_column):
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` rows of each label, 0 and 1, that are not held out. A document with several label
    rows has the smallest. Without labelled rows every score is 0.5; with one label, that label."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_label")).where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & ~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_label").alias("_label"))
    parts = [known.where(F.col("_label") == v).orderBy(F.xxhash64("_id"), "_id").limit(sample) for v in (0, 1)]
    chosen = parts[0].union(parts[1])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1).cast(pa.int32()), pa.array(rows, pa.binary())], ["id", "label", "vector"])

    # Of documents that repeat an id the longest text counts, so that no more rows than were chosen come back.
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).groupBy("_id", "_label").agg(F.max_by("_text", F.struct(F.length("_text"), "_text")).alias("_text"))
    found = sorted(rows.mapInArrow(vectors, "id string, label int, vector binary").collect(), key=lambda r: (r["id"], bytes(r["vector"])))
    y = np.array([r["label"] for r in found], np.float64)
    if not len(found):
        return Model(np.zeros(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), y, 0.5)
    x = np.stack([np.frombuffer(r["vector"], np.float32) for r in found])
    mean = x.mean(axis=0)
    values, axes = np.linalg.eigh(((x - mean).T @ (x - mean)).astype(np.float64))
    k = min(DIMENSIONS, len(found))
    axes = (axes[:, -k:] / np.sqrt(np.sqrt(np.maximum(values[-k:], 1e-9)))).astype(np.float32)
    model = Model(mean, axes, np.zeros((0, k), np.float32), y, float(y.mean()))
    model.vectors = model.latent(x).astype(np.float32)
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """The rows, all columns and the score. No shuffle. Null and empty texts get a score like any other; repeated rows
    stay. A column that already has the name of the score is replaced."""
    kept = [c for c in df.columns if c.lower() != name.lower()]
    rows = df.select(*[df[c] for c in kept])
    at = kept.index(text_col)
    # The bounded model (mean, axes and at most 2 * SAMPLE vectors of DIMENSIONS) goes out once for each executor.
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts, out = batch.column(at), []
            for k in range(0, batch.num_rows, BLOCK):
                out.append(own.scores(np.stack([features(t) for t in texts[k : k + BLOCK].to_pylist()])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())], [*batch.schema.names, name])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted (1 if score >= THRESHOLD). An empty table gives no rows."""
    model = fit(docs, labels, label, id_col, text_col)
    scored = score(docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")), model, "_text")
    return scored.select(F.col("_doc").alias(id_col), held_out(F.col("_doc")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
