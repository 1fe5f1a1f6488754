"""The pipeline against brute force, and planted cases."""

from __future__ import annotations

import random
import re

import numpy as np

import corpus_pipeline
from test_near_recall import shingles_of
from vellumframe.llm import packing, pii, quality


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "exact dedup", "simhash near-dedup", "pii", "best-fit packing"]
    text = {r["doc_id"]: r["text"] for r in docs.collect()}

    first = stages["quality classifier"](spark, docs, sf)
    scores = {r["doc_id"]: r["score"] for r in quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    kept = {i for i in text if scores[i] >= 0.3}
    assert {r["doc_id"] for r in first.collect()} == kept and first.columns == corpus_pipeline.COLUMNS

    second = stages["exact dedup"](spark, first, sf)
    seen: dict = {}
    for i in sorted(kept):
        seen.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", text[i]), i)
    assert {r["doc_id"] for r in second.collect()} == set(seen.values()) and second.columns == corpus_pipeline.COLUMNS

    third = stages["simhash near-dedup"](spark, second, sf)
    ids = sorted(seen.values())
    sets = [shingles_of(text[i]) for i in ids]
    both = np.array([[len(a & b) for b in sets] for a in sets])
    size = np.array([len(a) for a in sets])
    link, least = both >= 0.8 * (size[:, None] + size[None, :] - both), np.array(ids)
    while not (now := np.array([least[row].min() for row in link])).tolist() == least.tolist():
        least = now
    stay = {i for i, x in zip(ids, least.tolist(), strict=True) if i == x}
    assert {r["doc_id"] for r in third.collect()} == stay and third.columns == corpus_pipeline.COLUMNS

    fourth = stages["pii"](spark, third, sf)
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in fourth.collect()} == {i: (t := pii.redact_text(text[i]), len(t)) for i in stay}

    last = stages["best-fit packing"](spark, fourth, sf).collect()
    assert {r["doc_id"] for r in last} == stay and all(0 < r["length"] <= packing.CAPACITY for r in last)


def test_planted_copies(spark, sf):
    """Exact and near copies go, one of each group stays, and other documents stay."""
    rng = random.Random(2)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    base = max(text, key=lambda i: len(text[i].split()))
    words = text[base].split(" ")
    planted = [(1000, text[base].replace(" ", "  ")), (1001, text[base])]
    for k in range(5):
        at = rng.randrange(len(words))
        planted.append((1010 + k, " ".join([*words[:at], "changed", *words[at + 1 :]])))
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in planted], docs.select(*corpus_pipeline.COLUMNS).schema)
    stages = dict(corpus_pipeline.STAGES)
    exact = stages["exact dedup"](spark, docs.select(*corpus_pipeline.COLUMNS).union(more), sf)
    assert {r["doc_id"] for r in exact.collect()} & {1000, 1001} == set()
    near = {r["doc_id"] for r in stages["simhash near-dedup"](spark, exact, sf).collect()}
    first = shingles_of(text[base])
    linked = {i for i, t in planted if len(first & shingles_of(t)) >= 0.8 * len(first | shingles_of(t))}
    assert len(linked) >= 4 and not near & linked and base in near


def test_near_stage_keeps_unlike_rows_of_one_id(spark, sf):
    """A row goes for its own text, not for another one of its id."""
    long = " ".join(f"word{i}" for i in range(200))
    rows = [(1, long, "en", "s", 1), (2, long + " more", "en", "s", 1), (2, "a text of its own that nobody else has here", "en", "s", 1), (3, " ".join(f"other{i}" for i in range(50)), "en", "s", 1), (None, long, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, sf)
    assert got.columns == corpus_pipeline.COLUMNS and sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted((str(i), t) for i, t, *_ in [rows[0], rows[2], rows[3], rows[4]])


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and set(rows[0].asDict()) >= {"doc_id", "piece", "sequence_id", "offset", "length"}
