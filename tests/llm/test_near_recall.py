"""Near copies by five words: alike by 0.8 or more of their shingles, as a near-duplicate stage takes them."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from vellumframe.llm import simhash


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_planted_copies_alike_by_four_fifths_go(spark):
    """Copies with every 45th word changed: 400 of 500 shingles in all are shared."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(454)]
    rows = [(1, " ".join(words))]
    for k in range(8):
        changed = list(words)
        for at in range(5 + 4 * k, 454, 45):
            changed[at] = f"new{at}"
        rows.append((2 + k, " ".join(changed)))
    first = shingles(rows[0][1])
    assert all(0.8 <= len(first & shingles(t)) / len(first | shingles(t)) < 0.85 for _, t in rows[1:])
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stay = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, "").collect()}
    assert stay == {1}


def test_groups_are_those_of_all_pairs(spark):
    """Every pair alike by 0.8 or more of a table of three thousand documents is in one group, and nothing else is."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("doc_id < 3000")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    sets = {r["doc_id"]: shingles_of(r["text"]) for r in docs.collect()}
    least = {i: i for i in sets}
    members = sorted(sets)
    at: dict = {}
    for i in members:
        for x in sets[i]:
            at.setdefault(x, []).append(i)
    links = set()
    for i in members:
        both: dict = {}
        for x in sets[i]:
            for j in at[x]:
                if j > i:
                    both[j] = both.get(j, 0) + 1
        links |= {(i, j) for j, n in both.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)}
    while True:
        now = dict(least)
        for i, j in links:
            now[i] = now[j] = min(now[i], now[j])
        if now == least:
            break
        least = now
    assert len(links) > 50 and got == {i: least[i] for i in {x for e in links for x in e}}


def shingles_of(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_edges(spark):
    from helpers import docs

    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs(spark)).collect()}
    assert got == {9: 3, 5: 3, 3: 3, 1: 1, 2: 1, 4: 1, 10: 1, 7: 7, 8: 7}
    assert simhash.near_copies(docs(spark, [])).collect() == []


def test_large_group_and_chain(spark):
    """A group of many copies has one root, and texts that only a chain of links joins are one group."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    base, rows = [word() for _ in range(300)], []
    for i in range(600):
        own = list(base)
        own[rng.randrange(300)] = word()
        rows.append((1000 + i, " ".join(own)))
    step = [word() for _ in range(200)]
    for i in range(12):
        rows.append((i, " ".join(step)))
        at = rng.randrange(10, 190)
        step[at], step[at - 9] = word(), word()
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 1000 else 1000 for i, _ in rows}


def test_bands_are_those_of_the_set():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 5000, np.uint64)
    assert (simhash.bands(x) == simhash.bands(rng.permutation(x))).all()
    near = np.concatenate([x[:4500], rng.integers(0, 1 << 64, 500, np.uint64)])
    assert 8 <= (simhash.bands(x) == simhash.bands(near)).sum() <= 26 and not (simhash.bands(x) == simhash.bands(rng.integers(0, 1 << 64, 5000, np.uint64))).any()
