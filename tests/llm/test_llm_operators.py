"""Each operator against brute force, on edge cases and on the smallest tables."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import LONG, TEXTS, docs

from vellumframe.llm import bpe, chat, exact_dedup, fingerprints, ids, idstore, packing, pii, quality, queries, simhash, units, warc
from vellumframe.llm.components import components
from vellumframe.llm.ordered import lower_neighbours, starts
from vellumframe.llm.work import new_path

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def rows(df):
    return [r.asDict() for r in df.collect()]


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def want_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 2]


@cache
def reference_bpe():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


# 1


def test_exact_dedup_edges(spark):
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in TEXTS]
    size, keep = Counter(norm), {}
    for (i, _), n in zip(TEXTS, norm, strict=True):
        keep[n] = min([x for x in (i, keep.get(n)) if x is not None], default=None)
    want = sorted(((i, keep[n], size[n], i == keep[n], hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(TEXTS, norm, strict=True)), key=str)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(exact_dedup.exact_groups(docs(spark)))), key=str)
    assert got == want
    assert rows(exact_dedup.exact_groups(docs(spark, []))) == []


def test_keep_first(spark):
    got = exact_dedup.keep_first(docs(spark))
    assert got.columns == docs(spark).columns
    assert sorted((r["doc_id"] for r in rows(got)), key=str) == sorted([3, 9, 1, 4, 7, 6, None, 1 << 40, -7], key=str)


# 2


def test_quality_edges(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = rows(quality.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels))
    held = {r["doc_id"]: r for r in got}
    assert len(got) == 200 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    marks = {r["doc_id"]: r["quality"] for r in rows(labels)}
    assert np.mean([held[i]["predicted"] == q for i, q in marks.items()]) > 0.9
    model = quality.fit(docs(spark), labels.limit(0))
    assert {r["score"] for r in rows(quality.score(docs(spark), model))} == {0.5}
    edge = rows(quality.classify(docs(spark), spark.createDataFrame([(5, 1), (5, 1), (6, 0), (None, 1), (7, None)], "doc_id long, quality int")))
    assert len(edge) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in edge)
    assert rows(quality.classify(docs(spark, []), labels)) == []


def test_quality_votes_against_brute_force(spark, sf):
    """Latent vectors, cosines and votes written out: singular vectors of the sample, each document against each vector."""
    docs_, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    text = {r["doc_id"]: r["text"] for r in rows(docs_)}
    known = {r["doc_id"]: r["quality"] for r in rows(labels) if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["doc_id"] in text}

    def vector(t):
        data, out = f" {t} ".encode(), [0.0] * quality.WIDTH
        for a, b in zip(data, data[1:]):  # noqa: B905
            out[((a << 8 | b) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - quality.PAIR_BITS)] += 1 / len(data)
        out = [x**0.5 for x in out]
        words = t.split()
        if len(words) > 1:
            out[-2] = 0.7 * (sum(a == b for a, b in zip(words, words[1:])) / (len(words) - 1)) ** 0.5  # noqa: B905
            out[-1] = 0.7 * (1 - len(set(words)) / len(words)) ** 0.5
        return np.array(out)

    sample = sorted(known)
    x = np.array([vector(text[i]) for i in sample])
    mean = x.mean(axis=0)
    _, values, axes = np.linalg.svd(x - mean, full_matrices=False)
    k = min(quality.DIMENSIONS, len(sample))
    scaled = axes[:k].T / np.sqrt(np.maximum(values[:k], 1e-4))
    latent = lambda v: (z := (v - mean) @ scaled) / max(np.linalg.norm(z), 1e-9)
    near = np.array([latent(v) for v in x])
    y = np.array([known[i] for i in sample])
    got = {r["doc_id"]: r["score"] for r in rows(quality.classify(docs_, labels))}
    for i, t in text.items():
        cosines = near @ latent(vector(t))
        best = np.argsort(-cosines)[: quality.NEIGHBOURS]
        weight = np.maximum(cosines[best], 0) ** quality.POWER
        assert got[i] == pytest.approx((weight * y[best]).sum() / weight.sum(), abs=2e-3), i


def test_quality_sample_is_bounded(spark):
    """Documents that repeat an id are learned once."""
    many = spark.createDataFrame([(i % 10, "x" * (i % 40)) for i in range(400)], "doc_id long, text string")
    model = quality.fit(many, spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int"))
    assert len(model.labels) <= 10


def test_quality_held_out_accuracy(spark):
    """Labels of one fold are never learned; there the classifier must tell the classes apart."""
    sf = "/root/testdata/sf0.1"
    got = queries.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    a, b = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (a[:, None] > b[None, :]).mean() > 0.97
    assert got.predicted[got.quality == 1].mean() > 0.98


# 3

LEAF = re.compile(r"[ \t\n\x0b\f\r]*(?:[^ \t\n\x0b\f\r]{1,64}[ \t\n\x0b\f\r]*){1,3}|[ \t\n\x0b\f\r]+")


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def want_fingerprint(t):
    sections, paragraphs = [[]], t.split("\n")
    for i, p in enumerate(paragraphs):
        found = [md5(x) for x in LEAF.findall(p)]
        sections[-1].append((node := md5("".join(found)), "".join(x[:8] for x in found)))
        if node[0] == "0" and i < len(paragraphs) - 1:
            sections.append([])
    root = hashlib.sha256("".join(md5(",".join(x[0] for x in s)) for s in sections).encode()).hexdigest()
    return root + ":" + ";".join(",".join(x[1] for x in s) for s in sections)


def want_likeness(a, b):
    x, y = (set(re.findall(".{8}", re.sub("[,;]", "", c[65:]))) for c in (a, b))
    return 1.0 if a[:64] == b[:64] else 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


@pytest.mark.parametrize("spread", [1, 1 << 12, 1 << 45])
def test_fingerprints(spark, spread):
    texts = [(k, v) for k, v in TEXTS if k not in (6, None)] + [(100 + i, f"line {i}\nnext {i} line\n\nlast of {i} words and more") for i in range(40)]
    texts = [(k * spread if abs(k) < 1000 else k, v) for k, v in texts]
    got = {r["doc_id"]: r for r in rows(fingerprints.compare(docs(spark, texts)))}
    order = sorted(texts, key=lambda x: -x[0])
    assert len(got) == len(order)
    for n, (i, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + after[:k]
        a, b = want_fingerprint(t), want_fingerprint(edited)
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b)
        assert r["near_edited"] == pytest.approx(want_likeness(a, b)) and r["near_next"] == pytest.approx(want_likeness(a, want_fingerprint(after)))


def test_fingerprint_edges(spark):
    assert rows(fingerprints.compare(docs(spark, []))) == []
    assert len(rows(fingerprints.compare(docs(spark)))) == len(TEXTS)  # a null id and repeated ids too
    (alone,) = rows(fingerprints.compare(docs(spark, [(1, "abcdef")])))
    assert alone["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and alone["near_next"] == 1.0


def test_differing_sections(spark):
    a, b = (want_fingerprint("\n".join(x)) for x in ([f"paragraph {i}" for i in range(60)], [f"paragraph {i}" if i != 30 else "changed" for i in range(60)]))
    (r,) = rows(spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.differing_sections("a", "b").alias("d")))
    assert len(r["d"]) in (1, 2)


# 4


def want_simhash(t, k=3):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    import xxhash

    h = [xxhash.xxh64(" ".join(w[i : i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(pairs):
    up: dict = {}

    def top(v):
        while up.setdefault(v, v) != v:
            v = up[v]
        return v

    for a, b in pairs:
        up[top(a)] = top(b)
    out = defaultdict(set)
    for v in list(up):
        out[top(v)].add(v)
    return sorted(sorted(x) for x in out.values())


def test_simhash_edges(spark):
    got = rows(simhash.near_groups(docs(spark)))
    fp = [want_simhash(t) for _, t in TEXTS]
    assert sorted(r["fingerprint"] for r in got) == sorted(f"{x:016x}" for x in fp)
    own = {x: min((i for (i, _), y in zip(TEXTS, fp, strict=True) if bin(x ^ y).count("1") <= 3 and i is not None), default=None) for x in fp}
    assert all(r["component_id"] == own[int(r["fingerprint"], 16)] for r in got)
    assert rows(simhash.near_groups(docs(spark, []))) == []


def test_simhash_links(spark, monkeypatch):
    """Dense clusters, and anchors that are passed on in parts, keep the components of all pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 64, 30, dtype=np.uint64)
    x = base.copy()
    for _ in range(3):
        x = np.concatenate([x, x ^ (np.uint64(1) << rng.integers(0, 64, len(x)).astype(np.uint64))])
    low = np.uint64(0xFFFFFFFF)
    half = (base[0] & low) | (rng.integers(0, 1 << 32, 120, dtype=np.uint64) << np.uint64(32))
    near = half ^ (np.uint64(1) << rng.integers(32, 64, len(half)).astype(np.uint64))
    x = np.unique(np.concatenate([x, half, near]))
    distance = np.bitwise_count(x[:, None] ^ x[None, :])
    want = groups((int(x[i]), int(x[j])) for i, j in zip(*np.nonzero(np.triu(distance <= 3, 1)), strict=True))
    for run in (4096, 20):
        monkeypatch.setattr(simhash, "RUN", run)
        found = rows(simhash.links(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")))
        assert groups((r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in found) == want


def test_simhash_overflow_passes_rows_on():
    import pyarrow as pa

    fp = np.arange(50, dtype=np.uint64) << np.uint64(40)
    key = np.array([1] * 10 + [2] * 30 + [3] * 10, np.int64)
    old, simhash.RUN = simhash.RUN, 20
    try:
        for size in (3, 7, 50):
            batches = (pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(fp[i : i + size].view(np.int64))], ["key", "fp"]) for i in range(0, 50, size))
            out = [r for b in simhash._compare(batches, False) for r in b.to_pylist()]
            assert sorted(r["a"] for r in out if r["key"] is not None) == fp[10:40].view(np.int64).tolist()
    finally:
        simhash.RUN = old


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(70)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in rows(components(spark.createDataFrame(edges, "a long, b long")))}
    want = {v: g[0] for g in groups(e for e in edges if None not in e) for v in g}
    assert got == want
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


# 5


def want_bpe(text):
    found = reference_bpe().encode_ordinary(text or "")
    return len(found), hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def strange_texts(n):
    rnd = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "a", "é", "1", "½", "'s", "!", "😀", "́", "‍", "'re", "ab", "the", "\r\n", "\x0b", "﻿", "中", "<|endoftext|>", "　"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 14))) for _ in range(n)]


def test_bpe(spark):
    got = rows(bpe.encode_decode(docs(spark), RANKS, public_tokenizers.PATTERN))
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == sorted(want_bpe(t) for _, t in TEXTS)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    rnd = random.Random(7)
    texts = [*strange_texts(3000), "a" * 5000, "ab" * 3000, "é" * 2000, *("".join(rnd.choices(RUNS, k=rnd.randrange(14))) for _ in range(4000)), *("".join(rnd.choices("abcdetio", k=rnd.randrange(90))) for _ in range(2000))]
    for t, found in zip(texts, codec.digests(pa.array(texts)), strict=True):
        assert found == want_bpe(t), t
    for t in texts[:500]:
        assert codec.decode(codec.encode(t)) == t.encode() and codec.encode(t) == reference_bpe().encode_ordinary(t)


@pytest.mark.parametrize("size", [4, 8, 32, 64])
def test_merges_together_are_those_of_one(size):
    rnd = random.Random(size)
    ranks = bpe.load_ranks(RANKS)
    pieces = [bytes(rnd.choices(b" etaoinshr\xc3\xa9", k=rnd.randint(1, size))) for _ in range(800)]
    pieces = [p for p in pieces if p not in ranks or len(p) == 1]
    found, counts = bpe.merge_pieces(pieces, size, ranks, bpe.Pairs(ranks))
    ends = np.cumsum(counts).tolist()
    assert [found[a:b].tolist() for a, b in zip([0, *ends[:-1]], ends, strict=True)] == [bpe.merge_piece(p, ranks) for p in pieces]


def test_bpe_edges(spark):
    assert rows(bpe.encode_decode(docs(spark, []), RANKS, public_tokenizers.PATTERN)) == []


def test_bpe_forgets_nothing_that_counts(monkeypatch):
    monkeypatch.setattr(units, "UNITS", 5)
    monkeypatch.setattr(units, "GROUP", 64)
    texts = strange_texts(300) + ["the same words and the same words again " * 9]
    assert bpe.Codec(RANKS, public_tokenizers.PATTERN).digests(pa.array(texts)) == [want_bpe(t) for t in texts]


# 6 and 10


RUNS = [" ", "\n", "\n", "a", "b.", "the", "\0", "\t", "<|", "\u3000", "\x1c"]


def test_ids_equal_the_library():
    rnd = random.Random(6)
    texts = [*strange_texts(3000), LONG, None, "", "hi <|endoftext|> there", "<|endoftext|><|endoftext|>", *("".join(rnd.choices(RUNS, k=rnd.randrange(14))) for _ in range(6000))]
    texts += ["".join(chr(c) + rnd.choice(["", "a", " ", "\n", " a"]) for c in range(a, a + 4096) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 4096)]
    found, offsets = ids.Encoder(JSON).encode_batch(pa.array(texts, pa.string()), 2)
    assert len(found) == offsets[-1] and offsets[0] == 0
    for k, t in enumerate(texts):
        assert found[offsets[k] : offsets[k + 1]].tolist() == want_ids(t), t


def test_ids_of_added_tokens():
    """Names of added tokens are those tokens, as the library reads them by default."""
    assert ids.Encoder(JSON).encode("hi <|endoftext|> there").tolist() == [5303, 220, 50256, 612]


def test_ids_of_another_vocabulary():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), ids.Encoder(path)
    assert not encoder.by_units
    for t in strange_texts(200):
        assert encoder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_ids_forget_nothing_that_counts(monkeypatch):
    monkeypatch.setattr(units, "UNITS", 7)
    monkeypatch.setattr(units, "GROUP", 64)
    texts = strange_texts(500) + ["the same words and the same words again, and  again\n\n\n" * 9]
    found, offsets = ids.Encoder(JSON).encode_batch(pa.array(texts), 2)
    assert [found[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [want_ids(t) for t in texts]  # noqa: B905


def test_packing_edges(spark):
    got = rows(packing.packed(docs(spark), JSON, with_ids=True))
    want = Counter()
    for i, t in TEXTS:
        found = want_ids(t)
        start = 0
        for piece, n in enumerate(packing.cut_lengths(len(found))):
            want[(i, piece, start, n, zlib.crc32(np.array(found[start : start + n], "<u4").tobytes()))] += 1
            start += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    placed = defaultdict(list)
    for r in got:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in placed.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 1024
    whole = rows(packing.sequences(packing.packed(docs(spark), JSON, with_ids=True)))
    assert sum(len(r["ids"]) for r in whole) == sum(len(want_ids(t)) for _, t in TEXTS)
    assert rows(packing.packed(docs(spark, []), JSON)) == []


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(4 + seed / 2, 1.3, 5000), 1, 1024).astype(int)
    counts = Counter(lengths.tolist())
    made, used = packing.plan(counts), Counter()
    for parts, times in made:
        assert sum(parts) <= 1024
        for n in parts:
            used[n] += times
    assert used == counts
    assert sum(t for _, t in made) <= 1.02 * sum(k * v for k, v in counts.items()) / 1024 + 2


def test_cut_lengths():
    assert packing.cut_lengths(1) == [1] and packing.cut_lengths(1024) == [1024] and packing.cut_lengths(2049) == [1, 1024, 1024] and packing.cut_lengths(0) == []


def test_plan_replaces_the_shortest_by_two():
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [((6, 2, 2), 1), ((3,), 1)]


def test_idstore_edges(spark):
    path = new_path(spark, "test-store")
    idstore.write(docs(spark), JSON, path)
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))
    facts = sorted(rows(idstore.read_facts(spark, path)), key=lambda r: r["start"])
    found = {r["start"]: r["ids"] for r in rows(idstore.read_ids(spark, path))}
    start = 0
    assert [r["doc_id"] for r in facts] == [i for i, _ in order]
    for r, (_, t) in zip(facts, order, strict=True):
        want = want_ids(t)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        assert found[start] == want
        start += len(want)
    chunks = idstore._chunks(spark, path)
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert rows(idstore.stored(docs(spark, []), JSON)) == []


def test_idstore_crcs():
    rng = np.random.default_rng(2)
    parts = [rng.bytes(int(n)) for n in rng.integers(0, 3000, 40)]
    first = np.array([0, 1, 7, 30])
    got = idstore.joined_crcs(np.array([zlib.crc32(p) for p in parts], np.uint32), np.array([len(p) for p in parts], np.int64), first)
    assert got.tolist() == [zlib.crc32(b"".join(parts[a:b])) for a, b in zip(first, [*first[1:], 40], strict=True)]


def test_chunks_follow_content(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50000, 300000).astype("<u4")
    y = np.concatenate([rng.integers(0, 50000, 777).astype("<u4"), x])
    ends = lambda v: idstore.chunk_ends(v, np.array([len(v)])).tolist()
    cut = lambda v: {v[a:b].tobytes() for a, b in zip([0, *ends(v)[:-1]], ends(v), strict=True)}
    assert ends(x)[-1] == len(x) and len(cut(x) & cut(y)) >= 0.9 * len(cut(x))
    # Documents side by side have the chunks that each has alone, and no chunk is too long.
    places = np.sort(rng.choice(np.arange(1, len(x)), 500, replace=False))
    both = [a + e for a, b in zip([0, *places], [*places, len(x)], strict=True) for e in ends(x[a:b])]
    assert idstore.chunk_ends(x, np.append(places, len(x))).tolist() == both
    monkeypatch.setattr(idstore, "MOST", 100)
    assert np.diff(idstore.chunk_ends(x, np.append(places, len(x))), prepend=0).max() == 100


@pytest.mark.parametrize("harm", ["missing", "repeated", "changed"])
def test_manifest_finds_damage(spark, harm):
    path = new_path(spark, "test-store")
    idstore.write(docs(spark), JSON, path)
    idstore.verify(spark, path)
    found = spark.read.parquet(f"{path}/recipes")
    kept = [r for r in found.collect() if r["id"] != 9] if harm == "missing" else [r for r in found.collect() for _ in range(1 + (r["id"] == 9))] if harm == "repeated" else [r if r["id"] != 9 else [*r[:-1], bytearray(32)] for r in found.collect()]
    spark.createDataFrame(kept, found.schema).write.mode("overwrite").parquet(f"{path}/recipes-new")
    spark.read.parquet(f"{path}/recipes-new").write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        idstore.read_facts(spark, path)


# 7


def test_warc_edges(spark):
    big = "p" * 1500
    inner = "x" * 1200 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n"
    pages = [(1, "u", big), (2, "u\r\nWARC-Type: x", big), (9, None, big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (6, "u", inner), (7, "u", inner), (8, "é", "é" * 600), (10, "é", "é" * 600), (9, "u", big)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, first string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows(warc.archived(df))), key=str)
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        most = max((j for j, _, h in pages if h == html and j is not None), default=None)
        again = len(data) >= 1000 and i != most
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", most if again else None))
    assert got == sorted(want, key=str)
    assert rows(warc.archived(df.limit(0))) == []


@pytest.fixture
def small_splits(spark):
    """Files are read in splits of a few hundred bytes, each in a task of its own."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def held(size: int) -> None:
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], str(size))
        spark.conf.set(names[2], "1")

    yield held
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_warc_over_splits(spark, small_splits):
    """One file in many splits: marks in payloads, at borders and over them, and records longer than splits."""
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    nested = "".join(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: 5\r\n\r\nab{i % 10}de\r\n\r\n" for i in range(12))
    r = random.Random(9)
    parts = ["x" * 7, "WARC/1.1\r\n", fake, fake[:-1], "WARC", "\r\n\r\n", "é" * 20, nested, "y" * 900, ""]
    pages = [(i, "http://a/WARC/1.1" if i % 7 == 0 else "u", "".join(r.choice(parts) for _ in range(r.randint(0, 5)))) for i in range(24)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    path = new_path(spark, "test-warc")
    warc.write(df, path)
    count = Counter(h for *_, h in pages)
    most = {h: max(i for i, _, x in pages if x == h) for h in count}
    want = sorted((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if len(h.encode()) >= 1000 and most[h] != i else "response") for i, _, h in pages)
    for size in (700, 1 << 30):
        small_splits(size)
        got = warc.read(spark, path)
        assert sorted((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"]) for x in got.collect()) == want, size
    small_splits(2000)
    blocks = {x["record_id"]: (x["url"], bytes(x["block"])) for x in warc.read_payloads(spark, path).collect()}
    for i, url, html in pages:
        said, block = blocks[f"<urn:page:{i}>"]
        assert said == url.replace("/WARC/1.1", "/%57ARC/1.1") and (block.endswith(b"\r\n\r\n" + html.encode()) or most[html] != i)


def test_warc_damage(spark, small_splits, tmp_path):
    record = b"WARC/1.1\r\nWARC-Type: x\r\nWARC-Record-ID: y\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    files = {"good": record * 3, "empty": b"", "none": b"no record", "short": record * 2 + record[:-6], "wrong": record.replace(b"5", b"4") * 2, "long": record.replace(b"5", b"9") * 2, "tail": record * 2 + b"WARC/1.1\r\n", "more": record + b"more"}
    for name, content in files.items():
        small_splits(100 if name in ("good", "wrong", "tail") else 1 << 20)
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.txt").write_bytes(content)
        read = lambda: [bytes(x["block"]) for x in warc.read_payloads(spark, f"file://{folder}").collect()]  # noqa: B023, E731
        if name in ("good", "empty"):
            assert read() == [b"abcde"] * (3 if name == "good" else 0)
        else:
            with pytest.raises(Exception, match="record"):
                read()


# 8


def test_chat_round_trip():
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\[", "<s>[INST x]", "", "é\n]\\<", None]
    turns = [(role, t) for role in ("user", "assistant", "a]b", None) for t in hard]
    text, mask = chat.format_turns(turns)
    assert chat.parse_turns(text) == [(r or "", t or "") for r, t in turns]
    assert [chat.unescape(text[a:b]) for a, b in mask] == [t or "" for r, t in turns if r == "assistant"]
    assert text.count("</s>") == len(turns) == text.count("<s>[INST ")
    with pytest.raises(ValueError):
        chat.parse_turns(text + "x")


def test_chat_table(spark):
    data = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", None), (None, 0, "assistant", "n"), (3, None, "assistant", "first"), (3, 0, None, LONG)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in rows(chat.read_back(chat.format_conversations(chat.canonical(df))))}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"user\na\nuser\na\nassistant\nb\n").hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (1, hashlib.sha256(b"b").hexdigest())
    assert got[None]["loss_chars"] == 1 and got[2]["loss_chars"] == 0 and got[3]["turns_sha256"] == hashlib.sha256(f"assistant\nfirst\n\n{LONG}\n".encode()).hexdigest()
    assert rows(chat.read_back(chat.format_conversations(df.limit(0)))) == []


def test_chat_layouts(spark):
    same = [("user", "q"), ("assistant", "a")]
    layouts = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": 4},
        {"prompt": "q", "response": "a"},
        {"instruction": "q", "input": "", "output": "a"},
        {"question": "q", "answer": "a", "source": "x"},
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(layouts)] + [(99, None)], "conv_id long, line string")
    got = defaultdict(list)
    for r in sorted(rows(chat.json_turns(df, "line")), key=lambda r: r["turn"]):
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got == {i: same for i in range(len(layouts))}
    flat = spark.createDataFrame([(1, "q", "more", "a")], "conv_id long, instruction string, input string, output string")
    assert [(r["role"], r["text"]) for r in sorted(rows(chat.canonical(flat)), key=lambda r: r["turn"])] == [("user", "q\n\nmore"), ("assistant", "a")]
    nested = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from: string, value: string>>")
    assert [(r["role"], r["text"]) for r in sorted(rows(chat.canonical(nested)), key=lambda r: r["turn"])] == same
    with pytest.raises(ValueError):
        chat.turns_of({"nothing": "known"})
    both = {"messages": [], "prompt": "q", "response": "a", "id": 3}
    assert chat.turns_of(both) == [("user", "q"), ("assistant", "a")] and chat.turns_of({"messages": [], "system": "s"}) == [("system", "s")] and chat.turns_of({"messages": [], "lang": "en"}) == []
    with pytest.raises(ValueError):
        chat.turns_of({"messages": [], "nothing": "known"})
    parts = [{"type": "text", "text": "a "}, {"type": "text", "text": "b"}]
    tool = {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "tool_calls": [{"id": 1, "function": {"arguments": "x"}}]}]}
    assert chat.turns_of({"messages": [{"role": "user", "content": parts}]}) == [("user", "a b")] and chat.turns_of(tool) == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError, match="isn't text"):
        chat.turns_of({"messages": [{"role": "user", "content": [{"type": "image", "text": "x"}]}]})
    for extra in ("lang", "unknown", "n"):
        table = spark.createDataFrame([(1, 0, "user", "hi", "z")], f"conv_id long, turn long, role string, text string, {extra} string")
        assert [tuple(r) for r in chat.canonical(table).collect()] == [(1, 0, "user", "hi")]
    typed = spark.createDataFrame([(1, [("user", [("text", "a"), ("text", "b")])])], "conv_id long, messages array<struct<role: string, content: array<struct<type: string, text: string>>>>")
    assert [tuple(r) for r in chat.canonical(typed).collect()] == [(1, 0, "user", "ab")]
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical(spark.createDataFrame([(1, "a", "b", "c", "d")], "conv_id long, prompt string, response string, question string, answer string"))


def test_chat_records_of_odd_kinds(spark):
    """Nothing that a record holds stops the job: it has turns, none, or an error."""
    turns = {
        '{"messages": []}': [], "[]": [], '[{"role": "user", "content": "q"}]': [("user", "q")], '{"prompt": 3, "response": null}': [("user", "3"), ("assistant", "")],
        '{"messages": [{"role": "user", "content": "q", "name": "n"}, {"role": "assistant", "content": 5, "score": 2}]}': [("user", "q"), ("assistant", "5")], '{"messages": [{"role": "user", "content": {"b": [1]}}]}': None,
        '{"messages": [{"role": "user", "content": ["x", "y"]}]}': None, '{"messages": [{"role": null, "content": "q"}]}': None, '{"messages": [3]}': None, "{": None, "7": None, '{"a": {"b": 1}}': None,
        '{"conv_id": 1, "turn": 0, "role": "user", "text": "t"}': None, "[" * 100000: None, "": [],
    }
    df = spark.createDataFrame(list(enumerate(turns)), "conv_id long, line string")
    found = rows(chat.json_turns(df, "line"))
    for i, (line, want) in enumerate(turns.items()):
        own = sorted((r for r in found if r["conv_id"] == i), key=lambda r: r["turn"] or 0)
        if want is None:
            assert len(own) == 1 and own[0]["error"] and own[0]["turn"] is None, line
        else:
            assert [(r["role"], r["text"]) for r in own] == want and all(r["error"] is None for r in own), line
    all_turns = chat.json_turns(df, "line")
    assert {r["conv_id"] for r in rows(chat.rejected(all_turns))} == {i for i, w in enumerate(turns.values()) if w is None}
    assert {r["conv_id"]: r["n_turns"] for r in rows(chat.read_back(chat.format_conversations(chat.good(all_turns))))} == {i: len(w) for i, w in enumerate(turns.values()) if w}


def test_chat_unlike_layouts_read_back(spark):
    """Records of several layouts become one table of turns, and their texts come back from the formatted output."""
    lines = ['{"messages": [{"role": "user", "content": "</s>[INST] ok [/INST]"}, {"role": "assistant", "content": "a"}]}', '{"instruction": "q", "input": "more", "output": "<s>"}', '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "[/INST]"}]}']
    df = spark.createDataFrame(list(enumerate(lines)), "conv_id long, line string")
    got = {r["conv_id"]: r for r in rows(chat.read_back(chat.format_conversations(chat.good(chat.json_turns(df, "line")))))}
    for i, (user, said) in enumerate([("</s>[INST] ok [/INST]", "a"), ("q\n\nmore", "<s>"), ("q", "[/INST]")]):
        assert got[i]["turns_sha256"] == hashlib.sha256(f"user\n{user}\nassistant\n{said}\n".encode()).hexdigest()
        assert got[i]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


# 9


def want_base(text):
    found = []
    for k, (kind, pattern) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(digits))) % 10 == 0) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), k, kind, m.end()))
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))


PII_TEXTS = ["a@b.c and 1.2.3.4 4111 1111 1111 1111, +1 (988) 555-2485.", "300.1.1.1 1.2.3.4.5 000001.2.3.4", "@ . + 5 a@b", "x@y.z@w.v +1234567 +12345678901234567890", "4111-1111-1111-1112 411111111111111 4222222222222", "é a.b+c@d-e.fr 1.1.1.256"]


def test_pii_base(spark, sf):
    extra = [(100 + i, t) for i, t in enumerate(PII_TEXTS)]
    got = rows(pii.find(docs(spark, TEXTS + extra)))
    want = Counter((i, hashlib.sha256(want_base(t or "").encode()).hexdigest()) for i, t in TEXTS + extra)
    assert Counter((r["doc_id"], r["base_sha256"]) for r in got) == want
    assert all(sum(r[f"n_{k}"] for k in pii.KINDS) + r["n_added"] == (r["spans"].count(",") + 1 if r["spans"] else 0) for r in got)
    assert rows(pii.find(docs(spark, []))) == []
    for r in rows(spark.read.parquet(f"{sf}/documents.parquet").select("text")):
        assert pii._said(pii.detect(r["text"])) == want_base(r["text"]) and pii.spans(r["text"])[1] == []


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write to john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("jоhn@exаmple.com ok", "email", "jоhn@exаmple.com"),
        ("john dot doe at example dot com.", "email", "john dot doe at example dot com"),
        ("a​b@ex­mple.org", "email", "a​b@ex­mple.org"),
        ("call plus one two one two five five five one two three four today", "phone", "plus one two one two five five five one two three four"),
        ("pay four one one one one one one one one one one one one one one one !", "card", "four one one one one one one one one one one one one one one one"),
        ("ip one nine two dot one six eight dot zero dot one two", "ip", "one nine two dot one six eight dot zero dot one two"),
        ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ],
)
def test_pii_disguised(text, kind, found):
    base, more = pii.spans(text)
    assert base == [] and [(k, text[a:b]) for k, a, b in more] == [(kind, found)]
    assert found not in pii.redact_text(text) and f"[{kind.upper()}]" in pii.redact_text(text)


@pytest.mark.parametrize("text", ["", "one two three, let us go at once.", "meet at noon. The dot is red", "un deux trois nous irons au bois", "in 1999 at home. 12 (3) [4]", "at 5 dot com"])
def test_pii_clean(text):
    assert pii.spans(text) == ([], []) and pii.redact_text(text) == text


def test_redact_keeps_columns(spark):
    df = docs(spark)
    got = pii.redact(df, length_col="n_chars")
    assert got.schema == df.schema
    mail = [r for r in rows(got) if r["doc_id"] == 1 << 40]
    assert mail[0]["text"] == "far away, mail [EMAIL] now" and mail[0]["n_chars"] == len(mail[0]["text"])


# order helpers


def test_starts_and_neighbours(spark):
    rng = random.Random(5)
    keys = list({rng.choice([rng.randrange(-50, 3000), rng.randrange(-(1 << 63), 1 << 63), rng.randrange(1 << 20)]) for _ in range(800)})
    df = spark.createDataFrame([(k, k % 7) for k in keys] + [(None, 5)], "k long, v long")
    got = {r["k"]: r["start"] for r in rows(starts(df, "k", "v"))}
    total = 0
    for k in [None, *sorted(keys)]:
        assert got[k] == total
        total += 5 if k is None else k % 7
    low = {r["k"]: r["lower"] for r in rows(lower_neighbours(df.where("k is not null").select("k"), "k"))}
    assert low == dict(zip(sorted(keys), [None, *sorted(keys)[:-1]], strict=True))
