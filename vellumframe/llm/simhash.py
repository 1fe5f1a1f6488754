"""SimHash near-dedup by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumframe.llm.components import components
from vellumframe.llm.work import cut, handed_back

SEED = 42
#: Fingerprints link at so many differing bits; the covering below is made for it.
THRESHOLD = 3
#: Rows of one anchor that are compared in one go; a larger anchor is divided further.
RUN = 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included, unsigned. A-Z become lower case; a text of fewer words is one shingle, one of
    none has no shingle."""
    found = (text or "").encode().translate(_LOWER).split()
    n = len(found) - words + 1
    if not found:
        return np.empty(0, "<u8")
    if n <= 1:
        shingles = [b" ".join(found)]
    else:
        line = b" ".join(found)
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        shingles = [line[a:b] for a, b in zip([0, *(gaps + 1).tolist()], [*gaps[words - 1 :].tolist(), len(line)], strict=False)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", len(shingles))


def _simhash(hashes: np.ndarray) -> int:
    count, total = np.zeros(64, np.int64), len(hashes)
    for k in range(0, total, 16384):
        bits = np.unpackbits(hashes[k : k + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return int(np.packbits(2 * count > total, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash, unsigned; that of a text without words is 0."""
    return _simhash(shingle_hashes(text, words))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """The id and fp, the fingerprint as a signed long. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], [id_col, "fp"])

    kind = df.select(id_col).schema[0].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


# The covering. Of two fingerprints with at most 3 differing bits, one 32-bit half differs in at most 1. The anchors of
# a half are the words of the Hamming code on its low 31 bits, with either top bit: they cover the half with radius 1.
# So the nearest anchor of either fingerprint lies within 1 + 1 bits of the other, and both are found at it once each
# goes to all anchors within 2 bits: at most 17 for each half.


def _masks() -> np.ndarray:
    """Row s: the changes of at most 2 bits that take a half with syndrome s to an anchor; unused places repeat the first."""
    bit = [0] + [1 << i for i in range(31)]
    top = 1 << 31
    rows = [[0, top] + [0] * 15]
    for s in range(1, 32):
        pairs = [bit[i] | bit[i ^ s] for i in range(1, 32) if i < (i ^ s)]
        rows.append([bit[s], bit[s] | top, *pairs])
    return np.array(rows, np.uint32)


def _syndrome(half: np.ndarray) -> np.ndarray:
    """XOR of the numbers 1..31 of the set bits among the low 31."""
    out = np.zeros(len(half), np.uint32)
    for i in range(31):
        out ^= ((half >> np.uint32(i)) & np.uint32(1)) * np.uint32(i + 1)
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of anchors, and for each the index of its fingerprint."""
    masks, keys, index = _masks(), [], []
    for h in (0, 1):
        half = (fp >> np.uint64(32 * h)).astype(np.uint32)
        s = _syndrome(half)
        key = (half[:, None] ^ masks[s]).astype(np.int64) | (h << 32)
        use = np.ones(key.shape, bool)
        use[s == 0, 2:] = False
        keys.append(key[use])
        index.append(np.broadcast_to(np.arange(len(fp))[:, None], key.shape)[use])
    return np.concatenate(keys), np.concatenate(index)


def _forest(fp: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what links among distinct fingerprints: at most one less than there are. Rows are compared in
    blocks with those not yet reached."""
    left, edges = np.arange(len(fp)), []
    while len(left):
        queue, left = left[:1], left[1:]
        while len(queue) and len(left):
            block, queue = queue[:256], queue[256:]
            close = np.bitwise_count(fp[block][:, None] ^ fp[left][None, :]) <= THRESHOLD
            hit = close.any(axis=0)
            edges += zip(fp[block][close[:, hit].argmax(axis=0)].tolist(), fp[left[hit]].tolist(), strict=True)
            queue, left = np.concatenate([queue, left[hit]]), left[~hit]
    return edges


def _compare(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> edges (a, b), and (key, fp) again for keys with over RUN rows unless last."""

    def edges_of(key: np.ndarray, fp: np.ndarray) -> list[pa.RecordBatch]:
        out_a, out_b = [], []
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        length = np.diff(np.append(start, len(key)))
        small = np.repeat((length > 1) & (length <= 8), length)
        k, f = key[small], fp[small]
        for s in range(1, 8):
            same = np.flatnonzero((k[:-s] == k[s:]) & (np.bitwise_count(f[:-s] ^ f[s:]) <= THRESHOLD)) if len(k) > s else []
            if not len(same):
                continue
            out_a.append(f[same])
            out_b.append(f[same + s])
        for i in np.flatnonzero(length > 8).tolist():
            found = _forest(fp[start[i] : start[i] + length[i]])
            out_a.append(np.array([x[0] for x in found], np.uint64))
            out_b.append(np.array([x[1] for x in found], np.uint64))
        if not out_a:
            return []
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1).view(np.int64)
        none = pa.nulls(pairs.shape[1], pa.int64())
        return [pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), none], ["a", "b", "key"])]

    key, fp, over = np.empty(0, np.int64), np.empty(0, np.uint64), None

    def again(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.nulls(len(k), pa.int64()), pa.array(k)], ["a", "b", "key"])

    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        if over is not None and len(key):  # the anchor that is being passed on
            n = int(np.searchsorted(key, over, "right"))
            if n:
                yield again(key[:n], fp[:n])
            key, fp = key[n:], fp[n:]
            over = None if len(key) else over
        if not len(key):
            continue
        cut_at = int(np.searchsorted(key, key[-1]))  # the last anchor may go on
        if cut_at:
            yield from edges_of_all(key[:cut_at], fp[:cut_at], edges_of, again, last)
        key, fp = key[cut_at:], fp[cut_at:]
        if len(key) > RUN and not last:
            yield again(key, fp)
            over, key, fp = key[0], key[:0], fp[:0]
    if len(key):
        yield from edges_of_all(key, fp, edges_of, again, last)


def edges_of_all(key, fp, edges_of, again, last):
    """Large anchors inside the rows are passed on, the rest compared."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    length = np.diff(np.append(start, len(key)))
    large = np.repeat(length > RUN, length)
    if not last and large.any():
        yield again(key[large], fp[large])
        key, fp = key[~large], fp[~large]
    if len(key):
        yield from edges_of(key, fp)


def _compared(keyed: DataFrame, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _compare(batches, last)

    return cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, key long"), "links")


def _divided(over: DataFrame, level: int) -> DataFrame:
    """Rows (key, fp) of large anchors under the keys of their parts. Bit 32 of a key says which half its anchor is of."""
    other = F.when(F.shiftright("key", 32).bitwiseAND(1) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    if level == 1:
        parts = [[(8 * i, 8)] for i in range(4)]
    else:
        blocks = [(0, 5), (5, 5), (10, 5), (15, 5), (20, 6), (26, 6)]
        parts = [list(c) for c in combinations(blocks, 3)]
    exact = [F.struct(F.lit(i).alias("i"), *[F.shiftright(other, at).bitwiseAND((1 << n) - 1).alias(f"b{j}") for j, (at, n) in enumerate(p)]) for i, p in enumerate(parts)]
    sub = over.select("key", "fp", F.explode(F.array(*exact)).alias("x"))
    mixed = F.xxhash64("key", "x").bitwiseAND(~(1 << 32)).bitwiseAND((1 << 62) - 1).bitwiseOR(F.col("key").bitwiseAND(1 << 32))
    return sub.select(mixed.alias("key"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (column fp) that keep together what links at THRESHOLD bits or fewer.

    An anchor gathers fingerprints, not documents, and is sent on in parts when it has over RUN of them: by an exact
    byte of the other half (of its four bytes one is equal), then by three of six exact blocks of it.
    """

    def to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k in range(0, len(fp), 4096):
                key, index = anchors(fp[k : k + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[k : k + 4096][index].view(np.int64))], ["key", "fp"])

    found = _compared(fps.select("fp").mapInArrow(to_anchors, "key long, fp long"), last=False)
    edges = [found.where("key is null").select("a", "b")]
    for level in (1, 2):
        over = found.where("key is not null").select("key", F.col("a").alias("fp"))
        if over.isEmpty():
            break
        found = _compared(_divided(over, level), last=level == 2)
        edges.append(found.where("key is null").select("a", "b"))
    out = edges[0]
    for more in edges[1:]:
        out = out.union(more)
    return out.distinct()


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row per input row: the id, fingerprint (16 hex digits), component_id (the smallest id that links reach).

    Documents with equal fingerprints are one node, so copies cost one row each. Null and empty texts, and those of
    white space, have fingerprint 0 and link like any other. Null ids never become component_id unless a component has
    no other. Rows that repeat stay. Other columns aren't read. An empty table gives no rows.
    """
    rows = cut(fingerprints(df, id_col, text_col, words).select(F.col(id_col).alias("id"), "fp"), "fingerprints")
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = components(links(nodes))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(best, "root").select("fp", "component_id")
    ids = cut(nodes.join(of, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "members")
    return rows.join(ids, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by the share of their shingles. Texts alike by 0.8 differ in about 10 of 64 bits, which no covering of use
# reaches: the anchors for each fingerprint would be thousands. So fingerprints at THRESHOLD bits give the first candidates,
# and bands of least hashes the rest; of all candidates the exact share is counted.

#: A stage's near copies: sets of so many words' shingles that are alike, in common over either, by LEAST or more.
WORDS, LEAST = 5, 0.8
#: Two texts alike by x agree in one of BANDS groups of ROWS least hashes with 1 - (1 - x**ROWS)**BANDS: 0.99999 at 0.8.
BANDS, ROWS = 30, 5
_MIX = np.random.Generator(np.random.PCG64(SEED)).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The different hashes of a text's shingles. That of a text without words has the one member 0, so that such are alike."""
    return np.unique(found) if len(found := shingle_hashes(text, words)) else np.zeros(1, "<u8")


def bands(members: np.ndarray) -> np.ndarray:
    """The keys of a set: for each band the mixed least hashes under its permutations."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, len(members), 512):
            least = np.minimum(least, (members[k : k + 512, None] * _MIX[0]).min(axis=0))
        mixed = (least ^ (least >> np.uint64(29))) * _MIX[1]
    return np.add.reduce(mixed.reshape(BANDS, ROWS), axis=1, dtype=np.uint64).view(np.int64)


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """id, fp and the keys of each text of (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys = np.empty(batch.num_rows, np.uint64), np.empty((batch.num_rows, BANDS), np.int64)
            for i, text in enumerate(batch.column(1)):
                found = shingle_hashes(text.as_py(), words)
                fps[i], keys[i] = _simhash(found), bands(np.unique(found) if len(found) else np.zeros(1, "<u8"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), lists], ["id", "fp", "keys"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(handed_back(run), f"id {kind}, fp long, keys array<long>")


def _members(signed: DataFrame) -> DataFrame:
    """id, band, key, pair and degree, for keys that several ids have: pair is the key together with the next band's, degree
    the members of all the groups that an id is in."""
    both = F.transform("keys", lambda key, i: F.struct(key.alias("key"), F.xxhash64(key, F.get("keys", (i + 1) % BANDS)).alias("pair")))
    rows = signed.select("id", F.posexplode(both).alias("band", "x")).select("id", "band", "x.key", "x.pair")
    groups = cut(rows.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("band").alias("_band"), F.col("key").alias("_key"), "n"), "groups")
    members = cut(rows.join(groups.hint("merge"), (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key"))).select("id", "band", "key", "pair", "n"), "members")
    degrees = members.groupBy(F.col("id").alias("_id")).agg(F.sum("n").alias("degree"))
    return cut(members.join(degrees, F.col("id") == F.col("_id")).select("id", "band", "key", "pair", "degree"), "members")


def _stars(members: DataFrame, of: str, by: Column) -> DataFrame:
    """Candidates (a, b): each id of a group (a band and its key or pair) with that one of them which comes first by `by`; so
    a group gives no more candidates than members."""
    centres = members.groupBy("band", of).agg(F.min_by("id", F.struct(by.alias("by"), F.col("id"))).alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    centres = centres.select(F.col("band").alias("_band"), F.col(of).alias("_of"), "a")
    return members.join(centres, (F.col("band") == F.col("_band")) & (F.col(of) == F.col("_of"))).where("a <> id").select("a", F.col("id").alias("b"))


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id and members, the set of shingles, of the wanted ids (_id). The one exchange of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), words).view(np.int64) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "members"])

    kind = docs.schema["id"].dataType.simpleString()
    # Of rows that repeat an id, that with the longest text counts.
    texts = docs.join(wanted.distinct().hint("merge"), F.col("id") == F.col("_id"), "left_semi").groupBy("id").agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))
    return cut(texts.mapInArrow(handed_back(run), f"id {kind}, members array<long>"), "sets")


def _alike(sets: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """The candidates (a, b), each once, whose sets are alike by `least` or more."""
    pairs = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left, right = (sets.select(F.col("id").alias(f"_{c}"), F.col("members").alias(f"_set_{c}")) for c in "ab")
    met = pairs.join(left.hint("merge"), F.col("a") == F.col("_a")).join(right.hint("merge"), F.col("b") == F.col("_b"))
    both, total = F.size(F.array_intersect("_set_a", "_set_b")), F.size("_set_a") + F.size("_set_b")
    return cut(met.where(both >= F.lit(least) * (total - both) - 1e-9).select("a", "b"), "links")


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """id and component_id, the smallest id that links reach, for each id that has a link: texts whose sets of shingles are
    alike by `least` or more.

    Candidates are those whose SimHash fingerprints differ by THRESHOLD bits or fewer, and those that agree in a band. Rows
    without an id take no part; null and empty texts and those of white space are alike. Of rows that repeat an id, the
    longest text counts. Other columns aren't read. An empty table gives no rows.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null")
    signed = cut(_signed(docs, words), "signed")
    nodes = cut(signed.groupBy("fp").agg(F.min("id").alias("a")), "nodes")
    equal = signed.select("id", F.col("fp").alias("_fp")).join(nodes, F.col("fp") == F.col("_fp")).where("a <> id").select("a", F.col("id").alias("b"))
    close = links(nodes).join(nodes.select(F.col("fp").alias("a"), F.col("a").alias("id_a")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("a").alias("id_b")), "b").select("id_a", "id_b")
    # A text of which many copies were changed has links that the copies haven't among them: as the one with the most
    # neighbours it is the centre of its groups. Then other centres, by chance, for what isn't joined yet.
    members = _members(signed)
    most, chance = -F.col("degree"), F.xxhash64("id", "band")
    first = cut(equal.union(close).union(_stars(members, "key", most)), "candidates")
    sets = _sets(docs, members.select(F.col("id").alias("_id")).union(first.select("a")).union(first.select("b")), words)
    found = _alike(sets, first, least)
    roots = cut(components(found), "roots")
    of = lambda c: roots.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"root_{c}"))
    rest = _stars(members, "key", chance).union(_stars(members, "pair", most)).union(_stars(members, "pair", chance)).distinct()
    rest = rest.join(of("a"), F.col("a") == F.col("_a"), "left").join(of("b"), F.col("b") == F.col("_b"), "left")
    apart = rest.where(~F.coalesce("root_a", "a").eqNullSafe(F.coalesce("root_b", "b"))).select("a", "b")
    return components(found.union(_alike(sets, apart, least))).select(F.col("node").alias(id_col), F.col("root").alias("component_id"))
