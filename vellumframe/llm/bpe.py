"""Byte-level BPE: encoding by a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from vellumframe.llm.units import Remembered, row_groups

def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file with a base64 token and a rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pattern match.

    Leaf i of the tree holds the rank of the pair that begins at byte i, or nothing if no live token begins there, and
    each node the least (rank, position) below it; so the root names the leftmost pair of the lowest rank. A merge
    changes three leaves: its own, that of the token it takes in, and that of the token before it.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    none = 1 << 62
    get = ranks.get
    end = list(range(1, n + 1))  # the token that begins at i ends before end[i]
    before = list(range(-1, n))  # where the token before the one that begins at i begins; its last entry is never read
    row = [none if (r := get(piece[i : i + 2])) is None else r * size + i for i in range(n - 1)]
    row += [none] * (size - n + 1)
    levels = [row]
    while len(row) > 1:
        row = list(map(min, row[::2], row[1::2]))
        levels.append(row)
    tree = [none]
    for row in reversed(levels):
        tree += row
    while (root := tree[1]) != none:
        i = root & (size - 1)
        j = end[i]
        k = end[i] = end[j]
        before[k] = i
        merged = none
        if k < n and (r := get(piece[i : end[k]])) is not None:
            merged = r * size + i
        changed = [(j, none), (i, merged)]
        if (p := before[i]) >= 0:
            changed.append((p, none if (r := get(piece[p:k])) is None else r * size + p))
        for at, value in changed:
            at += size
            tree[at] = value
            while at > 1:
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
                if tree[at] == value:
                    break
                tree[at] = value
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """The rank of the token that two tokens make, for arrays of pairs: a table with open addresses."""

    BITS = 21

    def __init__(self, ranks: dict[bytes, int]):
        made = [(a << 20 | b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        if max(ranks.values(), default=0) >= 1 << 20 or len(made) > 1 << (self.BITS - 1):
            raise ValueError("more tokens than the table of pairs takes")
        keys, ranked = np.array(made, np.int64).reshape(-1, 2).T
        self.keys, self.ranks = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, -1, np.int64)
        at, left = self._place(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            self.keys[at[left][free]] = keys[left][free]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & ((1 << self.BITS) - 1)
        self.ranks[at] = ranked

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank, or -1; also where a token is -1."""
        keys = left << 20 | right
        at = self._place(keys)
        found, there = self.ranks[at], self.keys[at]
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            at[more] = (at[more] + 1) & ((1 << self.BITS) - 1)
            found[more], there[more] = self.ranks[at[more]], self.keys[at[more]]
            more = more[(there[more] != keys[more]) & (there[more] >= 0)]
        return np.where((there == keys) & (left >= 0) & (right >= 0), found, -1)


def merge_pieces(pieces: list[bytes], size: int, ranks: dict[bytes, int], pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """The ids of pattern matches of at most `size` bytes, a power of two, and how many ids each has.

    merge_piece for many at once: row by row a segment tree, whose root names the merge that the row makes in this round.
    """
    m, none, shift = len(pieces), 1 << 60, size.bit_length() - 1
    n = np.fromiter(map(len, pieces), np.int64, m)
    text = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), np.uint8).reshape(m, size)
    column = np.arange(size)
    alive = column < n[:, None]
    byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
    # Beyond a piece there is the token -1; the one before position 0 is that at the end of the row above.
    token = np.full((m, size + 1), -1, np.int64)
    token[:, :size] = np.where(alive, byte[text], -1)
    first = pairs(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(m, size)
    tree = np.full((m, 2 * size), none, np.int64)
    tree[:, size:] = np.where(first >= 0, (first << shift) + column, none)
    for level in range(shift - 1, -1, -1):
        at = 1 << level
        tree[:, at : 2 * at] = np.minimum(tree[:, 2 * at : 4 * at : 2], tree[:, 2 * at + 1 : 4 * at : 2])
    end = np.tile(np.arange(1, size + 2), (m, 1))
    before = np.tile(np.arange(-1, size), (m, 1))
    tree, token, end, before, alive = tree.ravel(), token.ravel(), end.ravel(), before.ravel(), alive.ravel()
    row = np.arange(m)
    while len(row):
        root = tree[2 * size * row + 1]
        row, root = row[root != none], root[root != none]
        i, rank, at, node = root & (size - 1), root >> shift, (size + 1) * row, 2 * size * row
        j = end[at + i]
        k = end[at + j]
        token[at + i], end[at + i], before[at + k], alive[size * row + j] = rank, k, i, False
        p = before[at + i]
        own, other = pairs(rank, token[at + k]), pairs(token[at + p], rank)
        own, other = np.where(own >= 0, (own << shift) + i, none), np.where(other >= 0, (other << shift) + p, none)
        tree[node + size + j], tree[node + size + i] = none, own
        has = p >= 0
        tree[(node + size + p)[has]] = other[has]
        changed, node = np.concatenate([i, j, np.where(has, p, i)]) + size, np.concatenate([node, node, node])
        for _ in range(shift):
            changed >>= 1
            tree[node + changed] = np.minimum(tree[node + 2 * changed], tree[node + 2 * changed + 1])
    alive = alive.reshape(m, size)
    return token.reshape(m, size + 1)[:, :size][alive], alive.sum(axis=1)


#: Matches of at most so many bytes are merged together, so many rows at a time; longer ones each with a tree of its own.
TOGETHER, ROWS = 64, 16_384


class Codec(Remembered):
    """Encodes texts and decodes ids. Units (units.py) repeat, so a worker encodes and decodes each once while it is remembered."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.ranks = load_ranks(path)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.said_of = {v: b" %d" % v for v in self.bytes_of}
        self.pattern = regex.compile(pattern)
        self.pairs = Pairs(self.ranks)
        self.said, self.decoded = [], []

    def keep(self, slots: np.ndarray) -> None:
        self.said, self.decoded = ([x[i] for i in slots.tolist()] for x in (self.said, self.decoded))

    def _merged(self, pieces: list[bytes]) -> dict[bytes, list[int]]:
        get = self.ranks.get
        made = {p: [rank] for p in pieces if (rank := get(p)) is not None}
        sizes: dict[int, list[bytes]] = {}
        for p in pieces:
            if p not in made:
                sizes.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(p)
        for size, found in sizes.items():
            if size > TOGETHER:
                made.update({p: merge_piece(p, self.ranks) for p in found})
                continue
            for at in range(0, len(found), ROWS):
                part = found[at : at + ROWS]
                ids, counts = merge_pieces(part, size, self.ranks, self.pairs)
                ids, ends = ids.tolist(), np.cumsum(counts).tolist()
                made.update(zip(part, [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        return made

    def add(self, units: list[str]) -> None:
        pieces = [[p.encode() for p in self.pattern.findall(unit)] for unit in units]
        ids = self._merged(list({p for x in pieces for p in x}))
        said, decoded = self.said_of.__getitem__, self.bytes_of.__getitem__
        for x in pieces:
            found = ids[x[0]] if len(x) == 1 else [i for p in x for i in ids[p]]
            self.said.append(b"".join(map(said, found)))
            self.decoded.append(b"".join(map(decoded, found)))

    def encode(self, text: str) -> list[int]:
        found = [(self.said, s.tolist()) for _, s, _ in self.of(pa.array([text], pa.string()))]
        return [int(x) for said, slots in found for s in slots for x in said[s].split()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, texts: pa.Array) -> list[tuple[int, str, str]]:
        """For each text, none null: the number of ids, SHA-256 of the ids joined by one space, SHA-256 of the bytes decoded
        from the ids."""
        count, said, decoded = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts]
        for rows, slots, offsets in self.of(texts):
            slots, offsets = slots.tolist(), offsets.tolist()
            for k, a, b in zip(rows.tolist(), offsets[:-1], offsets[1:], strict=True):
                own = slots[a:b]
                ids = b"".join(map(self.said.__getitem__, own))
                said[k].update(ids if count[k] else ids[1:])
                decoded[k].update(b"".join(map(self.decoded.__getitem__, own)))
                count[k] += ids.count(b" ")
        return [(n, a.hexdigest(), b.hexdigest()) for n, a, b in zip(count, said, decoded, strict=True)]


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """A worker that runs several tasks keeps it, with what it remembers."""
    return Codec(path, pattern)


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_tokens, ids_sha256, decoded_sha256.

    Null text is the empty text: no ids. Rows that repeat stay. Other columns aren't read, so their names can't clash.
    Texts of any length go whole; a worker holds one batch and its remembered units. No shuffle.
    """
    kind = df.select(id_col).schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_groups(batch.column(1)):
                found = codec(path, pattern).digests(pc.fill_null(batch.column(1)[a:b], ""))
                cols = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *cols], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind_name = kind.dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind_name}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the ids of each text as an array<int>; null text has none."""
    kind_name = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path, pattern).encode
        for batch in batches:
            ids = pa.array([encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind_name}, ids array<int>")
