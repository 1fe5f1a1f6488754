"""A content-addressed store of token ids: unique chunks, document recipes in id order, Merkle roots.

Files, all Parquet, below one folder: packs/ (with is_chunk: digest, payload of little-endian unsigned ids, and their width of
2 or 4 bytes; without: what documents refer to, in the order in which it came), recipes/ (id, start, n_tokens, the digests
and lengths of its chunks, its Merkle root; ascending ids, file after file) and manifest/ (for each run of SPAN ids of the
whole stream the documents that begin in it, their ids, and the root over their roots).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumframe.llm.ids import encoder
from vellumframe.llm.ordered import starts
from vellumframe.llm.units import AMPLE, row_groups
from vellumframe.llm.work import cut, new_path

#: A chunk ends where the hash of the last WINDOW ids has its low CUT_BITS bits zero, and after MOST ids at the latest.
WINDOW, CUT_BITS, MOST = 16, 9, 8192
#: Bits of the length of a span of the manifest.
SPAN_BITS = 18
#: Digests of chunks that a task has already sent on; at most so many are remembered.
SENT = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return np.cumprod(np.append(np.uint64(1), np.full(n - 1, _BASE))), np.cumprod(np.append(np.uint64(1), np.full(n - 1, inverse)))


_UP, _DOWN = _powers(1 << 16)


def chunk_ends(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the chunks of id streams end that lie one after the other and end at `ends`; no chunk reaches over one.

    A polynomial rolling hash, from prefix sums over blocks that overlap by a window. A window that begins before its
    document cuts nothing.
    """
    cuts, step = [], len(_UP) - WINDOW
    with np.errstate(over="ignore"):
        for at in range(0, len(ids) - WINDOW, step):
            part = ids[at : at + step + WINDOW]
            value = (part.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            total = np.cumsum((value ^ (value >> np.uint64(29))) * _UP[: len(part)])
            rolled = (total[WINDOW:] - total[:-WINDOW]) * _DOWN[WINDOW : len(part)]
            rolled ^= rolled >> np.uint64(32)
            cuts.append(np.flatnonzero((rolled & np.uint64((1 << CUT_BITS) - 1)) == 0) + (at + WINDOW + 1))
    found = np.concatenate([np.empty(0, np.int64), *cuts])
    begins = np.append(0, ends)[np.searchsorted(ends, found, "left")]
    out = np.union1d(found[found - begins > WINDOW], ends)
    long = np.flatnonzero(np.diff(out, prepend=0) > MOST)
    more = [np.arange((out[i - 1] if i else 0) + MOST, out[i], MOST) for i in long.tolist()]
    return np.union1d(out, np.concatenate(more)) if more else out


def merkle(digests: list[bytes]) -> bytes:
    """The root of a binary hash tree; a last node without a partner goes up as it is. No leaves: the hash of nothing."""
    level = [hashlib.sha256(b"\0" + d).digest() for d in digests] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


# CRC-32 of a concatenation from the CRCs of its parts: a part's CRC times x^(8 * bytes after it), in GF(2)[x] mod the
# CRC's polynomial, bits reversed as the CRC holds them.
_POLY = np.uint32(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out, b = np.zeros(len(a), np.uint32), b.copy()
    for i in range(31, -1, -1):
        out ^= np.where((a >> np.uint32(i)) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), _POLY, np.uint32(0))
    return out


def _shift(n_bytes: np.ndarray) -> np.ndarray:
    """x^(8 n) for each n."""
    out = np.full(len(n_bytes), 0x80000000, np.uint32)
    power, n = np.array([0x00800000], np.uint32), n_bytes.astype(np.int64)
    while n.any():
        odd = np.flatnonzero(n & 1)
        out[odd] = _times(out[odd], np.broadcast_to(power, len(odd)))
        power, n = _times(power, power), n >> 1
    return out


def joined_crcs(crcs: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of each group of parts; parts lie in order, group g begins at index first[g] (each has a part)."""
    total = np.cumsum(lengths)
    last = np.append(first[1:], len(crcs)) - 1
    after = np.repeat(total[last], np.diff(np.append(first, len(crcs)))) - total
    return np.bitwise_xor.reduceat(_times(crcs, _shift(after)), first)


def write(df: DataFrame, vocabulary: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes each text, appends end_id and writes the store.

    Tasks send each chunk on once, however often they meet it, keyed by its digest, and beside it what refers to it,
    keyed by chance; so one exchange, evenly spread, both makes chunks unique and carries the references, and texts are
    encoded once. Null text is empty: its document holds end_id alone. Repeated rows are documents of their own. Null
    ids come first in the order.
    """
    spark = df.sparkSession
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sent = encoder(vocabulary, AMPLE), set()
        width = 2 if max(encode.size, end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            for a, b in row_groups(batch.column(1), AMPLE[0]):
                ids, documents = encode.encode_batch(batch.column(1)[a:b], end_id)
                ends = chunk_ends(ids, documents[1:])
                begins = np.append(0, ends[:-1])
                data = ids.astype(f"<u{width}")
                view = memoryview(data).cast("B")
                digests = [hashlib.sha256(view[x:y]).digest() for x, y in zip((width * begins).tolist(), (width * ends).tolist(), strict=True)]
                new = []
                for digest in digests:
                    if fresh := digest not in sent:
                        if len(sent) >= SENT:
                            sent.clear()
                        sent.add(digest)
                    new.append(fresh)
                of = np.searchsorted(ends, documents[1:]) + 1  # the number of chunks up to the end of each document
                firsts = np.append(0, of[:-1])
                # What a document refers to goes by chance, and the same way if the task is run again.
                by_chance = [hashlib.md5(digests[x] + x.to_bytes(8, "little")).digest() for x in firsts.tolist()]
                named, offsets = pa.array(digests, pa.binary()), pa.array(np.append(0, of).astype(np.int32))
                payloads = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((width * np.append(begins, ends[-1])).astype(np.int32)), pa.py_buffer(data)]).filter(pa.array(new))
                n, m = len(payloads), b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([True] * n + [False] * m), pa.concat_arrays([named.filter(pa.array(new)), pa.array(by_chance, pa.binary())]), pa.concat_arrays([payloads, pa.nulls(m, pa.binary())]), pa.array([width] * (n + m), pa.int32()),
                        pa.concat_arrays([pa.nulls(n, batch.column(0).type), batch.column(0)[a:b]]), pa.concat_arrays([pa.nulls(n, pa.list_(pa.binary())), pa.ListArray.from_arrays(offsets, named)]),
                        pa.concat_arrays([pa.nulls(n, pa.list_(pa.int32())), pa.ListArray.from_arrays(offsets, pa.array((ends - begins).astype(np.int32)))]),
                    ],
                    ["is_chunk", "digest", "payload", "width", "id", "recipe", "lengths"],
                )

    def unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by digest: of equal chunks the first stays. Keys by chance are shorter than digests of chunks."""
        last = pa.nulls(1, pa.binary())
        for batch in batches:
            digests = batch.column(1)
            before = pa.concat_arrays([last, digests[:-1]]) if len(digests) else digests
            yield batch.filter(pc.invert(pc.and_(batch.column(0), pc.fill_null(pc.equal(digests, before), False))))
            last = digests[-1:] if len(digests) else last

    schema = f"is_chunk boolean, digest binary, payload binary, width int, id {kind}, recipe array<binary>, lengths array<int>"
    rows = df.select(id_col, text_col).mapInArrow(encode, schema).repartition("digest").sortWithinPartitions("digest").mapInArrow(unique, schema)
    rows.write.parquet(f"{path}/packs")

    found = spark.read.schema(rows.schema).parquet(f"{path}/packs")
    sizes = found.where("not is_chunk").select("id", "recipe", "lengths", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"))

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = pa.array([merkle(x) for x in batch.column(batch.schema.names.index("recipe")).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, roots], [*batch.schema.names, "root"])

    placed = starts(sizes, "id", "n_tokens").select("id", "start", "n_tokens", "recipe", "lengths")
    placed.mapInArrow(root, f"id {kind}, start long, n_tokens long, recipe array<binary>, lengths array<int>, root binary").repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{path}/recipes")
    recipes = spark.read.parquet(f"{path}/recipes")
    _manifest(recipes).write.parquet(f"{path}/manifest")


def _manifest(recipes: DataFrame) -> DataFrame:
    """One row for each span of starts that has documents. A document holds an id at least, so a span's are bounded."""
    roots = F.transform(F.sort_array(F.collect_list(F.struct("start", "root"))), lambda x: F.hex(x["root"]))
    return recipes.groupBy(F.shiftright("start", SPAN_BITS).alias("span")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.sha2(F.array_join(roots, ""), 256).alias("root"))


def verify(spark: SparkSession, path: str) -> None:
    """Holds the recipes against the manifest: raises if documents are missing, repeated or changed, or if a span is missing
    in the manifest. Spans must also follow one another without a gap: their ids before, in sum, are where one begins."""
    recipes = spark.read.parquet(f"{path}/recipes")
    said, found = spark.read.parquet(f"{path}/manifest"), _manifest(recipes)
    met = found.join(said.select(F.col("span").alias("_span"), F.struct("documents", "n_tokens", "root").alias("said")), F.col("span") == F.col("_span"), "full")
    if not met.where(~F.struct("documents", "n_tokens", "root").eqNullSafe(F.col("said")) | F.col("span").isNull() | F.col("_span").isNull()).isEmpty():
        raise ValueError("recipes differ from the manifest")
    ends = recipes.agg(F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.sum("n_tokens").alias("sum")).first()
    if ends["end"] != ends["sum"]:
        raise ValueError("recipes leave out ids or repeat them")


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("digest binary, payload binary, width int, is_chunk boolean").parquet(f"{path}/packs").where("is_chunk").select("digest", "payload", "width")


def read_facts(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens, ids_crc32 of each document, from the files alone.

    Each chunk is read once where it lies, its digest verified and the CRC of its ids taken; these facts, not the ids,
    meet the recipes. A chunk that is missing or differs from its digest, a recipe whose root or count differs from what was
    read, and recipes that differ from the manifest stop the job.
    """
    verify(spark, path)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, payload, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError("a chunk differs from its digest")
                out.append((zlib.crc32(payload if width == 4 else np.frombuffer(payload, "<u2").astype("<u4")), len(payload) // width))
            cols = [pa.array(c, pa.int64()) for c in (list(zip(*out)) or [[]] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["digest", "crc", "n"])

    chunks = cut(_chunks(spark, path).mapInArrow(facts, "digest binary, crc long, n long"), "facts")
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("start", F.col("id"), "n_tokens", "root", F.posexplode(F.arrays_zip("recipe", "lengths"))).select("start", "id", "n_tokens", "root", "pos", F.col("col.recipe").alias("digest"), F.col("col.lengths").alias("length"))
    met = parts.join(chunks, "digest", "left").select("start", "id", "n_tokens", "root", F.struct("pos", "digest", "length", "crc", "n").alias("part"))
    grouped = met.groupBy("start", "id", "n_tokens", "root").agg(F.sort_array(F.collect_list("part")).alias("parts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            flat, offsets = lists.flatten(), lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists) else 0)
            get = lambda n: flat.field(n)
            if get("crc").null_count:
                raise ValueError("a recipe names a chunk that the store lacks")
            length, crc = get("length").to_numpy().astype(np.int64), get("crc").to_numpy().astype(np.uint32)
            if (get("n").to_numpy() != length).any():
                raise ValueError("a chunk has another length than its recipe says")
            digests = get("digest").to_pylist()
            for i, root in enumerate(batch.column(3).to_pylist()):
                if merkle(digests[offsets[i] : offsets[i + 1]]) != root:
                    raise ValueError("a recipe differs from its root")
            total = np.add.reduceat(length, offsets[:-1]) if len(length) else np.empty(0, np.int64)
            if (total != batch.column(2).to_numpy()).any():
                raise ValueError("a document has another number of ids than its recipe says")
            crcs = joined_crcs(crc, 4 * length, offsets[:-1]) if len(length) else np.empty(0, np.uint32)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(total), pa.array(crcs.astype(np.int64))], [id_col, "start", "n_tokens", "ids_crc32"])

    kind = recipes.schema["id"].dataType.simpleString()
    return grouped.mapInArrow(join, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start and the ids of each document, rebuilt from its chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("start", "id", F.posexplode(F.arrays_zip("recipe", "lengths"))).select("start", "id", "pos", F.col("col.recipe").alias("digest"), F.col("col.lengths").alias("length"))
    grouped = parts.join(_chunks(spark, path), "digest").groupBy("start", "id").agg(F.sort_array(F.collect_list(F.struct("pos", "width", "payload"))).alias("parts"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.concatenate([np.frombuffer(p["payload"], f"<u{p['width']}").astype(np.int32) for p in x]) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(out, pa.list_(pa.int32()))], [id_col, "start", "ids"])

    kind = recipes.schema["id"].dataType.simpleString()
    return grouped.mapInArrow(build, f"`{id_col}` {kind}, start long, ids array<int>")


def stored(df: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a store of its own in the shared folder and reads it back: id, start, n_tokens, ids_crc32."""
    path = new_path(df.sparkSession, "idstore")
    write(df, vocabulary, path, end_id, id_col, text_col)
    return read_facts(df.sparkSession, path, id_col)
