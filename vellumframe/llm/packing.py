"""Best-fit packing of token pieces into sequences, by best-two-fit on the counts of lengths."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumframe.llm.ids import encoder
from vellumframe.llm.units import row_groups, spread
from vellumframe.llm.work import cut

CAPACITY = 1024


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """The lengths of a document's pieces: all full but the first, which holds the rest."""
    first = n % capacity or min(n, capacity)
    return [first] + [capacity] * ((n - first) // capacity) if n else []


def token_pieces(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32), and ids if asked for: the ids of each text and then end_id, cut into
    pieces. Null text is empty and leaves end_id alone. No shuffle."""
    kind = df.select(id_col).schema[0].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_groups(batch.column(1)):
                ids, offsets = encoder(path).encode_batch(batch.column(1)[a:b], end_id)
                n = np.diff(offsets)
                first = np.where(n % capacity, n % capacity, np.minimum(n, capacity))
                count = 1 + (n - first) // capacity
                own, piece = np.repeat(np.arange(b - a), count), spread(np.zeros(b - a, np.int64), count)
                length = np.where(piece == 0, first[own], capacity)
                start = np.where(piece == 0, 0, first[own] + (piece - 1) * capacity)
                data, at = memoryview(ids).cast("B"), 4 * (offsets[own] + start)
                crcs = [zlib.crc32(data[x:y]) for x, y in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                cols = [batch.column(0)[a:b].take(pa.array(own)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(ids.view("<i4"))))
                yield pa.RecordBatch.from_arrays(cols, names)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in them, how many such sequences). Pieces of one length are alike, so a whole run of equal
    sequences is planned at once, and the work depends on capacity, not on the number of pieces.

    A sequence is filled with the longest piece that fits until none does. Then its shortest piece gives way to two
    unpacked ones if the best such pair fills the gap more tightly.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of length {length} doesn't fit {capacity}")
        left[length] += n
    out = []
    while left.any():
        free, gap, chosen = left.copy(), capacity, []
        while gap and len(fit := np.flatnonzero(free[: gap + 1])):
            n = int(fit[-1])
            take = min(int(free[n]), gap // n)
            chosen += [n] * take
            free[n] -= take
            gap -= n * take
        if gap:
            room = gap + chosen[-1]
            free[chosen[-1]] += 1
            lengths = np.flatnonzero(free[: room + 1])
            best = (chosen[-1], 0, 0)
            i, j = 0, len(lengths) - 1
            while i <= j:
                a, b = int(lengths[i]), int(lengths[j])
                if a + b > room or (i == j and free[a] < 2):
                    j -= 1
                else:
                    best = max(best, (a + b, b, a))
                    i += 1
            if best[1]:
                chosen[-1:] = [best[1], best[2]]
        need = Counter(chosen)
        times = min(int(left[n]) // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
        out.append((tuple(chosen), times))
    return out


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces (with a column length, from 1 to capacity) with sequence_id and offset. Sequence ids run from 0.

    The counts of lengths, at most `capacity` rows, go to the driver and make the plan. Pieces are numbered within their
    length: in hashed buckets of the columns `order`, so that a length that holds a third of all rows is spread, then by
    the sums of the buckets before. A number and the plan give the place. Repeated rows get places of their own. The
    columns start, rank, salt and slot of the plan are internal and replace any of the names _salt, _rank, _before.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    made = plan(counts, capacity)
    slots: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
    used: Counter = Counter()
    sequence = 0
    for lengths, times in made:
        offset = 0
        for n in lengths:
            slots.append((n, used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    at = np.array(sorted(slots), np.int64).reshape(-1, 4)
    keys = (at[:, 0] << 44) + at[:, 1]
    # A length of n pieces is dealt to about sqrt(n) buckets of about sqrt(n) pieces.
    buckets = F.lit([max(1, math.isqrt(counts.get(n, 0))) for n in range(capacity + 1)])
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), buckets[F.col("length").cast("int")].cast("long")))
    sums = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select(F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_before"))
    own = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*order)))
    ranked = own.join(before, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_rank") - 1 + F.col("_before")).drop("_l", "_s", "_salt", "_before")
    names = pieces.columns
    place = ranked.schema.names.index("_rank"), ranked.schema.names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = batch.column(place[0]).to_numpy(), batch.column(place[1]).to_numpy().astype(np.int64)
            k = np.searchsorted(keys, (length << 44) + rank, "right") - 1
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at[k, 2] + rank - at[k, 1]), pa.array(at[k, 3])], [*names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(run, schema)


def packed(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: id, piece, start, length, ids_crc32 (and ids), sequence_id, offset.

    Null and empty texts are packed with their end id. Repeated rows are packed each. Other columns aren't read. An
    empty table gives no rows. The pieces are written once, so that texts are encoded once.
    """
    pieces = cut(token_pieces(df, path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    return pack(pieces, [id_col, "piece", "start", "ids_crc32"], capacity)


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id and ids, the tokens of each sequence in order: at most capacity of them. rows: packed(with_ids=True)."""
    parts = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda x: x["ids"])).alias("ids"))
