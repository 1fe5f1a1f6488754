"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Tasks read splits of files and emit candidates, the marks by which records begin, with where each would end. Candidates point
to their successors; pointers are doubled inside splits and then, by joins, from split to split. What the chain from a
file's start doesn't meet is a mark inside a payload.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumframe.llm.work import cut, new_path

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
MAGIC = b"WARC/1.1\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length: *([0-9]+) *\r\n", re.I)


def _line(name: str, value):
    """A header line, or nothing where the value is null; line ends in a value can't end the line, and it doesn't end like a mark."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(F.regexp_replace(value, "[\r\n]+", " "), "WARC/1[.]1$", "%57ARC/1.1"), F.lit("\r\n")), F.lit(""))


def _urn(page_id):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per row, in WARC 1.1, as files below path, in one write. Files may be of any size: they are read in splits.

    Of rows with equal payloads of at least LEAST_BYTES, the one with the largest id is a response and the others revisit
    it; rows that repeat that id and payload are responses too. Null html is the empty payload, a null url no line, a
    null id is named null and revisits as any other. Payloads are equal if their lengths, SHA-1 and SHA-256 are; one row
    for each that repeats is written to a table, and by its size Catalyst either broadcasts it or joins in another way.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("bytes", F.octet_length("html")).withColumn("digest", F.sha1("html"))
    long = F.col("bytes") >= LEAST_BYTES
    rows = rows.withColumn("strong", F.when(long, F.sha2("html", 256)))
    again = rows.where(long).groupBy("strong", "digest", "bytes").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    again = cut(again.select(F.col("strong").alias("_strong"), F.col("digest").alias("_digest"), F.col("bytes").alias("_bytes"), "first"), "revisited")
    met = rows.join(again, (F.col("strong") == F.col("_strong")) & (F.col("digest") == F.col("_digest")) & (F.col("bytes") == F.col("_bytes")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    made = met.select("*", revisit.alias("revisit"), F.when(revisit, http).otherwise(F.concat(http, "html")).alias("block"))
    record = F.concat(
        F.lit(MAGIC.decode()),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("id"))),
        _line("WARC-Target-URI", F.col("url")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _urn(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        _line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
        F.col("block"),
    )
    made.select(record.alias("value")).write.mode("append").option("lineSep", "\r\n\r\n").text(path)


def _ends(starts: np.ndarray, successors: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each candidate of a split: the candidate at its successor (-1: none here), and where its chain leaves the split, at `size`
    or beyond, or -1 where it comes to no record. starts ascend; successors[i] is where the record after candidate i
    would begin, or -1. Pointers are doubled until all have left."""
    n = len(starts)
    dead, left = n, n + 1
    at = np.searchsorted(starts, successors)
    hit = (successors >= 0) & (at < n) & (starts[np.minimum(at, n - 1)] == successors) if n else np.zeros(0, bool)
    to = np.where(hit, at, np.where(successors >= size, left, dead))
    last, jump = np.arange(n), np.append(to, [dead, left])  # the last candidate of a chain as far as it is known
    while (jump[:n] < n).any():
        on = jump[:n] < n
        last = np.where(on, last[np.minimum(jump[:n], n - 1)], last)
        jump = jump[jump]
    out = np.where(jump[:n] == left, successors[last], -1) if n else np.zeros(0, np.int64)
    return np.where(hit, to, -1), out


class _Split:
    """The segments of one split of a file, from one mark of a record to the next, and the candidates that begin with the marks."""

    def __init__(self, key: tuple):
        self.key, self.parts, self.at, self.size = key, [], [], 0

    def add(self, segment: bytes, first: bool) -> None:
        """first: the part of a file before its first mark."""
        if first and segment:
            raise ValueError("the file doesn't begin with a record")
        if not first:
            self.at.append(self.size - len(MAGIC))
            self.parts.append(segment)
        # A split ends behind the mark after its last segment: that mark begins the next split's first candidate.
        self.size += len(segment) + len(MAGIC)

    def candidates(self) -> Iterator[tuple]:
        """start, exit, heads, successor, block (None where it goes on in the next split) and headers of the candidates whose chain leaves
        the split. heads: the candidates before which no other leads here, from which this one is met."""
        content = b"".join(x for p in self.parts for x in (MAGIC, p))
        low = self.at[0] if self.at else 0
        starts, heads, successors = np.array(self.at, np.int64), [], []
        for i, p in enumerate(self.parts):
            begin = self.at[i] - low
            end = content.find(b"\r\n\r\n", begin + len(MAGIC) - 2)
            found = _LENGTH.search(content, begin, end + 2) if end >= 0 else None
            heads.append(end)
            successors.append(end + 4 + int(found[1]) + 4 + low if found else -1)
        # The mark after the last segment is this split's end, so a record that ends there leaves it.
        to, out = _ends(starts, np.array(successors, np.int64), self.size - len(MAGIC))
        met: list[list[int]] = [[] for _ in self.parts]
        for i in range(len(starts)):
            if out[i] >= 0:
                own = met[i] or [int(starts[i])]
                met[i] = own
                if to[i] >= 0:
                    met[to[i]] = sorted({*met[to[i]], *own})
        for i in np.flatnonzero(out >= 0).tolist():
            lines = content[starts[i] - low + len(MAGIC) : heads[i]].decode(errors="replace").split("\r\n")
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            whole = successors[i] - 4 - low <= len(content)
            yield int(starts[i]), int(out[i]), met[i], successors[i], content[heads[i] + 4 : successors[i] - 4 - low] if whole else None, headers, content[heads[i] + 4 :] if not whole else b""


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[_Split]:
    """Splits of (file, block, size, value) rows, which come in the order of the file within a split."""
    now = None
    for batch in batches:
        for file, block, size, value in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            if now is None or now.key[:2] != (file, block):
                if now is not None:
                    yield now
                now, first = _Split((file, block, size)), block == 0
            now.add(value.as_py(), first)
            first = False
    if now is not None:
        yield now


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """file, block, size and value: what stands between one mark and the next, by Spark's text reader, which splits files anywhere and
    gives a segment to the split in which it begins. A record without a mark in its payload is one segment."""
    rows = spark.read.option("lineSep", MAGIC.decode()).option("pathGlobFilter", "*.txt").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))


#: What is known of a candidate beside what a reader makes of it. open: the beginning of a block that goes on in later splits.
_PLACE = "file string, block long, size long, bytes long, start long, exit long, heads array<long>, next long, open binary, headers string, fault string"
_TYPES = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.string(), pa.string()]


def _scanned(spark: SparkSession, path: str, make: Callable, schema: str, types: list) -> DataFrame:
    """A row for each candidate whose chain leaves its split, with make(headers, block), and one for each split (start null).
    What make raises is kept as a fault, which counts only if the record is reached."""
    names = [x.split()[0] for x in f"{_PLACE}, {schema}".split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (None,) * len(types)
        for split in _splits(batches):
            rows = [(*split.key, split.size, *[None] * 7, *none)]
            for start, out, heads, after, body, headers, rest in split.candidates():
                fault, made = None, none
                if body is not None:
                    try:
                        made = make(headers, body)
                    except (KeyError, ValueError, TypeError) as e:
                        fault = f"{type(e).__name__}: {e}"
                rows.append((*split.key, None, start, out, heads, after, None if body is not None else rest, json.dumps(headers), fault, *made))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*_TYPES, *types], strict=True)], names)

    return _segments(spark, path).mapInArrow(run, f"{_PLACE}, {schema}")


def _reached(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates that a chain from the start of their file meets, with their offsets in the file, at and after; and where each
    split begins and ends (file, block, base, end).

    Inside a split chains are known, and a chain meets a split in one candidate at most. So pointers are doubled, by joins, from
    split to split: as many rounds as the number of splits of the largest file has binary digits. A chain that comes to no
    record, or doesn't end with its file, stops the job."""
    key = lambda p: [F.col("file").alias(f"{p}file"), F.col("block").alias(f"{p}block")]
    splits = scanned.where("start is null").select("file", "block", "size", "bytes")
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # splits of a file
    based = cut(splits.select("file", "block", before.alias("base"), (before + F.col("bytes") - len(MAGIC)).alias("end")), "splits")
    own = scanned.where("start is not null").join(based.select(*key("_"), "base", "end"), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).drop("_file", "_block")
    own = cut(own.withColumn("at", F.col("base") + F.col("start")).withColumn("out", F.col("base") + F.col("exit")).withColumn("after", F.col("base") + F.col("next")), "candidates")
    # Where chains enter splits: at the starts of files, and where some chain has left another split.
    doors = own.select(F.col("file").alias("_file"), F.col("out").alias("_at")).union(splits.where("block = 0").select("file", F.lit(0).cast("long"))).distinct()
    enter = own.join(doors, (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_at"))).select("file", "block", "at", "out", "heads", "start", "size")
    enter = cut(enter, "doors")
    jump = enter.select("file", F.col("at").alias("from"), F.col("out").alias("to"))
    files = splits.groupBy("file").agg(F.max("size").alias("size"))
    found = files.where("size > 0").select("file", F.lit(0).cast("long").alias("at"))
    n = 0
    while True:
        step = jump.select(F.col("file").alias("_file"), "from", "to")
        found = cut(found.union(found.join(step, (F.col("file") == F.col("_file")) & (F.col("at") == F.col("from"))).select("file", F.col("to").alias("at"))).distinct(), "reached")
        if (more := found.count()) == n or not more:
            break
        n = more
        after = step.select(F.col("_file").alias("_f"), F.col("from").alias("_from"), F.col("to").alias("_to"))
        jump = cut(step.join(after, (F.col("_file") == F.col("_f")) & (F.col("to") == F.col("_from")), "left").select(F.col("_file").alias("file"), "from", F.coalesce("_to", "to").alias("to")), "jumps")
    size = files.select(F.col("file").alias("_file"), F.col("size").alias("_size"))
    there = enter.select(F.col("file").alias("_f"), F.col("at").alias("_at")).distinct()
    bad = found.join(size, F.col("file") == F.col("_file")).where("at <> _size").join(there, (F.col("file") == F.col("_f")) & (F.col("at") == F.col("_at")), "left_anti")
    if worst := bad.select("file", "at").first():
        raise ValueError(f"{worst['file']} is no chain of records: no record begins at {worst['at']}")
    met = found.select(F.col("file").alias("_file"), F.col("at").alias("_at"))
    door = enter.join(met, (F.col("file") == F.col("_file")) & (F.col("at") == F.col("_at"))).select(*key("_d_"), F.col("start").alias("_d_start"), F.col("heads").alias("_d_heads"))
    rows = own.join(door, (F.col("file") == F.col("_d_file")) & (F.col("block") == F.col("_d_block")) & (F.col("start") >= F.col("_d_start")) & F.arrays_overlap("heads", "_d_heads"))
    return rows.drop("_d_file", "_d_block", "_d_start", "_d_heads"), based


def _records(spark: SparkSession, path: str, make: Callable, schema: str, types: list) -> DataFrame:
    """make(headers, block) of each record of the archives below path."""
    names = [x.split()[0] for x in schema.split(", ")]
    scanned = cut(_scanned(spark, path, make, ", ".join(f"m_{x}" for x in schema.split(", ")), types), "scanned")
    rows, based = _reached(scanned)
    rows = cut(rows, "records")
    if worst := rows.where("fault is not null").select("file", "at", "fault").first():
        raise ValueError(f"{worst['file']}: the record at {worst['at']} can't be read: {worst['fault']}")
    whole = rows.where("open is null").select(*[F.col(f"m_{n}").alias(n) for n in names])
    parted = cut(rows.where("open is not null").select("file", "at", "after", "end", "open", "headers"), "parted")
    if parted.isEmpty():
        return whole

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for split in _splits(batches):
            n = len(split.at)
            yield pa.RecordBatch.from_arrays([pa.array([split.key[0]] * n, pa.string()), pa.array([split.key[1]] * n, pa.int64()), pa.array(split.at, pa.int64()), pa.array(split.parts, pa.binary())], ["_f", "_b", "_rel", "value"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for headers, begin, at, after, end, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = b"".join([begin, *[x for p in parts for x in (MAGIC, p["value"])]])
                found.append(make(json.loads(headers), block[: len(begin) + after - 4 - end]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    # Records with marks in their payload that reach over a split's end: the later segments are read once more and put behind.
    # Each asks for the splits that its block reaches into, so segments meet records by equality.
    into = parted.join(based.select(F.col("file").alias("_f"), F.col("block").alias("_b"), F.col("base").alias("_base"), F.col("end").alias("_end")), (F.col("file") == F.col("_f")) & (F.col("_base") > F.col("end")) & (F.col("_base") - len(MAGIC) < F.col("after")))
    into = cut(into.select("file", "at", "after", "_f", "_b", "_base"), "into")
    later = _segments(spark, path).mapInArrow(segments, "_f string, _b long, _rel long, value binary")
    later = later.join(into, ["_f", "_b"]).withColumn("_at", F.col("_base") + F.col("_rel")).where("_at < after")
    pieces = later.groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("_at", "value"))).alias("parts"))
    built = parted.join(pieces, ["file", "at"]).select("headers", "open", "at", "after", "end", "parts").mapInArrow(build, schema)
    return whole.unionByName(built)


def _facts(headers: dict[str, str], block: bytes) -> tuple[str | None, int, str, str, str | None]:
    """id, payload bytes, digest, type and the id referred to. A response's payload is measured and its digest verified;
    that of a revisit is known from its headers."""
    number = lambda urn: None if urn is None or urn == "<urn:page:null>" else urn[len("<urn:page:") : -1]
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "revisit":
        return number(headers["warc-record-id"]), int(_LENGTH.search(head + b"\r\n")[1]), digest, kind, number(headers["warc-refers-to"])
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload differs from its digest")
    return number(headers["warc-record-id"]), len(payload), digest, kind, None


def read(spark: SparkSession, path: str, id_col: str = "page_id", id_type: str = "long") -> DataFrame:
    """One row per record: id, payload_bytes, payload_digest, record_type, refers_to. Files are read in splits of Spark's size, so an
    archive may have any; a task holds one split. A file that isn't a chain of records from start to end, and a payload that
    differs from its digest, stop the job. So does a header that holds the mark of a record and reaches over a split's end,
    which write() never makes."""
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    rows = _records(spark, path, _facts, "id string, payload_bytes long, payload_digest string, record_type string, refers_to string", types)
    return rows.select(F.col("id").cast(id_type).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """id, record_type, url and block of each record, for use beyond the facts."""
    make = lambda headers, block: (headers["warc-record-id"], headers["warc-type"], headers.get("warc-target-uri"), block)
    return _records(spark, path, make, "record_id string, record_type string, url string, block binary", [pa.string(), pa.string(), pa.string(), pa.binary()])


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives of its own in the shared folder and reads them back."""
    path = new_path(pages.sparkSession, "warc")
    write(pages, path, id_col, url_col, html_col)
    return read(pages.sparkSession, path, id_col, pages.select(id_col).schema[0].dataType.simpleString())
