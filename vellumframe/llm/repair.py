"""Repair of conversations: faults of turns, and the cheapest edits that make roles alternate, by a dynamic program over tensors.

A turn becomes one character of a code: the initial of its role and its fault. The code of a conversation is as long as its
audit, which is one value of the result, so codes are what a task may gather; texts never are. Conversations of like length
form a tensor, turns first. One step takes a turn of all of them: backwards it gives the least cost from each state to the end,
forwards the first of the cheapest edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of edits.
RENAME, DELETE, INSERT, CUT_SHORT = 1, 2, 5, 5
#: Faults as codes have them, below four times the initial's number: system, user, assistant, another.
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
INITIALS, OTHER = "sua", 3
CODES = "abcdefghijklmnop"
#: States: nothing yet, after the system's turn, after the user's, after the assistant's. The first and last may end.
FOLLOWS = np.array([2, 2, 3, 2])  # the state after a turn that an edit names, from each state
KEPT = np.array([[1, 0, 0, 0], [2, 2, 0, 2], [0, 0, 3, 0], [0, 0, 0, 0]])  # by initial and state: the state after a kept turn, 0 if it can't be kept
LEGAL = np.zeros((4, 4), bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True
FAR = 1 << 40
#: Turns whose costs are stored at once, and turns in one tensor.
SEGMENT, CELLS = 1 << 12, 1 << 17
#: Turns of a conversation that one task sorts, by their numbers.
BLOCK = 256
FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
WHITE = "\\x20\\x09-\\x0D"


def damaged(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with damage by the CRC of conv_id:turn, modulo 20: 0 drops the row, 1 empties its
    text, 2 takes its stops away, 3 repeats it, 4 makes the user say it. Null roles and texts are one space, and so are null
    numbers in the CRC's string."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    times = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    made = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), F.explode(times).alias("_copy"))
    return made.drop("_copy")


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id, at, turn, role, digest, text. at: the place of a turn; null ones stand where the smallest long does."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    turn = F.col("turn").cast("long")
    rows = rows.select("conv_id", turn.alias("turn"), F.coalesce(turn, F.lit(-(1 << 63)).cast("long")).alias("at"), said("role").alias("role"), said("text").alias("text"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _code(initial: Column, fault: Column) -> Column:
    return F.substring(F.lit(CODES), (4 * initial + fault + 1).cast("int"), F.lit(1))


def codes(rows: DataFrame) -> DataFrame:
    """conv_id, code, gaps of each conversation. code: a character for each turn in order of turn (nulls first), role and the
    digest of its text; gaps: numbers missing between the smallest and the largest turn.

    Equal rows of a turn are counted before anything else. Where a role and a text were first seen comes from an aggregate and
    meets the rows by their place, so that a text which fills a conversation is gathered nowhere. Turns are sorted in blocks of
    their numbers."""
    initial = F.coalesce(*[F.when(F.startswith("role", F.lit(x)), i) for i, x in enumerate(INITIALS)], F.lit(OTHER))
    blank = ~F.col("text").rlike(f"[^{WHITE}]")
    fault = F.when(blank, BLANK).when(~F.col("text").rlike(f"[.!?][{WHITE}]*\\z"), TRUNCATED).otherwise(SOUND)
    keys = ["conv_id", "at", "role", "digest"]
    own = _turns(rows).select(*keys, "turn", initial.alias("_initial"), fault.alias("_fault"))
    own = own.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"), F.first("turn").alias("turn"), F.first("_initial").alias("_initial"), F.first("_fault").alias("_fault"))
    seen = own.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select(*[F.col(k).alias(f"_{k}") for k in keys], F.lit(True).alias("_new"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met = own.join(seen, on, "left")
    first, again = _code(F.col("_initial"), F.col("_fault")), _code(F.col("_initial"), F.lit(DUPLICATE))
    code = F.when(F.col("_fault") == BLANK, F.repeat(first, F.col("n"))).when(F.col("_new"), F.concat(first, F.repeat(again, F.col("n") - 1))).otherwise(F.repeat(again, F.col("n")))
    joined = lambda *c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x["code"]), "")
    blocks = met.withColumn("code", code).groupBy("conv_id", F.floor(F.col("at") / BLOCK).alias("block")).agg(
        joined("at", "role", "digest", "code").alias("code"), F.size(F.collect_set("turn")).cast("long").alias("_n"), F.min("turn").alias("_min"), F.max("turn").alias("_max")
    )
    whole = blocks.groupBy("conv_id").agg(joined("block", "code").alias("code"), (F.max("_max") - F.min("_min") + 1 - F.sum("_n")).alias("_gaps"))
    return whole.select("conv_id", "code", F.coalesce("_gaps", F.lit(0).cast("long")).alias("gaps"))


def _back(code: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs (turn, conversation, state) from before each turn on; end: those after the last. Turns beyond a
    conversation's end have the code 255 and change nothing."""
    costs = np.empty((len(code) + 1, *end.shape), np.int64)
    costs[-1] = end
    for t in range(len(code) - 1, -1, -1):
        after, initial, fault = costs[t + 1], code[t] >> 2 & 3, code[t] & 3
        to = KEPT[initial]
        extra = np.where(fault >= BLANK, FAR, np.where(fault == TRUNCATED, CUT_SHORT, 0))[:, None]
        keep = np.where(to > 0, np.take_along_axis(after, to, 1), FAR) + extra
        here = np.minimum(np.minimum(keep, after[:, FOLLOWS] + RENAME + extra), after + DELETE)
        once = np.minimum(here, here[:, FOLLOWS] + INSERT)
        costs[t] = np.where((code[t] == 255)[:, None], after, np.minimum(once, once[:, FOLLOWS] + INSERT))
    return costs


def _trace(code: np.ndarray, costs: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edits (three places for a turn, 0 where nothing is), and the states after them. Of cheapest edits the ASCII-least
    comes first; it decides the next state, so the first difference decides the order of audits."""
    edits, row = np.zeros((len(code), 3, len(state)), np.uint8), np.arange(len(state))
    for t in range(len(code)):
        open_, initial, fault = code[t] != 255, code[t] >> 2 & 3, code[t] & 3
        extra = np.where(fault == TRUNCATED, CUT_SHORT, 0)
        for place in range(3):  # two inserted turns lead to every state, so a third never pays
            here, to, named = costs[t][row, state], KEPT[initial, state], FOLLOWS[state]
            drop = open_ & (costs[t + 1][row, state] + DELETE == here)
            add = open_ & ~drop & (costs[t][row, named] + INSERT == here)
            keep = open_ & ~drop & ~add & (fault < BLANK) & (to > 0) & (costs[t + 1][row, to] + extra == here)
            name = open_ & ~drop & ~add & ~keep
            edits[t, place] = drop * ord("D") + add * ord("I") + keep * ord("K") + name * ord("R")
            state = np.where(add | name, named, np.where(keep, to, state))
            open_ = add
            if not open_.any():
                break
    return edits, state


def solve(found: list[str]) -> list[tuple[str, int, int, int, int, int]]:
    """audit, blank, duplicate, truncated, illegal, cost of each code. Codes of like length (by powers of two) go together."""
    out: list = [None] * len(found)
    sizes = np.array([len(x) for x in found], np.int64)
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        longest = 1 << int(max(1, sizes[order[at]]) - 1).bit_length()
        stop = at + max(1, CELLS // longest)
        own = [i for i in order[at:stop].tolist() if sizes[i] <= longest]
        at += len(own)
        steps = int(sizes[own[-1]])
        code = np.full((steps, len(own)), 255, np.uint8)
        for c, i in enumerate(own):
            code[: sizes[i], c] = np.frombuffer(found[i].encode(), np.uint8) - ord("a")
        begins = range(0, max(1, steps), SEGMENT)
        # The least costs at the ends of segments are stored, those within a segment again when edits are traced.
        ends = [np.tile(np.array([0, 2 * INSERT, INSERT, 0]), (len(own), 1))]
        for b in reversed(begins):
            ends.append(_back(code[b : b + SEGMENT], ends[-1])[0])
        state, traced = np.zeros(len(own), np.int64), []
        for k, b in enumerate(begins):
            part = code[b : b + SEGMENT]
            edits, state = _trace(part, _back(part, ends[len(begins) - 1 - k]), state)
            traced.append(edits.reshape(-1, len(own)))
        tail = np.zeros((2, len(own)), np.uint8)  # turns inserted at the end
        for place in range(2):
            missing = (state == 1) | (state == 2)
            tail[place] = missing * ord("I")
            state = np.where(missing, FOLLOWS[state], state)
        traced.append(tail)
        told, fault, initial = code != 255, code & 3, code >> 2 & 3
        count = lambda what: (told & (fault == what)).sum(axis=0)
        illegal = (told[1:] & ~LEGAL[initial[:-1], initial[1:]]).sum(axis=0)
        facts = np.stack([count(BLANK), count(DUPLICATE), count(TRUNCATED), illegal, ends[-1][:, 0]]).T.tolist()
        for c, i in enumerate(own):
            out[i] = (b"".join(x[:, c][x[:, c] > 0].tobytes() for x in traced).decode(), *facts[c])
    return out


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation (conv_id, turn, role, text).

    A turn's first fault counts: blank, duplicate (its role and text were seen earlier), truncated. Edits: K keeps a turn, R names
    another role (1), D deletes (2, and must where a turn is blank or a duplicate), I inserts an empty turn (5); a truncated turn
    that isn't deleted adds 5. The audit has the cheapest edits whose roles' initials are (s?(ua)+)?, of equal ones the ASCII-least.

    Null roles and texts are one space. A role is kept by its initial; one that begins otherwise, or is empty, can't be kept. Turns of
    one number stand by role and the digest of their text. Rows without a conv_id are one conversation. An empty table gives no
    rows. Other columns, whatever their names, are not read."""
    kind = rows.select("conv_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audit, *facts = zip(*solve(batch.column(1).to_pylist()), strict=True) if batch.num_rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array(x, pa.int64()) for x in facts], pa.array(audit, pa.string())], ["conv_id", *FACTS, "audit"])

    return codes(rows).mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{x} long" for x in FACTS) + ", audit string")


def _in_order(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """The rows of each conversation in order, after a row with its audit. One exchange and one sort; a task reads them as a
    stream, so that it holds no conversation."""
    empty = [F.lit(None).cast("long").alias(x) for x in FACTS]
    heads = audited.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), "audit", *FACTS)
    turns = _turns(rows).select("conv_id", F.lit(1).alias("kind"), "at", "role", "digest", "text", F.lit(None).cast("string").alias("audit"), *empty)
    return heads.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "at", "role", "digest").drop("kind", "at", "digest")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, str | None, str | None]]:
    """(head, None, None) where a conversation begins, then (None, role, text) of each repaired turn."""
    audit, at, state = "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            at, state = at + 1, int(FOLLOWS[state])
            yield None, "user" if state == 2 else "assistant", ""

    for batch in batches:
        cols = batch.to_pydict()
        for row, (role, text, new) in enumerate(zip(cols["role"], cols["text"], cols["audit"], strict=True)):
            yield from inserted()
            if new is not None:
                audit, at, state = new, 0, 0
                yield (cols["conv_id"][row], *[cols[x][row] for x in FACTS], new), None, None
                continue
            edit, at = audit[at], at + 1
            if edit == "K":
                state = int(KEPT[INITIALS.index(role[0]), state])
            elif edit == "R":
                state = int(FOLLOWS[state])
                role = "user" if state == 2 else "assistant"
            if edit != "D":
                yield None, role, text
    yield from inserted()


def turns(rows: DataFrame, audited: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: conv_id, n (from 0), role, text. audited: what audits(rows) gave, if it is there."""
    kind = rows.select("conv_id").schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types, out, conv, n = ["conv_id", "n", "role", "text"], None, [], None, 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal types
            for b in batches:
                types = types or [b.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string()]
                yield b

        for head, role, text in _edited(typed()):
            if head:
                conv, n = head[0], 0
                continue
            out.append((conv, n, role, text))
            n += 1
            if len(out) == 2000:
                yield made()
                out.clear()
        if out:
            yield made()

    return _in_order(rows, audits(rows) if audited is None else audited).mapInArrow(run, f"conv_id {kind.simpleString()}, n long, role string, text string")


def report(rows: DataFrame) -> DataFrame:
    """audits(rows) with repaired_sha256, the digest of the repaired turns as role:text, joined by line ends."""
    kind = rows.select("conv_id").schema[0].dataType.simpleString()
    names = ["conv_id", *FACTS, "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, digest, first, id_type = [], None, None, True, None

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for b in batches:
                id_type = b.schema.field("conv_id").type
                yield b

        def made() -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * len(FACTS), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

        for head, role, text in _edited(typed()):
            if head is None:
                digest.update((f"{role}:{text}" if first else f"\n{role}:{text}").encode())
                first = False
                continue
            if current:
                out.append((*current, digest.hexdigest()))
            if len(out) == 2000:
                yield made()
                out.clear()
            current, digest, first = head, hashlib.sha256(), True
        if current:
            out.append((*current, digest.hexdigest()))
            yield made()

    return _in_order(rows, audits(rows)).mapInArrow(run, f"conv_id {kind}, " + ", ".join(f"{x} long" for x in FACTS) + ", audit string, repaired_sha256 string")


def repaired(conversations: DataFrame) -> DataFrame:
    """The report of damaged conversations, with a row for every conv_id of the undamaged ones. Those that lost all rows have
    zeros, an empty audit and the digest of an empty string."""
    found = report(damaged(conversations)).withColumnRenamed("conv_id", "_conv")
    ids = conversations.select("conv_id").distinct()
    none = {x: F.lit(0).cast("long") for x in FACTS} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    met = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return met.select("conv_id", *[F.coalesce(F.col(x), d).alias(x) for x, d in none.items()])
