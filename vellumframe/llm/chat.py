"""Chat formatting: layouts are known by the hash of their field paths, and become canonical turns, then one template."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

#: What the template puts around turns. A turn: BEGIN role MIDDLE text END.
BEGIN, MIDDLE, END = "<s>[INST ", "]", "[/INST]</s>\n"
#: Characters with which control strings begin or end, and the escape itself: in texts and roles they follow an escape,
#: so no control string of this template or another of the kind occurs in them.
_CONTROL = re.compile(r"[\\<>\[\]]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<s>\[INST ((?:[^\\<>\[\]]|\\.)*)\]((?:[^\\<>\[\]]|\\.)*)\[/INST\]</s>\n", re.S)
LEARNED = "assistant"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of it under the loss mask: the texts of the assistant."""
    out, masks, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{escape(role or '')}{MIDDLE}", escape(text or "")
        if role == LEARNED:
            masks.append((at + len(head), at + len(head) + len(body)))
        out.append(head + body + END)
        at += len(out[-1])
    return "".join(out), masks


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts again. Raises if anything but turns is there."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError("not a formatted conversation")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


# Layouts. A path names fields with dots, and [] for the elements of an array.


def schema_paths(kind: DataType, at: str = "") -> list[str]:
    """The leaf paths of a Spark type."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return [at + ("{}" if isinstance(kind, MapType) else "")]


def value_paths(value, at: str = "") -> set[str]:
    """The leaf paths of a JSON value."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


#: Declarative mappings: the paths of a layout, and its turns in order. A turn is (role, path), or (role path, text path)
#: below one array. Of two texts for one role that follow one another, the second goes after a blank line.
_LIST = [("messages[]", "role", "content"), ("conversations[]", "from", "value"), ("conversation[]", "role", "content"), ("turns[]", "role", "text"), ("messages[]", "role", "text"), ("messages[]", "from", "value"), ("messages[]", "author", "content")]
_FLAT = [
    [("user", "prompt"), ("assistant", "response")],
    [("user", "prompt"), ("assistant", "completion")],
    [("system", "system"), ("user", "prompt"), ("assistant", "response")],
    [("user", "question"), ("assistant", "answer")],
    [("user", "instruction"), ("assistant", "output")],
    [("user", "instruction"), ("assistant", "response")],
    [("user", "instruction"), ("user", "input"), ("assistant", "output")],
    [("user", "instruction"), ("user", "context"), ("assistant", "response")],
    [("system", "system"), ("user", "instruction"), ("assistant", "output")],
    [("system", "system_prompt"), ("user", "question"), ("assistant", "response")],
]
MAPPINGS: dict[str, tuple] = {fingerprint([f"{a}.{r}", f"{a}.{t}"]): ("list", a[:-2], r, t) for a, r, t in _LIST}
MAPPINGS |= {fingerprint([f"system", f"{a}.{r}", f"{a}.{t}"]): ("list", a[:-2], r, t, "system") for a, r, t in _LIST}  # noqa: F541
MAPPINGS |= {fingerprint([p for _, p in flat]): ("flat", flat) for flat in _FLAT}
#: Rows that are turns: the columns of id, order, role and text.
MAPPINGS |= {fingerprint(["conv_id", "turn", "role", "text"]): ("rows", "conv_id", "turn", "role", "text")}
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatbot": "assistant"}
#: Fields beside the layout that identify a row and are left out of its fingerprint.
BESIDE = ("conv_id", "id", "source", "lang")


#: The paths of each layout, by which a table with columns beside them is told.
LAYOUTS = [["conv_id", "turn", "role", "text"], *[[f"{a}.{r}", f"{a}.{t}"] for a, r, t in _LIST], *[["system", f"{a}.{r}", f"{a}.{t}"] for a, r, t in _LIST], *[[p for _, p in flat] for flat in _FLAT]]
LAYOUTS += [[f"{a}.{r}", f"{a}.{t}[].type", f"{a}.{t}[].text"] for a, r, t in _LIST]
MAPPINGS |= {fingerprint([f"{a}.{r}", f"{a}.{t}[].type", f"{a}.{t}[].text"]): ("list", a[:-2], r, t) for a, r, t in _LIST}


def mapping_of(paths) -> tuple:
    """The mapping of a layout, its fields beside included or not. Raises for an unknown layout."""
    paths = set(paths)
    for found in (paths, paths - set(BESIDE)):
        if (key := fingerprint(found)) in MAPPINGS:
            return MAPPINGS[key]
    raise ValueError(f"no mapping for the layout {sorted(paths)}")


def table_mapping(paths) -> tuple:
    """The mapping of a table: that of its layout, else of the largest layout that its columns hold; others are beside it. Raises
    where there is none, or two of a size."""
    try:
        return mapping_of(paths)
    except ValueError:
        held = sorted((x for x in LAYOUTS if set(x) <= set(paths)), key=len)
        if not held or len(held) > 1 and len(held[-1]) == len(held[-2]):
            raise
        return MAPPINGS[fingerprint(held[-1])]


def _said(value) -> str:
    """Text as it is, null as nothing, parts of text joined, any other JSON value as JSON. Raises for a part that isn't text."""
    if isinstance(value, list) and value and all(isinstance(x, dict) and "type" in x for x in value):
        if not all(x["type"] == "text" and isinstance(x.get("text"), str) for x in value):
            raise ValueError("a part that isn't text")
        return "".join(x["text"] for x in value)
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


#: Fields of a turn, and of a record, that no mapping reads; they are left out when a layout has no mapping of its own.
SPARE = ("name", "score", "id", "weight", "tool_calls", "timestamp", "model")


def _layout(value) -> tuple:
    """The mapping of a JSON record: by all its paths, else without those through a spare field."""
    paths = value_paths(value)
    try:
        return mapping_of(paths)
    except ValueError:
        return mapping_of(p for p in paths if not any(x.removesuffix("[]") in SPARE for x in p.split(".")))


def turns_of(value) -> list[tuple[str, str]]:
    """Canonical (role, text) turns of a JSON record. A list stands for the messages of a record; a known list without elements
    has no turns, but what another layout holds beside it counts. Raises ValueError for a layout without a mapping and for a turn without a role."""
    if isinstance(value, list):
        value = {"messages": value}
    if not isinstance(value, dict):
        raise ValueError("not a record")
    empty = [a[:-2] for a, _, _ in _LIST if value.get(a[:-2]) == []]
    if empty:  # another layout may be filled beside the empty list
        value = {k: v for k, v in value.items() if k not in empty}
        rest = {k: v for k, v in value.items() if k not in (*BESIDE, *SPARE)}
        if set(rest) <= {"system"}:
            return [("system", _said(rest["system"]))] if rest.get("system") else []
    kind, *rest = _layout(value)
    if kind == "list":
        array, role, text, *system = rest
        if not all(isinstance(x, dict) and isinstance(x.get(role), str) for x in value[array]):
            raise ValueError("a turn without a role")
        head = [("system", _said(value[system[0]]))] if system and value.get(system[0]) else []
        return head + [(ROLES.get(x[role], x[role]), _said(x.get(text))) for x in value[array]]
    if kind == "rows":
        raise ValueError("a single turn isn't a conversation")
    out: list[tuple[str, str]] = []
    for role, path in rest[0]:
        text = _said(value.get(path))
        if out and out[-1][0] == role:
            out[-1] = (role, f"{out[-1][1]}\n\n{text}" if text else out[-1][1])
        elif text or role != "system":
            out.append((role, text))
    return out


def json_turns(df: DataFrame, json_col: str, id_col: str = "conv_id") -> DataFrame:
    """(id, turn, role, text, error) of rows whose JSON texts may each have another layout. Null gives no turns. A text that
    isn't JSON, a layout without a mapping and a turn without a role give one row with the error, whose turn, role and text are
    null; `good` and `rejected` tell them apart."""
    kind = df.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                try:
                    found = [(turn, role, said, None) for turn, (role, said) in enumerate(turns_of(json.loads(text)) if text else [])]
                except (ValueError, RecursionError) as e:  # the record, not the job, is at fault
                    found = [(None, None, None, str(e) or type(e).__name__)]
                own += [k] * len(found)
                rows += found
            cols = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 4, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own, pa.int64())), *cols], [id_col, "turn", "role", "text", "error"])

    return df.select(id_col, json_col).mapInArrow(run, f"`{id_col}` {kind}, turn long, role string, text string, error string")


def good(turns: DataFrame) -> DataFrame:
    """The turns of json_turns as format_conversations takes them."""
    return turns.where("error is null").drop("error")


def rejected(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id and error of records that json_turns couldn't read."""
    return turns.where("error is not null").select(id_col, "error")


def canonical(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turn, role, text) of a table, by the mapping that its schema's fingerprint selects; columns beside a known layout aren't
    read. Raises for a table that holds none, or two of a size. Parts of a turn that aren't text stop the job."""
    kind, *rest = table_mapping(schema_paths(df.schema))
    known = lambda role: F.coalesce(*[F.when(role == k, v) for k, v in ROLES.items()], role)
    if kind == "rows":
        own, turn, role, text = rest
        return df.select(F.col(own).alias(id_col), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    if kind == "list":
        array, role, text, *system = rest
        parted = any(p.startswith(f"{array}[].{text}[]") for p in schema_paths(df.schema))
        part = lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.raise_error(F.lit("a part that isn't text")).cast("string"))
        said = lambda x: F.array_join(F.transform(x, part), "") if parted else x
        rows = df.select(id_col, F.posexplode(array).alias("turn", "_x")).select(id_col, F.col("turn").cast("long"), known(F.col("_x")[role]).alias("role"), said(F.col("_x")[text]).alias("text"))
        return rows if not system else rows.union(df.where(F.col(system[0]) != "").select(id_col, F.lit(-1).cast("long"), F.lit("system"), F.col(system[0])))
    texts: list[tuple[str, list[Column]]] = []
    for role, path in rest[0]:
        if texts and texts[-1][0] == role:
            texts[-1][1].append(F.when(F.col(path) != "", F.col(path)))
        else:
            texts.append((role, [F.coalesce(F.col(path), F.lit(""))]))
    turns = F.array(*[F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *cols).alias("text")) for role, cols in texts])
    rows = df.select(id_col, F.posexplode(turns).alias("turn", "_x")).select(id_col, F.col("turn").cast("long"), F.col("_x.role").alias("role"), F.col("_x.text").alias("text"))
    return rows.where("role <> 'system' or text <> ''")


def format_conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: id, formatted, mask (array of start, end). turns: (id, turn, role, text).

    Turns are dealt by id, sorted within tasks, and each conversation is formatted as its rows stream by; a task holds
    one conversation. Order: turn (null first), then role and text. Repeated turns stay. Null text is empty, and so is a
    null role. A null id is a conversation like another. An empty table gives no rows.
    """
    kind = turns.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(done: list) -> pa.RecordBatch:
            rows = [format_turns(x) for _, x in done]
            mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], id_type), pa.array([x[0] for x in rows]), pa.array([[{"start": a, "end": b} for a, b in x[1]] for x in rows], mask)], [id_col, "formatted", "mask"])

        current: tuple | None = None
        id_type = None
        for batch in batches:
            id_type, done = batch.column(0).type, []
            for own, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if current is None or current[0] != own:
                    if current is not None:
                        done.append(current)
                    current = (own, [])
                current[1].append((role, text))
            if done:
                yield made(done)
        if current is not None:
            yield made([current])

    rows = turns.select(id_col, "turn", "role", "text").repartition(id_col).sortWithinPartitions(id_col, "turn", "role", "text")
    return rows.mapInArrow(run, f"`{id_col}` {kind}, formatted string, mask array<struct<start: bigint, end: bigint>>")


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of the turns and of the text under the mask, taken from the formatted output."""
    kind = formatted.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns, digest = parse_turns(text), hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode())
                loss = "".join([unescape(text[m["start"] : m["end"]]) for m in mask])
                rows.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, types, strict=True))], [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(id_col, "formatted", "mask").mapInArrow(run, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
