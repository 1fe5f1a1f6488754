"""Repair of conversations, against a search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

from vellumframe.llm import repair
from vellumframe.llm.queries import op13_repair

WHITE = " \t\n\v\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, code string, audit string, kind int"


def cheapest(rows: list[tuple[str, str, str]]) -> tuple[int, str, tuple]:
    """(cost, audit, repaired) of (role, text, fault) rows: the least of all, by trying every edit at every place."""

    @lru_cache(None)
    def best(at: int, roles: str, room: int):
        found = []
        if at == len(rows) and roles in ("", "sua", "ua"):
            found.append((0, "", ()))
        ways = []
        if at < len(rows):
            role, text, fault = rows[at]
            ways.append(("D", 2, None, "", at + 1))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                ways.append(("K", more, role, text, at + 1))
                ways += [("R", 1 + more, r, text, at + 1) for r in ("user", "assistant")]
        if room:
            ways += [("I", 5, r, "", at) for r in ("user", "assistant")]
        for edit, cost, role, text, to in ways:
            after = roles
            if role is not None:
                after = roles + role[:1]
                if not role or not any(x.startswith(after) for x in ("sua", "ua", "suau", "uau")):
                    continue
                after = {"suau": "su", "uau": "u"}.get(after, after)
            rest = best(to, after, room - (edit == "I"))
            if rest:
                found.append((cost + rest[0], edit + rest[1], (() if role is None else ((role, text),)) + rest[2]))
        return min(found, key=lambda x: x[:2]) if found else None

    return best(0, "", 3)


def want(rows: list[tuple]) -> dict:
    """The report of (turn, role, text) rows of one conversation, damaged already."""
    digest = lambda x: hashlib.sha256(x.encode()).digest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[2])))
    seen, marked, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.rstrip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
        if fault:
            count[fault] += 1
    numbers = [t for t, _, _ in rows if t is not None]
    cost, audit, made = cheapest(tuple(marked))
    pairs = [(a[1][:1], b[1][:1]) for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, **count, "illegal": sum("".join(p) not in ("su", "ua", "au") for p in pairs),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(),
    }


def harm(rows: list[tuple]) -> dict:
    """conv_id: rows after damage, every conv_id there."""
    out: dict = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out.setdefault(conv, [])
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def random_rows(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "", " \n", "done. ", "a. b", None, "é?"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "User"]
    return [(conv, r.choice([None, *range(8)]), r.choice(roles), r.choice(texts)) for conv in [None, *range(n)] for _ in range(r.randint(1, 6))]


def held(got, wanted: dict) -> None:
    rows = {r["conv_id"]: {k: r[k] for k in next(iter(wanted.values()))} for r in got}
    assert len(rows) == len(got) and set(rows) == set(wanted)
    for conv, x in wanted.items():
        assert rows[conv] == x, conv


def test_random(spark):
    rows = random_rows(1, 250)
    df = spark.createDataFrame([(*r, "x", "K", 3) for r in rows], SCHEMA)
    held(repair.repaired(df).collect(), {c: want(x) for c, x in harm(rows).items()})


def test_undamaged_and_turns(spark):
    rows = random_rows(2, 60)
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own: dict = {}
    for c, *r in rows:
        own.setdefault(c, []).append(tuple(r))
    held(repair.report(df).collect(), {c: want(x) for c, x in own.items()})
    made: dict = {}
    for r in sorted(repair.turns(df).collect(), key=lambda r: r["n"]):
        made.setdefault(r["conv_id"], []).append((r["n"], f"{r['role']}:{r['text']}"))
    for c, x in own.items():
        lines = made.get(c, [])
        assert [n for n, _ in lines] == list(range(len(lines)))
        assert hashlib.sha256("\n".join(t for _, t in lines).encode()).hexdigest() == want(x)["repaired_sha256"]


def test_long_in_segments(spark, monkeypatch):
    """A conversation over many segments and blocks costs what one segment says, and its audit is the same."""
    r = random.Random(3)
    codes = ["".join(r.choice(repair.CODES) for _ in range(n)) for n in (0, 1, 700, 1500, 1501, 3)]
    whole = repair.solve(codes)
    monkeypatch.setattr(repair, "SEGMENT", 64)
    monkeypatch.setattr(repair, "CELLS", 100)
    assert repair.solve(codes) == whole
    rows = [(7, i, r.choice(["user", "assistant"]), f"say {r.randint(0, 900)}" + r.choice([".", "", "!"])) for i in range(1500)]
    rows += [(7, 5, "user", "tie.")] * 3 + [(8, 1 << 40, "user", "far."), (8, -(1 << 40), "system", "low.")]
    got = {x["conv_id"]: x for x in repair.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    seen, ordered = set(), sorted([x[1:] for x in rows if x[0] == 7], key=lambda x: (x[0], x[1], hashlib.sha256(x[2].encode()).digest()))
    code = ""
    for _, role, text in ordered:
        fault = 3 if (role, text) in seen else 0 if text[-1] in ".!" else 1
        seen.add((role, text))
        code += repair.CODES[4 * "sua".index(role[0]) + fault]
    audit, *facts = repair.solve([code])[0]
    assert (got[7]["audit"], got[7]["cost"], got[7]["duplicate"]) == (audit, facts[-1], facts[1])
    assert re.fullmatch("[DIKR]{1503,}", audit) and got[8]["gaps"] == (1 << 41) - 1


def test_empty_and_texts(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.repaired(empty).count() == 0 and repair.turns(empty).count() == 0
    long = "word " * 50_000 + "."
    rows = [("a", 0, "user", long), ("a", 1, "assistant", long), ("b", 0, "system", "s.")]
    got = {r["conv_id"]: r for r in repair.report(spark.createDataFrame(rows, empty.schema)).collect()}
    assert got["a"]["audit"] == "KK" and got["a"]["repaired_sha256"] == hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest()
    assert (got["b"]["audit"], got["b"]["cost"]) == ("D", 2)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    held(op13_repair(spark, sf).collect(), {c: want(x) for c, x in harm(rows).items()})
