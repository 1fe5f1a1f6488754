"""Personal data in texts: base patterns, and offset-preserving deobfuscation.

The second pass rewrites a disguised text by transducers that keep, for each character they put out, the range of
source characters it stands for: look-alike letters and full-width forms become ASCII, invisible characters go, spelled
digits become digits, and disguised at and dot become @ and a dot. The same patterns run over the result, and what they
find is mapped back to the source.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from vellumframe.llm.work import handed_back

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The same matches without a second look at a run: a match of IP begins where a run of digits does, as each takes runs whole.
_IP_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

Span = tuple[str, int, int]

#: Letters that look like ASCII ones: Cyrillic, then Greek.
LOOK_ALIKE = dict(zip("аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅ", "aeopcyxijsdhqwABEKMHOPCTXIJS", strict=True)) | dict(zip("οαιυνρΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oaiuvpABEZHIKMNOPTYX", strict=True))
#: Full-width forms of the ASCII characters, and a few other shapes of @, dot, digits and hyphen.
LOOK_ALIKE |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
LOOK_ALIKE |= {"﹫": "@", "．": ".", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", " ": " "}
LOOK_ALIKE |= {chr(base + i): str(i) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
INVISIBLE = "­​‌‍⁠﻿"
#: Spelled digits in English, French, German and Spanish.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_ODD = re.compile("[" + re.escape("".join(LOOK_ALIKE) + INVISIBLE) + "]")
_PLAIN = re.compile(r"[ -~\n\t]*\Z")
_WORD_DIGIT = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")"
#: A run of digits and spelled ones; those with a spelled digit or a dot as a word are rewritten.
_SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:\+|plus )?(?:(?:{_WORD_DIGIT}|[0-9]+)(?:(?:[ .,-]|, )(?:dot|point|punto|punkt)?[ .,-]?|\b))+(?![^\W_])", re.I)
_SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORD_DIGIT}|dot|point|punto|punkt)(?![^\W_])", re.I)
_DIGIT_TOKEN = re.compile(rf"({_WORD_DIGIT})(?![^\W_])|[0-9]+|\bplus |\+|(?:[ ,-]*\b(dot|point|punto|punkt)\b[ ,-]*)|[ ,.-]+", re.I)
_AT = r"(?:\s?[\[({<]\s?(?:at|@|arobase|arroba|ät)\s?[\])}>]\s?)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|\.|point|punto|punkt)\s?[\])}>]\s?)"
#: Bracketed disguises, spaced signs, and words where both at and dot are words and the last part looks like a domain's.
_BRACKETED = re.compile(rf"(?P<at>{_AT})|(?P<dot>{_DOT})", re.I)
#: Last parts that are taken after any at and dot; after a dot that is a word, see _LAST_ANY.
_LAST = "(?:com|net|org|edu|gov|io|info|biz|co|fr|de|es|uk|eu|ch|at|it|nl|example|test)(?![A-Za-z0-9-])"
_LAST_ANY = "(?P<any>[A-Za-z]{2,})(?![A-Za-z0-9-])"
_LABEL = "[A-Za-z0-9-]+"
#: The name before an at, as the reversed text shows it.
_BEFORE = re.compile(r"[A-Za-z0-9_%+-]++(?:(?:\.|\s(?:tod|otnup|tknup)\s)[A-Za-z0-9_%+-]++)*(?![A-Za-z0-9._%+-])", re.I)
_AT_SIGN = re.compile(r"\s(?P<worded>at)(?=\s)|\s(?:arobase|arroba)(?=\s)|\s?@", re.I)
#: After a sign or a word that means nothing else, blanks may stand around a dot.
_SIGNED = re.compile(rf"\s?{_LABEL}(?:(?:\.|\s(?:dot|point|punto|punkt)\s|\s\.\s?|\.\s){_LABEL})*(?:(?:\s(?:dot|point|punto|punkt)\s|\s?\.\s?){_LAST}|\s(?:dot|point|punto|punkt)\s{_LAST_ANY})", re.I)
#: Of them, those that begin no sentence.
_LAST_LOW = "(?-i:com|org|edu|gov|io|biz|uk|eu|fr|nl|ch)(?![A-Za-z0-9-])"
#: After the word at, a stop before a blank ends a sentence unless such a part follows, and point is a common word ("at this point we").
_WORDED = re.compile(rf"\s{_LABEL}(?:(?:\.|\s(?:dot|point|punto|punkt)\s|\s\.\s?){_LABEL})*(?:(?:\s(?:dot|point|punto|punkt)\s|\s?\.){_LAST}|\s?\.\s{_LAST_LOW}|\s(?:dot|punto|punkt)\s{_LAST_ANY})", re.I)
#: "at the dot matrix": before an unlisted last part, these words are no host.
_NO_HOST = re.compile(r"\b(?:the|a|an|this|that|each|every|any|one|some|no|its|his|her|their|our|my|your)\s(?:dot|punto|punkt)\s[a-z]+\Z", re.I)
_WORDED_PART = re.compile(r"(?P<at>\s(?:at|arobase|arroba)\s|\s?@\s?)|(?P<dot>\s(?:dot|point|punto|punkt)\s|\s?\.\s?)", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The matches of EMAIL, in time that grows with the text's length. Each has one @ and begins where the run of its
    characters before that begins, or where the match before it ends."""
    done = 0
    for m in _HOST.finditer(text):
        at = m.start()
        low = max(done, text.rfind("@", done, at) + 1)
        start = low + len(text[low:at].rstrip(_LOCAL))
        if start < at:
            done = m.end()
            yield start, done


def detect(text: str) -> list[Span]:
    """Leftmost matches of each kind, those that fail its test dropped; by start, then kind as listed."""
    out: list[tuple[int, int, str, int]] = []
    if "@" in text:
        out += [(a, 0, "email", b) for a, b in _emails(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    if "." in text:
        out += [(m.start(), 1, "ip", m.end()) for m in _IP_RUN.finditer(text) if all(len(y := x.lstrip("0")) < 4 and int(y or "0") <= 255 for x in m[0].split("."))]
    if "+" in text:
        out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


class Tape:
    """A text whose characters know which source characters they stand for."""

    def __init__(self, text: str):
        self.text, self.begin, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, new text), ascending and apart. A new text stands for all it replaces."""
        if not edits:
            return
        text, begin, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            begin += self.begin[at:a] + [self.begin[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.begin, self.end = begin + self.begin[at:], end + self.end[at:]


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    found = detect(text)
    # A span that is whole as it stands ends at a stop or comma before a blank; an address of four numbers at any blank.
    ends = {b: kind for kind, _, b in found if kind != "email"}
    starts = {a for kind, a, _ in found if kind == "ip"}
    for run in _SPELLED_RUN.finditer(text):
        if not _SPELLED.search(run[0]):
            continue
        parts, at, stop = [[]], 0, len(run[0].rstrip(" ,.-"))
        while at < stop and (m := _DIGIT_TOKEN.match(run[0], at)) and m.end() > at:
            spelled, dot = m[1], m[2]
            gap = m[0].strip() in ("", ",", "-", ".") and not spelled
            new = DIGITS[spelled.lower()] if spelled else "." if dot else "+" if m[0].lower() in ("plus ", "+") else m[0] if not gap else "." if m[0] == "." else ""
            a, b = run.start() + at, run.start() + m.end()
            if gap and not dot and " " in m[0] and (ends.get(a) == "ip" or b in starts or a in ends and m[0][0] in ".,"):
                parts.append([])
            elif m.end() <= stop:
                parts[-1].append((a, b, new))
            at = m.end()
        for made in parts:
            if sum(c.isdigit() for _, _, new in made for c in new) >= 4:
                edits += [x for x in made if x[2] != text[x[0] : x[1]]]
    return edits


def _worded(text: str) -> list[tuple[int, int, str]]:
    """The ats, with what stands before them up to the at before, or the end of the last address, and the host after them."""
    edits, done, low, back, n = [], 0, 0, text[::-1], len(text)
    for at in _AT_SIGN.finditer(text):
        low, before = at.end(), max(low, done)
        if at.start() < before or not (name := _BEFORE.match(back, n - at.start(), n - before)):
            continue
        m = (_WORDED if at["worded"] else _SIGNED).match(text, at.end())
        if not m or at["worded"] and m["any"] and _NO_HOST.search(m[0]):
            continue
        start, done = n - name.end(), m.end()
        whole = text[start:done]
        for part in _WORDED_PART.finditer(whole):
            if part["dot"] and part[0].strip() == "." and part[0] != "." and EMAIL.fullmatch(whole, 0, part.start()):
                break  # the address is whole, and this stop ends the sentence
            edits.append((start + part.start(), start + part.end(), "@" if part["at"] else "."))
    return edits


#: What every match of the worded patterns has: an at, the first part of a host, and a dot.
_MAY_WORD = re.compile(rf"(?:\s(?:at|arobase|arroba)\s|@\s?){_LABEL}\s?(?:\.|(?:dot|point|punto|punkt)\s)", re.I)


def normalise(text: str) -> Tape | None:
    """The rewritten text, or None where nothing is disguised."""
    tape = Tape(text)
    if not _PLAIN.match(text) and _ODD.search(text):
        tape.rewrite([(m.start(), m.end(), LOOK_ALIKE.get(m[0], "")) for m in _ODD.finditer(text)])
    if "[" in tape.text or "(" in tape.text or "{" in tape.text or "<" in tape.text:
        tape.rewrite([(m.start(), m.end(), "@" if m["at"] else ".") for m in _BRACKETED.finditer(tape.text)])
    if _SPELLED.search(tape.text):
        tape.rewrite(_spelled(tape.text))
    if _MAY_WORD.search(tape.text):
        tape.rewrite(_worded(tape.text))
    return None if tape.text == text else tape


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that only the rewritten text shows: mapped back, and not inside a base span of any kind. They
    may reach over base spans, which stay beside them."""
    base = detect(text)
    tape = normalise(text)
    if tape is None:
        return base, []
    starts = [a for _, a, _ in base]
    reach = list(accumulate((b for _, _, b in base), max))  # how far base spans up to this one go
    more = {}
    for kind, a, b in detect(tape.text):
        at = (kind, tape.begin[a], max(tape.end[a:b]))
        before = bisect_right(starts, at[1])
        if not before or reach[before - 1] < at[2]:
            more[at] = None
    return base, list(more)


def _said(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id; n_email, n_ip, n_card, n_phone of base spans; base_sha256; spans; n_added.

    Offsets count code points, ends are exclusive. Null text is empty: no spans, and base_sha256 of the empty string.
    Repeated rows stay. Other columns aren't read. Whole texts, no shuffle.
    """
    kind = df.select(id_col).schema[0].dataType.simpleString()
    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, more = spans(text or "")
                rows.append((*(sum(k == x[0] for x in base) for k in KINDS), hashlib.sha256(_said(base).encode()).hexdigest(), _said(base + more), len(more)))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types, strict=True))], names)

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def redact_text(text: str) -> str:
    """Each span, base or added, replaced by its kind in brackets; of spans that overlap, the union goes, named after the first."""
    base, more = spans(text)
    out, at = [], 0
    for kind, a, b in sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The rows with spans replaced in text_col, and its new length in length_col if named. Null text stays null, all
    other columns stay. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, cols = batch.schema.names, list(batch.columns)
            i = names.index(text_col)
            texts = [t if t is None else redact_text(t) for t in cols[i].to_pylist()]
            cols[i] = pa.array(texts, cols[i].type)
            if length_col:
                j = names.index(length_col)
                cols[j] = pa.array([None if t is None else len(t) for t in texts], cols[j].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return df.mapInArrow(handed_back(run), df.schema)
