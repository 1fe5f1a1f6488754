"""Units of texts for byte-level vocabularies: runs of pattern matches that have the same ids wherever they stand.

The split pattern of these vocabularies ends a match before a space that something else than white space follows, and takes
a run of white space up to its last character when something follows it. So no match reaches over a cut at the beginning of
a white-space run, nor over one before its last character, and each part, taken alone, has the matches that it has in its
text. Texts are cut by Arrow before every space and line feed; where that would cut a run elsewhere, by a pattern instead.
Marks between a letter or digit and white space are a match of their own, and are cut off the word before them; not where an
apostrophe is among them, which may begin one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the pattern means it: Unicode's property White_Space (a fixed value of the vocabulary's format).
_POINTS = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
WHITE = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in _POINTS)
UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]")
_EDGE = re.compile(f" (?=[^{WHITE}])")
_WHITE2 = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in _POINTS) + "]"
#: A cut inside a run that isn't before its last character; and the signs that begin keys, below.
_ELSEWHERE = f"{_WHITE2}[ \\n](?:{_WHITE2}|\\z)|[\\x00\\x01]"
#: Letters whatever the version of Unicode, and marks.
LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", "!-&(-/:-@\\[-`{-~"
_MARK = f"([0-9{LETTERS}])([{_MARKS}]+)( |\\z)"
#: Bytes of text whose units are held at once; units, and characters of them, that a worker remembers.
GROUP, UNITS, CHARS = 3 << 20, 450_000, 12 << 20
#: The same where no other step shares a worker's memory: units are asked for again less often.
AMPLE = (8 << 20, 600_000, 16 << 20)


def slices(text: str) -> Iterator[str]:
    """The text in parts of about an eighth of GROUP characters that end between units."""
    at, size = 0, GROUP // 8
    while len(text) - at > size and (edge := _EDGE.search(text, at + size)):
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:]


def _key(unit: str) -> str:
    """Units as Arrow's cuts give them: without the space at their head, or with a sign if they have none."""
    return unit[1:] if unit[0] == " " and unit[1:2] not in ("\0", "\1", "\n") else unit if unit[0] == "\n" else "\0" + unit


def _unit(key: str) -> str:
    return key[1:] if key[:1] in ("\0", "\1") else key if key[:1] == "\n" else " " + key


def _cut(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different keys of the units, the number of the key of each unit, and where each text's units begin."""
    signed = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " \n"), _MARK, "\\1 \1\\2\\3")
    parts = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0"), signed, ""), " ")
    found = parts.flatten().dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), parts.offsets.to_numpy() - parts.offsets[0].as_py()


def row_groups(texts: pa.Array, group: int | None = None) -> Iterator[tuple[int, int]]:
    """Rows from, to: of about `group` bytes of text together, GROUP without it, or one."""
    total, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(total):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (group or GROUP), "right")))
        yield at, stop
        at = stop


def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices of runs of these beginnings and lengths, one run after the other."""
    ends = np.cumsum(length)
    return np.repeat(begin - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


class Remembered:
    """Asks for each different unit once while it is remembered. Subclasses hold what belongs to a unit at its slot."""

    def __init__(self, limits: tuple[int, int, int] | None = None):
        self.limits = limits  # in place of GROUP, UNITS and CHARS
        self.slots: dict[str, int] = {}
        self.used = np.empty(0, np.int64)  # in how many groups of texts a unit was met
        self.held = 0

    def add(self, units: list[str]) -> None:
        """Makes and holds what belongs to these units; their slots follow those given before."""
        raise NotImplementedError

    def keep(self, slots: np.ndarray) -> None:
        """Holds on to what belongs to these slots, which get the numbers from 0, and lets go of the rest."""
        raise NotImplementedError

    def _forget(self) -> None:
        """Units met in one group alone go first; it costs time and changes no result."""
        _, most, chars = self.limits or (GROUP, UNITS, CHARS)
        least, long = 2, np.fromiter(map(len, self.slots), np.int64, len(self.slots)) > 4 * chars // most
        while (kept := np.flatnonzero((self.used >= least) & ~long)).size > most // 2:
            least *= 2
        keys = list(self.slots)
        keys = [keys[i] for i in kept.tolist()]
        self.keep(kept)
        self.slots, self.used, self.held = dict(zip(keys, range(len(keys)), strict=True)), np.ones(len(keys), np.int64), sum(map(len, keys))

    def _slots(self, keys: list[str]) -> np.ndarray:
        slots = np.fromiter(map(self.slots.get, keys, repeat(-1)), np.int64, len(keys))
        _, most, chars = self.limits or (GROUP, UNITS, CHARS)
        if len(self.slots) + np.count_nonzero(slots < 0) > most or self.held > chars:
            self._forget()
            slots = np.fromiter(map(self.slots.get, keys, repeat(-1)), np.int64, len(keys))
        if len(at := np.flatnonzero(slots < 0)):
            new, n = [keys[i] for i in at.tolist()], len(self.slots)
            slots[at] = np.arange(n, n + len(new))
            self.slots.update(zip(new, range(n, n + len(new)), strict=True))
            self.used = np.append(self.used, np.zeros(len(new), np.int64))
            self.held += sum(map(len, new))
            self.add([_unit(k) for k in new])
        self.used[slots] += 1
        return slots

    def of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, the slots of their units, where each row's begin) for texts without nulls. A row may come in several
        parts, one after the other."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        odd = pc.match_substring_regex(texts, _ELSEWHERE).to_numpy(zero_copy_only=False) | (size > (self.limits or (GROUP,))[0])
        for row in np.flatnonzero(odd).tolist():
            for part in slices(texts[row].as_py()):
                units = UNIT.findall(part)
                different = {u: i for i, u in enumerate(dict.fromkeys(units))}
                slots = self._slots([_key(u) for u in different])
                yield np.array([row]), slots[np.fromiter(map(different.__getitem__, units), np.int64, len(units))], np.array([0, len(units)])
        rest = np.flatnonzero(~odd)
        even = texts.take(pa.array(rest))
        for a, b in row_groups(even, self.limits and self.limits[0]):
            keys, codes, offsets = _cut(even[a:b])
            yield rest[a:b], self._slots(keys)[codes], offsets
