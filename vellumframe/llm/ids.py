"""Ids of a byte-level BPE vocabulary file of the tokenizers library, as that library gives them.

All ids come from the library. A text is cut into units whose ids don't depend on what stands around them (units.py), and
each worker asks the library once for a unit that it remembers. New units go to it as lines of a text, since a call for
each costs more than its ids. Texts that hold the name of an added token, and vocabularies of another kind, go to it whole.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vellumframe.llm.units import LETTERS, Remembered, spread

#: Units that go to the library as one text.
LINE = 100
#: Units that are one match of the split pattern.
_WORD = re.compile(f" ?[{LETTERS}]+").fullmatch


class Encoder(Remembered):
    """Ids of whole texts. Names of added tokens, special ones among them, are read as these tokens, as the library does
    unless told otherwise."""

    def __init__(self, path: str, limits: tuple[int, int, int] | None = None):
        super().__init__(limits)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.size = self.library.get_vocab_size()
        self.names = [t.content for t in self.library.get_added_tokens_decoder().values()]
        kind = file.get("pre_tokenizer") or {}
        self.line_end = self._of(["\n"])[0]
        # Only for such a file are units what units.py says, and a line end one id that no other token holds.
        self.by_units = (
            kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and file.get("normalizer") is None and file.get("truncation") is None
            and file.get("padding") is None and file["model"].get("type") == "BPE" and not file["model"].get("dropout") and len(self.line_end) == 1 and not any("\n" in x for x in self.names)
        )
        # The same model without the pattern, for lines that are one match each.
        self.without = Tokenizer(self.library.model)
        if self.by_units:
            self.without.pre_tokenizer = Sequence([ByteLevel(add_prefix_space=False, use_regex=False), Split(self.library.id_to_token(int(self.line_end[0])), "isolated")])
        self.ids, self.begin, self.length = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def _of(self, texts: list[str], library=None) -> list[np.ndarray]:
        """The library's results also hold tokens and offsets, so only a few are held at a time."""
        return [np.array(x.ids, "<u4") for at in range(0, len(texts), 64) for x in (library or self.library).encode_batch_fast(texts[at : at + 64], add_special_tokens=False)]

    def keep(self, slots: np.ndarray) -> None:
        self.length, begin = self.length[slots], self.begin[slots]
        self.ids = self.ids[spread(begin, self.length)]
        self.begin = np.cumsum(self.length) - self.length

    def add(self, units: list[str]) -> None:
        words = np.fromiter((_WORD(x) is not None for x in units), bool, len(units))
        rest = np.flatnonzero(~words)
        # A line end beside white space would join its run.
        lines = np.array([x != "" and "\n" not in x and not x[-1].isspace() and not x[x[0] == " "].isspace() for x in map(units.__getitem__, rest.tolist())], bool)
        begin, length, data = np.empty(len(units), np.int64), np.empty(len(units), np.int64), []
        for at, library in ((np.flatnonzero(words), self.without), (rest[lines], self.library)):
            # Words in order have beginnings in common, which keeps the library's tables near.
            order = sorted(at.tolist(), key=units.__getitem__)
            line = [units[i] for i in order]
            stream = np.concatenate([np.empty(0, "<u4"), *[np.append(x, self.line_end) for x in self._of(["\n".join(line[k : k + LINE]) for k in range(0, len(line), LINE)], library)]])
            ends = np.flatnonzero(stream == self.line_end[0])
            if len(ends) != len(line):
                raise ValueError("the vocabulary has other line ends than one id for each")
            starts = np.append(0, ends + 1)
            begin[order], length[order] = starts[:-1] + sum(map(len, data)), np.diff(starts) - 1
            data.append(stream)
        alone = self._of([units[i] for i in rest[~lines].tolist()])
        sizes = np.array([len(x) for x in alone], np.int64)
        begin[rest[~lines]], length[rest[~lines]] = sum(map(len, data)) + np.cumsum(sizes) - sizes, sizes
        self.begin, self.length = np.append(self.begin, begin + len(self.ids)), np.append(self.length, length)
        self.ids = np.concatenate([self.ids, *data, *alone])

    def encode_batch(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids as little-endian unsigned 32-bit integers, and where those of each text begin, and the last end. Null
        is empty. end_id, if given, follows each text's ids."""
        texts = pc.fill_null(texts, "")
        whole = np.full(len(texts), not self.by_units)
        for name in self.names:
            whole |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        tail = np.array([] if end_id is None else [end_id], "<u4")
        rows = np.flatnonzero(whole)
        parts = list(zip(rows.tolist(), self._of(texts.take(pa.array(rows)).to_pylist()), strict=True))
        units = np.flatnonzero(~whole)
        length = np.zeros(len(texts), np.int64)
        blocks = []
        for k, slots, offsets in self.of(texts.take(pa.array(units))):
            sizes = self.length[slots]
            ids = self.ids[spread(self.begin[slots], sizes)]
            blocks.append((units[k], ids, np.append(0, np.cumsum(sizes))[offsets]))
        blocks += [(np.array([k]), x, np.array([0, len(x)])) for k, x in parts]
        for k, _, offsets in blocks:
            np.add.at(length, k, np.diff(offsets))
        offsets = np.append(0, np.cumsum(length + len(tail)))
        out, at = np.empty(int(offsets[-1]), "<u4"), offsets[:-1].copy()
        if len(blocks) == 1 and len(blocks[0][0]) == len(texts):  # all texts, in order
            at += length
            text = np.ones(len(out), bool)
            if len(tail):
                text[at] = False
            out[text] = blocks[0][1]
        else:
            for k, ids, own in blocks:
                sizes = np.diff(own)
                out[spread(at[k], sizes)] = ids
                at[k] += sizes
        if len(tail):
            out[at] = tail[0]
        return out, offsets

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch(pa.array([text], pa.string()))[0]


@functools.lru_cache(maxsize=2)
def encoder(path: str, limits: tuple[int, int, int] | None = None) -> Encoder:
    """The encoder of a vocabulary file; a worker that runs several tasks keeps it, with what it remembers."""
    return Encoder(path, limits)
