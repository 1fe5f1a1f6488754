"""Token counts: texts are encoded in batches of about equal bytes inside Arrow functions, and only lengths leave a task."""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vellumframe.llm.ids import encoder
from vellumframe.llm.units import _EDGE, row_groups

#: Bytes of text that the library gets at once, and characters beyond which a text is cut. The library's results take some
#: forty times the bytes of their texts.
BATCH, LONG = 1 << 19, 1 << 16


class Counter:
    """Lengths of encoded texts. A .json file is read by tokenizers, a .model by sentencepiece, both with their defaults for
    special strings inside texts, without begin, end or other added tokens, truncation or padding.

    For a byte-level vocabulary a batch is cut into units that have the same tokens wherever they stand (units.py); the library
    encodes the different ones that the worker doesn't remember, as lines of a few texts. Other texts, and those that hold the
    name of an added token, go to it as they are."""

    def __init__(self, path: str):
        self.units, self.names, self.cuttable = None, [], False
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: pieces.encode(texts, num_threads=1)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.encode = lambda texts: library.encode_batch_fast(texts, add_special_tokens=False)
        if encoder(path).by_units:
            self.units, self.names = encoder(path), encoder(path).names
            # A match of such a split pattern ends before a space that something else than white space follows. What stands
            # before a cut there has the matches that it has alone, unless an added token reaches over it.
            added = library.get_added_tokens_decoder().values()
            self.cuttable = not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in added)

    def parts(self, text: str) -> Iterator[str]:
        """The text, or parts of LONG characters and a word whose lengths add up to its own. Where the vocabulary allows no cut,
        or a text has no space to cut at, it stays whole."""
        at = 0
        while self.cuttable and len(text) - at > LONG and (edge := _EDGE.search(text, at + LONG)):
            yield text[at : edge.start()]
            at = edge.start()
        yield text[at:] if at else text

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Lengths by the library alone, in batches of BATCH bytes."""
        out, rows, batch, held = np.zeros(len(texts), np.int64), [], [], 0
        for row, text in enumerate(texts):
            for part in self.parts(text.as_py()):
                if held > BATCH:
                    np.add.at(out, rows, [len(x) for x in self.encode(batch)])
                    rows, batch, held = [], [], 0
                rows.append(row)
                batch.append(part)
                held += len(part.encode())
        if batch:
            np.add.at(out, rows, [len(x) for x in self.encode(batch)])
        return out

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """How many tokens each text has; null is empty."""
        texts, out = pc.fill_null(texts, ""), np.zeros(len(texts), np.int64)
        whole = np.full(len(texts), self.units is None)
        for name in self.names:
            whole |= pc.match_substring(texts, name).to_numpy(zero_copy_only=False)
        alone, rest = np.flatnonzero(whole), np.flatnonzero(~whole)
        if len(alone):
            out[alone] = self._whole(texts.take(pa.array(alone)))
        if len(rest):
            for rows, slots, offsets in self.units.of(texts.take(pa.array(rest))):
                np.add.at(out, rest[rows], np.diff(np.append(0, np.cumsum(self.units.length[slots]))[offsets]))
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of a vocabulary file; a worker that runs several tasks keeps it."""
    return Counter(path)


def counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit. No shuffle; rows are taken in groups of about equal bytes, and
    texts longer than a group in parts.

    Null text is empty and has 0 bytes and tokens. Rows that repeat an id, or have none, are counted each. An empty table gives
    no rows. Other columns, whatever their names, are not read."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_groups(batch.column(1)):
                texts = batch.column(1)[a:b]
                n, size = counter(path).lengths(texts), pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], size, pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
