"""An encoder's own limits of memory change no ids."""

from __future__ import annotations

from random import Random

import pyarrow as pa
import public_tokenizers

from vellumframe.llm import units
from vellumframe.llm.ids import Encoder


def test_limits_change_no_ids():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = pa.array([f"word{i} and the other{i % 50} line,\nthat goes on {i * i}." for i in range(600)] + [None, "", "x " * 3000])
    want = Encoder(path).encode_batch(texts, 2)
    for limits in (units.AMPLE, (2000, 200, 3000)):
        encode = Encoder(path, limits)
        parts = [encode.encode_batch(texts[a:b], 2)[0].tolist() for a, b in units.row_groups(texts, limits[0])]
        assert sum(parts, []) == want[0].tolist() and len(encode.slots) <= max(limits[1], 600_000 if limits is units.AMPLE else 2200)


def test_words_and_marks_equal_the_library():
    """Letters alone go to the library without its pattern; marks after a word are asked for apart from it."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode, random = Encoder(path), Random(3)
    parts = ["word", "Été", "ñandú", "ǅon", "ʼn", "x9", "42", "don't", "it's", "'s", "&&&", "!?", "$%", "-'!", "!'s", "_", "[]", "`~", "^", "ß", "ſ", "中文", "е́", "\n", " ", "  ", "\t", " "]
    texts = ["".join(random.choice(parts) + random.choice(["", " ", " ", "\n"]) for _ in range(random.randrange(30))) for _ in range(3000)] + ["a&&& b!! c\nd?! e's!! ", "word!!!", "a'! b", "\n&& x"]
    ids, offsets = encode.encode_batch(pa.array(texts), 2)
    want = [x.ids + [2] for x in encode.library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want
    bare, ends = encode.encode_batch(pa.array(["word word"] * 3))  # without an end id
    assert bare.tolist() == encode.library.encode("word word").ids * 3 and ends[-1] == len(bare)


def test_a_word_with_marks_is_remembered_once():
    encode = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encode.encode_batch(pa.array([f"so wordy{m} then" for m in ("", "&&&", "!!", "$%", "...", "-", "!")]), 2)
    assert [k for k in encode.slots if "wordy" in k] == ["wordy"]
