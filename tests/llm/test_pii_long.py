"""Very long texts of any kind take time that grows with their length, and base spans stay those of the plain patterns."""

from __future__ import annotations

import random
import time

import pytest
from test_llm_operators import want_base

from vellumframe.llm import pii

N = 1_000_000


@pytest.mark.parametrize(
    "text",
    [
        "a" * N, "1" * N, "1" * N + ".1.2", "0" * N + ".1.2.3", "a" * N + "@b", "a@" * (N // 2), "a." * (N // 2), "@a.b" * (N // 4), "1." * (N // 2), "+1(" * (N // 3), "a dot " * (N // 6), "x at " + "a dot " * (N // 6),
        "x @ " + "a . " * (N // 4), "dot dot at " * (N // 11), "one " * (N // 4), "joe at mail dot com " * (N // 20), "a [at] b [dot] com " * (N // 19), " " * N, "[" * N, "1 - " * (N // 4),
    ],
    ids=lambda t: t[:12],
)
def test_time_grows_with_length(text):
    began = time.process_time()
    pii.spans(text)
    assert time.process_time() - began < 20


def test_zeros_are_numbers():
    text = "0" * 5000 + ".1.2.3 and " + "0" * 5000 + "256.1.2.3 and 1.2.3." + "9" * 5000
    assert pii.detect(text) == [("ip", 0, 5006)]


def test_base_spans_of_odd_texts():
    rnd = random.Random(3)
    parts = ["a", "b.", ".", "@", "x@y", ".z", "_", "é", " ", "1", "1.", "25", "300", "000", "+", "(", "-", "4111111111111111", "%"]
    for _ in range(20000):
        text = "".join(rnd.choices(parts, k=rnd.randrange(16)))
        assert pii._said(pii.detect(text)) == want_base(text), text
