"""Disguises that a base span is part of, and prose after whole spans."""

from __future__ import annotations

import pytest

from vellumframe.llm import pii


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("jоhn@example.com ok", "email", "jоhn@example.com"),
        ("to john [dot] doe@example.com now", "email", "john [dot] doe@example.com"),
        ("call +1 988 555 248 five six two now", "phone", "+1 988 555 248 five six two"),
        ("a​b@example.org", "email", "a​b@example.org"),
        ("john@example.com [dot] uk ok", "email", "john@example.com [dot] uk"),
    ],
)
def test_disguise_around_a_base_span(text, kind, found):
    base, more = pii.spans(text)
    assert base and [(k, text[a:b]) for k, a, b in more] == [(kind, found)]
    assert pii.redact_text(text) == text.replace(found, f"[{kind.upper()}]")


@pytest.mark.parametrize("text", ["john@example.com. It was good", "john@example.com .  At last", "call +1 988 555 2485, one two three go", "call +1 988 555 2485. One two three", "ping 10.0.0.1 one two three", "ports one two three 10.0.0.1", "mail jоhn, or ann@example.com. It is"])
def test_whole_spans_take_no_prose(text):
    base, more = pii.spans(text)
    assert len(base) == 1 and more == []
