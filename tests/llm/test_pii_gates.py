"""What the transducers accept is tried in every text, and prose stays."""

from __future__ import annotations

import pytest

from vellumframe.llm import pii


@pytest.mark.parametrize(
    ("kind", "found"),
    [
        ("email", "jean arobase exemple.fr"),
        ("email", "jane at example.com"),
        ("email", "juan arroba ejemplo.es"),
        ("email", "jane at example . com"),
        ("email", "jane at mail dot example. com"),
        ("ip", "192 dot 168 dot 1 dot 10"),
        ("ip", "192 dot 168 dot one dot 10"),
        ("phone", "+46 70 one 23 45 six 7"),
        ("card", "4111 1111 1111 one 111"),
        *[("email", f"jan at firma dot {last}") for last in ("pl", "se", "ca", "br", "mx", "com", "museum")],
        ("email", "jan arroba empresa punto mx"),
        ("email", "jan dot b at post dot firma dot pl"),
    ],
)
@pytest.mark.parametrize("text", ["{}", "write, {}, soon", "see .net or @ me: {}."])
def test_same_words_in_any_text(kind, found, text):
    text = text.format(found)
    assert (kind, found) in [(k, text[a:b]) for k, a, b in pii.spans(text)[1]] and found not in pii.redact_text(text)


@pytest.mark.parametrize(
    "text",
    [
        "stay at home. It was late", "stay at home. it was late", "look at the dot matrix", "at this point we rest, at some point in time", "meet at noon. The dot is red", "he came at 10.30 and left", "in 1999 one of 25 came", "3 point 5 of 12 dot 7",
        "one at last. De facto", "um 12. Drei Mal",
    ],
)
def test_prose_stays(text):
    assert pii.spans(text) == ([], []) and pii.redact_text(text) == text


@pytest.mark.parametrize("text", ["ping 10.0.0.1 one more time", "server one 10.0.0.1 is up", "call +1 988 555 2485. One of us", "call +1 988 555 2485, one of us"])
def test_one_spelled_digit_beside_a_whole_span(text):
    assert len(pii.spans(text)[0]) == 1 and pii.spans(text)[1] == []
