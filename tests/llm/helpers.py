"""Tables that every operator must take: nulls, empty and very long texts, repeated rows, clashing column names."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, kept boolean, _bucket long, _id long"
LONG = "word " * 30000 + "x" * 20000

TEXTS: list[tuple[int | None, str | None]] = [
    (5, "the same text of some words"),
    (3, "the  same\ttext of\nsome words"),
    (9, "The same text of some words"),
    (1, None),
    (2, ""),
    (4, " \n "),
    (7, LONG),
    (8, LONG),
    (6, "one"),
    (6, "one"),
    (None, "without an id"),
    (10, None),
    (1 << 40, "far away, mail a.b@c.example.com now"),
    (-7, "negative é 中 🙂"),
]


def docs(spark, rows=None):
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, "en", None if i == 3 else "s", None if t is None else len(t), 0.5, 1, True, 2, 3) for i, t in rows], DOCS)
