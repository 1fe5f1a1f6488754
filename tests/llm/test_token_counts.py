"""Token counts, against the library's results for whole texts."""

from __future__ import annotations

import pytest
from helpers import LONG, docs

from vellumframe.llm import token_counts
from vellumframe.llm.queries import op12_token_counts, vocabulary

ODD = ["", " ", "\n\n", "a  b", "tab\t\tend ", "<|endoftext|>", "x <|endoftext|> y" * 3, LONG + "<|endoftext|> " + LONG, "é 中文 🙂" * 50, "x" * 150_000, "   w", "don't  we'll", "\x00 \x01 a", "12345 67", LONG.replace(" ", "\n \n")]


def want(texts: list[str], path: str) -> list[int]:
    if path.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    return [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_odd_texts(spark, name, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG", 1000)
    path = vocabulary(name)
    counter = token_counts.Counter(path)
    import pyarrow as pa

    assert counter.lengths(pa.array([*ODD, None], pa.string())).tolist() == want([*ODD, ""], path)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_rows(spark, name):
    df, path = docs(spark), vocabulary(name)
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    wanted = sorted(((str(i), len(t.encode()), n, n > 1024) for (i, t), n in zip(rows, want([t for _, t in rows], path), strict=True)))
    assert sorted((str(r[0]), *r[1:]) for r in token_counts.counts(df, path).collect()) == wanted
    assert token_counts.counts(df.limit(0), path).count() == 0


def test_parts_add_up():
    counter = token_counts.Counter(vocabulary("byte_bpe_50k.json"))
    text = "one two\n three   four " * 9000
    parts = list(counter.parts(text))
    assert len(parts) > 2 and "".join(parts) == text
    assert sum(want(parts, vocabulary("byte_bpe_50k.json"))) == want([text], vocabulary("byte_bpe_50k.json"))[0]


def test_query(spark, sf):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    wanted = dict(zip(rows, want(list(rows.values()), vocabulary("byte_bpe_50k.json")), strict=True))
    got = op12_token_counts(spark, sf).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {i: (len(t.encode()), wanted[i], wanted[i] > 1024) for i, t in rows.items()}
    assert len(got) == len(rows)
