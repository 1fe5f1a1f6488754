"""Work is dealt over tasks by the number of rows, and what has been dealt is not moved again."""

from __future__ import annotations

import pytest

from vellumframe.operators import ordered
from vellumframe.plans import catalogue, fixtures


def plan(df) -> str:
    said = df._jdf.queryExecution().executedPlan().toString()
    return said[: said.index("Initial Plan")] if "Initial Plan" in said else said


@pytest.fixture
def small(monkeypatch):
    """Partitions of 50 of the 200 documents or parts."""
    for module in (catalogue, fixtures):
        for name in ("TEXTS", "SHORT_TEXTS"):
            if hasattr(module, name):
                monkeypatch.setattr(module, name, 50)


def test_word_overlap_moves_texts_once(spark, sf, small):
    df = catalogue.word_overlap_pr(spark, sf)
    assert "hashpartitioning(doc_id" in plan(df) and plan(df).count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in plan(df)
    assert catalogue.texts(spark, sf, "doc_id", "text").rdd.getNumPartitions() == 4


def test_running_values_move_rows_once(spark):
    """Without a join of rows with the sums of their buckets."""
    df = spark.createDataFrame([("a", i, i % 7, f"x{i}") for i in range(300)] + [(None, i, 1, None) for i in range(20)], "k string, o long, v long, other string")
    for how, want in (("sum", lambda x: sum(x)), ("max", lambda x: max(x, default=None)), ("last", lambda x: x[-1] if x else None)):
        found = ordered.running_before(df, ["k"], "o", "v", "_n", how)
        assert "Join" not in plan(found) and found.columns == [*df.columns, "_n"]
        rows = {(r["k"], r["o"]): (r["v"], r["_n"], r["other"]) for r in found.collect()}
        assert len(rows) == 320 and all(n == want([rows[k, i][0] for i in range(o)]) for (k, o), (_, n, _) in rows.items()) and rows["a", 5][2] == "x5"


def test_page_coverage_reads_words_from_a_written_table(spark, sf, small, monkeypatch):
    made = []
    monkeypatch.setattr(fixtures, "written", lambda df, kind: made.append(plan(df)) or catalogue.written(df, kind))
    assert "RegExpExtractAll" not in plan(fixtures.page_coverage(spark, sf)) and len(made) == 1
    assert made[0].count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in made[0]


def test_language_is_dealt(spark, sf, small):
    assert fixtures.language_parser(spark, sf).rdd.getNumPartitions() == 4


def test_vietnamese_is_looked_for_beyond_ascii(spark):
    from pyspark.sql import functions as F

    from vellumframe.functions.text import language_sql

    df = spark.createDataFrame([("tôi đang học tiếng Việt ở trường",), ("plain letters and nothing else here",)], "text string")
    assert [r[0] for r in df.select(F.expr(language_sql("text") + ".lang")).collect()] == ["vi", None]
    assert "rlike(text" not in language_sql("text")


def test_references_are_dealt_and_parsed_once(spark, sf, small):
    df = fixtures.reference_fields(spark, sf)
    assert df.rdd.getNumPartitions() == 4 and plan(df).count("ArrowEvalPython") == 1 and plan(df).split("ArrowEvalPython")[1].split("\n")[0].count("run(") == 1


def test_citations_of_documents_get_batches_of_a_bounded_size(spark, sf, small):
    df = fixtures.document_citations(spark, sf)
    assert "hashpartitioning(doc_id" in plan(df) and "REPARTITION_BY_NUM" in plan(df)


def test_citations_of_every_line_item_have_spans(spark, sf):
    """All rows, those alike too, and all forms: ranges, chapters, appendices and techniques, with where they stand."""
    df = fixtures.citations_spans(spark, sf)
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert df.columns == ["l_orderkey", "l_linenumber", "kind", "key", "start_at", "end_at"] and df.count() == n * 12
    kinds = {r["kind"]: r["n"] for r in df.groupBy("kind").agg({"*": "count"}).toDF("kind", "n").collect()}
    assert kinds == {"fig": 5 * n, "chapter": n, "table": n, "table-or-box": n, "app": n, "bibr": 2 * n, "bibr-paren": n}
