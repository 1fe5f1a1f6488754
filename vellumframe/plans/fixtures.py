"""Queries of operators that the driver tables have no text for: texts are made of the tables' numbers and names, or literals stand
beside all documents. Their SQL says the rule again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumframe.functions import parsers as P
from vellumframe.functions import text as T
from vellumframe.operators import layout, lists, references, validate, words, zones
from vellumframe.plans.catalogue import _SQL_BAGS, _SQL_LANG, SQL_LINES, _benchmark_words, lines, query, table, texts
from vellumframe.shared import SHORT_TEXTS, dealt, written


def literals(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def values(rows: list[tuple], columns: str) -> str:
    """SQL of a literal table."""
    say = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) t({columns})"


#: What stands before a citation, the citation, its kind and its key, in SQL of a line item's numbers. What stands before the last is
#: a form that is none.
_CITES = [
    ("'see '", "concat('Figs. ', s, '-', n)", "fig", "concat(s, '-', n)"),
    ("', '", "concat(s, '-', n + 2)", "fig", "concat(s, '-', n + 2)"),
    ("' and '", "concat(s, '-', n + 5)", "fig", "concat(s, '-', n + 5)"),
    ("'; '", "concat('Figuras ', s, '-', n, ' a ', s, '-', n + 3)", "fig", "concat(s, '-', n)"),
    ("'; '", "concat('Chapters ', n, '-', n + 2)", "chapter", "concat(n, '-', n + 2)"),
    ("'; '", "concat('tabla ', p)", "table", "concat(p, '')"),
    ("' y '", "concat('cuadro ', n)", "table-or-box", "concat(n, '')"),
    ("'; '", "concat('Appendix ', substr('ABCDEFG', n, 1))", "app", "substr('ABCDEFG', n, 1)"),
    ("'; known ['", "concat(n, '')", "bibr", "concat(n, '')"),
    ("', '", "'9'", "bibr", "'9'"),
    ("'] or ('", "'4'", "bibr-paren", "'4'"),
    ("') not f(5); '", "concat('fig. técnica 1.', s, '.', n)", "fig", "concat('T1-', s, '-', n)"),
]
_CITED = f"concat({', '.join(f'{before}, {said}' for before, said, _, _ in _CITES)}, '.')"
_CITE_PARTS = ", ".join(f"{{'before': {before}, 'said': {said}, 'kind': '{kind}', 'key': {key}}}" for before, said, kind, key in _CITES)


@query(f"""
    WITH t AS (SELECT l_orderkey, l_linenumber, l_suppkey % 30 AS s, l_linenumber AS n, l_partkey % 50 AS p FROM lineitem),
    c AS (SELECT l_orderkey, l_linenumber, [{_CITE_PARTS}] AS parts FROM t),
    b AS (SELECT l_orderkey, l_linenumber, parts[i] AS part, coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x.before) + length(x.said))), 0) + length(parts[i].before) AS start_at FROM c, range(1, {len(_CITES) + 1}) r(i))
    SELECT l_orderkey, l_linenumber, part.kind AS kind, part.key AS key, CAST(start_at AS INT) AS start_at, CAST(start_at + length(part.said) AS INT) AS end_at FROM b
""")
def citations_spans(spark, sf_dir):
    """Citations of all forms, and where they stand, in a sentence for each line item. Sentences that are alike are parsed once."""
    item = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    made = item.selectExpr("l_orderkey", "l_linenumber", "l_suppkey % 30 AS s", "l_linenumber AS n", "l_partkey % 50 AS p").select("l_orderkey", "l_linenumber", F.expr(_CITED).alias("text"))
    said = made.select(F.col("text").alias("_text")).distinct()
    found = written(said.select("_text", P.citation_column(F.col("_text")).alias("_cites")), "citations")
    rows = made.join(found, F.col("text") == F.col("_text")).select("l_orderkey", "l_linenumber", F.explode("_cites").alias("c"))
    return rows.select("l_orderkey", "l_linenumber", "c.kind", "c.key", F.col("c.start").alias("start_at"), F.col("c.end").alias("end_at"))


@query("""
    WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\\p{L}\\p{N}_(])\\(([0-9]{1,3})\\)', 1)) AS key FROM documents)
    SELECT doc_id, 'bibr-paren' AS kind, key, count(*) AS n FROM m GROUP BY 1, 3
""")
def document_citations(spark, sf_dir):
    """Citations in all documents: this prose has numbers in parentheses, and no other form."""
    found = texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(P.citation_column(F.col("text"))).alias("c"))
    return found.groupBy("doc_id", F.col("c.kind").alias("kind"), F.col("c.key").alias("key")).agg(F.count(F.lit(1)).alias("n"))


_REF = "concat('Hanks SK, Hunter T. The ', p_name, '. FASEB J. ', 1900 + p_size, ';', p_partkey % 90 + 1, '(', p_size, '):', p_partkey % 500 + 100, '-', p_partkey % 500 + 120, '.')"


@query("""
    SELECT p_partkey, 'journal' AS type, unnest([{'kind': 'article-title', 'part': concat('The ', p_name)}, {'kind': 'source', 'part': 'FASEB J'}, {'kind': 'year', 'part': CAST(1900 + p_size AS VARCHAR)}, {'kind': 'volume', 'part': CAST(p_partkey % 90 + 1 AS VARCHAR)},
        {'kind': 'issue', 'part': CAST(p_size AS VARCHAR)}, {'kind': 'fpage', 'part': CAST(p_partkey % 500 + 100 AS VARCHAR)}, {'kind': 'lpage', 'part': CAST(p_partkey % 500 + 120 AS VARCHAR)}], recursive := true) FROM part
""")
def reference_fields(spark, sf_dir):
    """Typed parts of references made of parts' names and numbers; names of persons and plain text are left out here."""
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    made = dealt(parts, parts.count(), "p_partkey", each=SHORT_TEXTS).select("p_partkey", F.expr(_REF).alias("text"))
    rows = made.select("p_partkey", F.explode(P.reference_typed(F.col("text"))).alias("s"))
    return rows.where("s.kind not in ('text', 'surname', 'given-names')").select("p_partkey", "s.type", F.col("s.kind").alias("kind"), F.col("s.text").alias("part"))


@query(f"SELECT doc_id, line_no, CASE WHEN regexp_matches(line, '^\\s*({layout.LABELS['fig']})\\s*({layout.NUMBER})') THEN 'fig' WHEN regexp_matches(line, '^\\s*({layout.LABELS['table']})\\s*({layout.NUMBER})') THEN 'table' ELSE 'box' END AS kind FROM (SELECT doc_id, line_no, line FROM ({SQL_LINES}) UNION ALL {values([(-1, 0, 'Figure 3.7 A heart'), (-1, 1, 'TABLA 2 Datos'), (-1, 2, 'Cuadro 1-1'), (-1, 3, 'Figures are fun')], 'doc_id, line_no, line')}) WHERE regexp_matches(line, '^\\s*(({layout.LABELS['fig']})|({layout.LABELS['table']})|({layout.LABELS['box']}))\\s*({layout.NUMBER})')")
def caption_labels(spark, sf_dir):
    """Labels of captions at the start of lines."""
    fixed = spark.createDataFrame([(-1, 0, "Figure 3.7 A heart"), (-1, 1, "TABLA 2 Datos"), (-1, 2, "Cuadro 1-1"), (-1, 3, "Figures are fun")], "doc_id long, line_no int, line string")
    rows = fixed.union(lines(spark, sf_dir).select("doc_id", "line_no", "line")).withColumn("l", layout.label(F.col("line")))
    return rows.where("l is not null").select("doc_id", "line_no", F.col("l.kind").alias("kind"))


@query("SELECT p_partkey, p_partkey % 3999 + 1 AS value FROM part")
def roman_round_trip(spark, sf_dir):
    """Numerals made and read again."""
    rows = table(spark, sf_dir, "part", "p_partkey").select("p_partkey", T.to_roman(F.col("p_partkey") % 3999 + 1).alias("r"))
    return rows.select("p_partkey", T.roman_value(F.col("r")).cast("long").alias("value"))


_NUMBER = "concat(l_suppkey % 30, CASE l_linenumber % 3 WHEN 0 THEN '.' WHEN 1 THEN '–' ELSE ' -' END, l_partkey % 40, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'a' ELSE '' END)"


@query(f"SELECT DISTINCT {_NUMBER} AS text, concat(l_suppkey % 30, '-', l_partkey % 40) AS key FROM lineitem")
def number_keys(spark, sf_dir):
    """One form for the numbers of labels."""
    rows = table(spark, sf_dir, "lineitem", "l_suppkey", "l_linenumber", "l_partkey", "l_returnflag").select(F.expr(_NUMBER).alias("text")).distinct()
    return rows.select("text", T.number_key(F.col("text")).alias("key"))


_RANGE = "CASE o_orderkey % 3 WHEN 0 THEN concat(o_custkey % 900 + 100, '–', o_orderkey % 90 + 10, 'f') WHEN 1 THEN concat(o_custkey % 900 + 100, 'b') ELSE 'xii' END"


@query(f"""
    WITH t AS (SELECT DISTINCT {_RANGE} AS text, o_orderkey % 3 AS kind, CASE WHEN o_orderkey % 3 < 2 THEN o_custkey % 900 + 100 END AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 90 + 10 END AS b FROM orders)
    SELECT text, CAST(a AS VARCHAR) AS num, 'start-of-range' AS type FROM t WHERE kind = 0 UNION ALL SELECT text, CAST(a // 100 * 100 + b AS VARCHAR), 'end-of-range' FROM t WHERE kind = 0
    UNION ALL SELECT text, CASE kind WHEN 1 THEN CAST(a AS VARCHAR) ELSE 'xii' END, NULL FROM t WHERE kind > 0
""")
def index_pages(spark, sf_dir):
    """Page references of an index, ranges written out: customers' numbers stand for pages."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.expr(_RANGE).alias("text")).distinct()
    return rows.select("text", F.explode(T.page_tokens(F.col("text"))).alias("t")).select("text", "t.num", "t.type")


@query(f"WITH {_SQL_LANG} SELECT doc_id, CASE WHEN hits >= 3 AND n >= 20 THEN lang END AS lang FROM b")
def language_parser(spark, sf_dir):
    """Language by script and stop words."""
    return texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.expr(T.language_sql("text") + ".lang").alias("lang"))


@query(f"""
    WITH {_SQL_BAGS},
    c AS (SELECT doc_id, n, coalesce(m, 0) AS m, coalesce(sum(n) OVER (PARTITION BY word ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM d LEFT JOIN b USING (word))
    SELECT doc_id AS page, CAST(sum(n) AS BIGINT) AS words, CAST(sum(greatest(0, least(n, m - used))) AS BIGINT) AS matched FROM c GROUP BY doc_id
""")
def page_coverage(spark, sf_dir):
    """Coverage of pages' lines by another text's words; hyphenated line ends are carried (these documents have none)."""
    docs = texts(spark, sf_dir, "doc_id", "text")
    pages = docs.select(F.col("doc_id").alias("page"), F.lit("body").alias("role"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    found = written(validate.page_words(pages), "words")
    return validate.coverage(found, _benchmark_words(spark, sf_dir)).select("page", "words", "matched")


@query("""
    WITH p AS MATERIALIZED (SELECT DISTINCT word AS w, substr(word, 1, length(word) // 2) AS a, substr(word, length(word) // 2 + 1) AS b FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) WHERE length(word) >= 4),
    k AS MATERIALIZED (SELECT w AS word FROM p UNION SELECT a FROM p UNION SELECT b FROM p),
    w AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents) JOIN k USING (word) GROUP BY 1),
    x AS (SELECT k.word, coalesce(w.n, 0) AS n FROM k LEFT JOIN w USING (word))
    SELECT p.w AS word, CASE WHEN j.n > 0 THEN true ELSE NOT (length(a) >= 3 AND length(b) >= 3 AND l.n >= 2 AND r.n >= 2) END AS joined
    FROM p JOIN x j ON j.word = p.w JOIN x l ON l.word = p.a JOIN x r ON r.word = p.b
""")
def hyphen_joins(spark, sf_dir):
    """Words of the benchmark broken in the middle: joined again by the documents' own lexicon. Compounds are apart from this."""
    docs = table(spark, sf_dir, "documents", "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("text"))
    broken = table(spark, sf_dir, "benchmark", "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).where(F.length("word") >= 4).distinct()
    half = F.floor(F.length("word") / 2).cast("int")
    pairs = broken.select("word", F.substr("word", F.lit(1), half).alias("left"), F.substr("word", half + 1).alias("right"))
    return words.joins(pairs, words.lexicon(docs)).select("word", "joined")


@query("""
    WITH s AS (SELECT o_custkey AS book, o_orderkey AS ord, o_orderkey % 6 + 1 AS level FROM orders)
    SELECT ord, (SELECT max(p.ord) FROM s p WHERE p.book = s.book AND p.ord < s.ord AND p.level < s.level) AS parent FROM s
""")
def section_nesting(spark, sf_dir):
    """The section around each section: the last earlier one of a smaller level."""
    rows = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("book"), F.col("o_orderkey").alias("zid"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 6 + 1).alias("level"))
    return zones.renest(rows).select("ord", "parent")


@query("""
    WITH t AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'table' ELSE 'box' END AS kind, concat('c', p_size % 7) AS scope, CAST(p_partkey % 300 AS VARCHAR) AS key, concat('T', p_partkey) AS target, p_partkey AS pos FROM part),
    e AS (SELECT kind, scope, key, arg_min(target, pos) AS target FROM t GROUP BY ALL), o AS (SELECT kind, key, min(target) AS target FROM t GROUP BY ALL HAVING count(*) = 1),
    c AS (SELECT o_orderkey AS cite_id, concat('c', o_custkey % 9) AS scope, CAST(o_custkey % 400 AS VARCHAR) AS key FROM orders)
    SELECT cite_id, coalesce(a.target, b.target, x.target, y.target) AS rid, CASE WHEN coalesce(a.target, b.target) IS NOT NULL THEN 'table' WHEN coalesce(x.target, y.target) IS NOT NULL THEN 'box' END AS target_kind FROM c
    LEFT JOIN e a ON a.kind = 'table' AND a.scope = c.scope AND a.key = c.key LEFT JOIN o b ON b.kind = 'table' AND b.key = c.key
    LEFT JOIN e x ON x.kind = 'box' AND x.scope = c.scope AND x.key = c.key LEFT JOIN o y ON y.kind = 'box' AND y.key = c.key
""")
def cite_resolution(spark, sf_dir):
    """Citations of tables or boxes, resolved in their scope, else by a target that is alone, tables first: orders cite parts."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_size")
    targets = part.select(F.when(F.col("p_size") % 2 == 0, "table").otherwise("box").alias("kind"), F.concat(F.lit("c"), F.col("p_size") % 7).alias("scope"), (F.col("p_partkey") % 300).cast("string").alias("key"), F.concat(F.lit("T"), F.col("p_partkey")).alias("target"), F.col("p_partkey").alias("pos"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    cites = orders.select(F.col("o_orderkey").alias("cite_id"), F.lit("table-or-box").alias("kind"), F.concat(F.lit("c"), F.col("o_custkey") % 9).alias("scope"), (F.col("o_custkey") % 400).cast("string").alias("key"))
    return references.resolve(cites, targets).select("cite_id", "rid", "target_kind")


_TOC = "CASE p_partkey * 7 % 11 WHEN 0 THEN concat('Chapter ', p_partkey, ' ', p_name, ' .... ', p_partkey % 900 + 1) WHEN 1 THEN 'Ana Ruiz y Luis Mora' WHEN 2 THEN 'SECTION OF PARTS' WHEN 3 THEN concat(p_name, ' ', p_partkey % 900 + 1) WHEN 4 THEN concat(p_name, ' ', p_partkey % 900 + 1) ELSE p_name END"


@query(f"""
    WITH l AS (SELECT p_size AS book, p_partkey AS ord, 50 + p_partkey % 3 * 20 AS x, p_name, {_TOC} AS text, p_partkey * 7 % 11 AS k, CASE WHEN p_partkey * 7 % 11 IN (0, 3, 4) THEN 1 ELSE 0 END AS ends FROM part),
    r AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY book ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM l),
    g AS (SELECT *, row_number() OVER w - 1 AS i, max(ends) OVER w2 AS closed, count(*) FILTER (ends = 0) OVER w2 AS n FROM r WINDOW w AS (PARTITION BY book, run ORDER BY ord), w2 AS (PARTITION BY book, run)),
    f AS (SELECT *, CASE WHEN n > 4 THEN (n - 1) // 4 * 4 ELSE 0 END AS full_ FROM g),
    a AS (SELECT *, CASE WHEN closed = 1 AND full_ = 0 AND run > 0 THEN coalesce(min(i) FILTER (k <> 1 AND ends = 0) OVER (PARTITION BY book, run), n) ELSE 0 END AS names FROM f),
    s AS (SELECT *, max(CASE WHEN i = full_ + names AND closed = 1 AND k = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY book, run) AS section FROM a),
    c AS (SELECT *, CASE WHEN i < full_ THEN i // 4 WHEN i < full_ + names THEN -1 WHEN section = 1 AND i = full_ + names THEN 1000 WHEN closed = 1 THEN 2000 ELSE 3000 + i END AS part FROM s),
    e AS (SELECT book, run, part, min(ord) AS ord, arg_min(x, ord) AS x, max(ends) AS paged, arg_max(k, ord) AS k, arg_max(ord, ord) AS key, arg_max(p_name, ord) AS last_name, string_agg(text, ' ' ORDER BY ord) AS text,
                 coalesce(string_agg(text, ' ' ORDER BY ord) FILTER (ends = 0), '') AS first FROM c WHERE part >= 0 GROUP BY ALL),
    m AS (SELECT book, run - 1 AS run, string_agg(text, ' ' ORDER BY ord) AS authors FROM c WHERE part = -1 GROUP BY ALL)
    SELECT e.book, e.ord, CASE WHEN paged = 1 AND starts_with(first, 'SECTION OF ') THEN 'SECTION OF' WHEN paged = 1 AND k = 0 AND first = '' THEN concat('Chapter ', key) END AS label,
           concat_ws(' ', CASE WHEN paged = 0 THEN text WHEN k = 0 AND first = '' THEN last_name ELSE trim(concat(CASE WHEN starts_with(first, 'SECTION OF ') THEN substr(first, 12) ELSE first END, ' ', CASE WHEN k = 0 THEN concat('Chapter ', key, ' ', last_name) ELSE last_name END)) END, CASE WHEN paged = 1 THEN m.authors END) AS title,
           CASE WHEN paged = 1 THEN CAST(key % 900 + 1 AS VARCHAR) END AS page, CAST(dense_rank() OVER (PARTITION BY e.book ORDER BY x) - 1 AS INTEGER) AS level
    FROM e LEFT JOIN m ON e.book = m.book AND e.run = m.run
""")
def toc_parse(spark, sf_dir):
    """Entries of contents lists: the parts of one size stand for a list, some with a page, some names, some heads."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    rows = part.select(F.col("p_size").alias("book"), F.col("p_partkey").alias("ord"), (50 + F.col("p_partkey") % 3 * 20).alias("x0"), F.expr(_TOC).alias("text"))
    return lists.contents(rows, ["book"])


_INDEX = "SELECT p_size % 5 AS book, p_partkey AS ord, CAST(50 + CASE p_partkey * 5 % 7 WHEN 3 THEN 12 WHEN 4 THEN 12 WHEN 5 THEN 24 WHEN 6 THEN 36 ELSE 0 END AS DOUBLE) AS x0, CASE p_partkey % 6 WHEN 0 THEN 300.0 ELSE 100.0 END AS x1, concat(p_name, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN concat(', ', p_partkey % 900 + 1, ',') ELSE concat(', ', p_partkey % 900 + 1, '-', p_partkey % 900 + 3) END) AS text FROM part"


@query(f"""
    WITH RECURSIVE a AS (SELECT *, round_even(x0 / 60, 0) AS col, row_number() OVER (PARTITION BY book ORDER BY ord) AS n FROM ({_INDEX})),
    c AS (SELECT book, col, min(x0) AS lft, list_sort(list(x1)) AS ends FROM a GROUP BY 1, 2),
    b AS (SELECT a.*, x0 - lft AS indent, x1 >= ends[1 + CAST(floor(0.9 * (len(ends) - 1)) AS INT)] - 15 AS wide FROM a JOIN c ON a.book = c.book AND a.col = c.col),
    d AS (SELECT book, min(d) AS d FROM (SELECT book, round_even(indent, 0) AS d FROM b WHERE indent > 1 GROUP BY 1, 2 HAVING count(*) >= 3) GROUP BY 1),
    l AS (SELECT b.book, ord, n, text, wide, text LIKE '%,' AS open_, CAST(greatest(0, round_even(indent / greatest(coalesce(d, 10), 6), 0)) AS INTEGER) AS lvl FROM b LEFT JOIN d ON b.book = d.book),
    s(book, n, head, lvl, final, raw, wide, open_) AS (
        SELECT book, n, ord, lvl, 0, text, wide, open_ FROM l WHERE n = 1
        UNION ALL
        SELECT l.book, l.n, CASE WHEN on_ THEN s.head ELSE l.ord END, CASE WHEN on_ THEN s.lvl ELSE l.lvl END, CASE WHEN on_ THEN s.final ELSE least(l.lvl, s.final + 1) END, CASE WHEN on_ THEN concat(s.raw, ' ', l.text) ELSE l.text END, l.wide, l.open_
        FROM (SELECT *, open_ AS o_ FROM s) s JOIN l ON l.book = s.book AND l.n = s.n + 1,
             LATERAL (SELECT s.open_ OR (s.wide AND l.lvl > s.lvl AND regexp_matches(s.raw, '{lists.REFS}')) OR l.lvl > s.lvl + 1 AS on_)),
    e AS (SELECT book, head AS ord, arg_max(final, n) AS level, arg_max(raw, n) AS raw FROM s GROUP BY 1, 2)
    SELECT book, ord, level, CASE WHEN regexp_matches(raw, '{lists.REFS}') THEN regexp_replace(regexp_extract(raw, '{lists.REFS}', 1), '[ ,]+$', '') ELSE raw END AS term, coalesce(nullif(replace(regexp_extract(raw, '{lists.REFS}', 2), ' ', ''), ''), '') AS refs FROM e
""")
def index_entries(spark, sf_dir):
    """Entries of indexes with their levels and pages: parts stand for lines, some of which go on with the one before."""
    part = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_size")
    seventh, fourth, page = F.col("p_partkey") * 5 % 7, F.col("p_partkey") % 4, F.col("p_partkey") % 900 + 1
    x0 = (50 + F.when(seventh.isin(3, 4), 12).when(seventh == 5, 24).when(seventh == 6, 36).otherwise(0)).cast("double")
    tail = F.when(fourth == 0, "").when(fourth == 1, F.concat(F.lit(", "), page, F.lit(","))).otherwise(F.concat(F.lit(", "), page, F.lit("-"), page + 2))
    rows = part.select((F.col("p_size") % 5).alias("book"), F.col("p_partkey").alias("ord"), F.lit(0).alias("page"), x0.alias("x0"), F.when(F.col("p_partkey") % 6 == 0, 300.0).otherwise(100.0).alias("x1"), F.concat("p_name", tail).alias("text"))
    return lists.index(rows, ["book"], 10.0).select("book", "ord", "level", "term", F.array_join("refs", ",").alias("refs"))


_CITES = "SELECT o_custkey % 100 AS book, o_orderkey AS ord, o_orderkey // 40 AS page, 50 + o_custkey % 4 * 5 AS x0, CAST(o_orderkey % 40 * 10 + CASE WHEN o_orderstatus = 'P' THEN 6 ELSE 0 END AS DOUBLE) AS y0, CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN o_custkey % 100 < 50 THEN concat(o_orderkey % 90, '. Smith J.') ELSE 'A title.' END WHEN 1 THEN 'Jones K. A work' WHEN 2 THEN 'goes on (so)' ELSE 'and on' END AS text FROM orders"


@query(f"""
    WITH l AS (SELECT *, y0 + 9 AS y1, regexp_matches(text, '^[0-9]+[.] ') AS num, min(x0) OVER (PARTITION BY book, page, round_even(x0 / 80.0, 0)) AS lft FROM ({_CITES})),
    m AS (SELECT *, sum(CAST(num AS INT)) OVER b >= greatest(2, 0.3 * count(*) OVER b / 2.5) AS by_number, lag(text) OVER w AS pt, lag(page) OVER w AS pp, lag(y1) OVER w AS py FROM l WINDOW b AS (PARTITION BY book), w AS (PARTITION BY book ORDER BY ord)),
    n AS (SELECT book, ord, CASE WHEN pt IS NULL THEN 1 WHEN by_number THEN CAST(num AS INT) WHEN x0 <= lft + 1 AND regexp_matches(pt, '[.)]$') OR starts_with(text, 'Jones K.') OR (pp = page AND py <= y0 AND y0 - py > 5) THEN 1 ELSE 0 END AS new FROM m)
    SELECT book, ord, CAST(sum(new) OVER (PARTITION BY book ORDER BY ord) - 1 AS BIGINT) AS entry FROM n
""")
def reference_entries(spark, sf_dir):
    """References of a list: customers' orders stand for its lines, half of the lists are numbered."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    number = F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(". Smith J."))
    fifth = F.col("o_orderkey") % 5
    text = F.when(fifth == 0, F.when(F.col("o_custkey") % 100 < 50, number).otherwise("A title.")).when(fifth == 1, "Jones K. A work").when(fifth == 2, "goes on (so)").otherwise("and on")
    y0 = (F.col("o_orderkey") % 40 * 10 + F.when(F.col("o_orderstatus") == "P", 6).otherwise(0)).cast("double")
    rows = orders.select((F.col("o_custkey") % 100).alias("book"), F.col("o_orderkey").alias("ord"), F.floor(F.col("o_orderkey") / 40).alias("page"), (50 + F.col("o_custkey") % 4 * 5).cast("double").alias("x0"), y0.alias("y0"), F.lit(300.0).alias("x1"), (y0 + 9).alias("y1"), text.alias("text"))
    return lists.references(rows, ["book"], 10.0).select("book", "ord", "entry")


@query("""
    SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2
""")
def event_windows(spark, sf_dir):
    """Events of each type in each hour: the batch form of the windowed stream."""
    from vellumframe.streaming import ingest

    rows = table(spark, sf_dir, "events", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = ingest.windowed_counts(rows, length="1 hour")
    return counted.select((F.unix_seconds("window.start") / 3600).cast("long").alias("hour"), "event_type", "n")
