"""Queries that run the operators themselves over whole driver tables, put into the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumframe.functions import text as T
from vellumframe.operators import batch, layout, mining, pages, validate
from vellumframe.plans.catalogue import SQL_LINES, lines, query, table
from vellumframe.sources import markup


def _attrs(**columns) -> F.Column:
    return F.create_map(*[x for k, v in columns.items() for x in (F.lit(k.replace("_", "-")), v)])


def _pages_dom(spark, sf_dir) -> DataFrame:
    return markup.dom(table(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html")


_PLAIN = "regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g')"


@query(f"""
    WITH t AS (SELECT page_id, unnest(regexp_extract_all({_PLAIN}, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
    SELECT tag, count(*) AS n, count(DISTINCT page_id) AS docs FROM t GROUP BY tag
""")
def element_inventory(spark, sf_dir):
    """Elements of all pages, as the parser sees them; scripts and styles aside."""
    return mining.elements(_pages_dom(spark, sf_dir), "page_id").where("tag not in ('script', 'style')")


_IDS = "SELECT l_partkey % 1000 AS doc, CASE WHEN l_linenumber = 7 THEN concat('7-', l_suppkey) WHEN l_linenumber = 6 THEN concat('x', l_suppkey) ELSE concat('b-ch', printf('%03d', l_suppkey)) END AS id FROM lineitem"


@query(f"""
    WITH c AS (SELECT doc, id, count(*) AS n FROM ({_IDS}) GROUP BY 1, 2)
    SELECT doc, id, n, 'duplicate' AS defect FROM c WHERE n > 1
    UNION ALL SELECT doc, id, n, CASE WHEN NOT regexp_full_match(id, '[A-Za-z_][A-Za-z0-9._-]*') THEN 'invalid' ELSE 'pattern' END FROM c
    WHERE NOT regexp_full_match(id, 'b-[a-z]+[0-9]{{3,}}')
""")
def id_defects(spark, sf_dir):
    """Ids that repeat, aren't XML names or follow no pattern: line items stand for elements of documents."""
    rows = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_linenumber")
    own = F.when(F.col("l_linenumber") == 7, F.concat(F.lit("7-"), F.col("l_suppkey").cast("string"))).when(F.col("l_linenumber") == 6, F.concat(F.lit("x"), F.col("l_suppkey").cast("string"))).otherwise(F.concat(F.lit("b-ch"), F.format_string("%03d", "l_suppkey")))
    return validate.ids(rows.select((F.col("l_partkey") % 1000).alias("doc"), _attrs(id=own).alias("attrs")), "doc", "b")


_KIND = "CASE WHEN p_size <= 20 THEN 'fig' WHEN p_size <= 40 THEN 'table-wrap' ELSE 'sec' END"
_REF = "CASE l_linenumber % 3 WHEN 0 THEN 'fig' WHEN 1 THEN 'table' ELSE 'other' END"


@query(f"""
    WITH t AS (SELECT p_partkey, {_KIND} AS target FROM part WHERE p_size <= 45), l AS (SELECT {_REF} AS ref_type, l_partkey FROM lineitem)
    SELECT ref_type, coalesce(target, '-') AS target, CASE WHEN target IS NULL THEN 'broken' WHEN ref_type = 'fig' AND target <> 'fig' OR ref_type = 'table' AND target <> 'table-wrap' THEN 'wrong_type' ELSE 'valid' END AS status, count(*) AS n
    FROM l LEFT JOIN t ON l_partkey = p_partkey GROUP BY ALL
""")
def link_status(spark, sf_dir):
    """Links by whether their target is there and of the kind they name: line items refer to parts."""
    part, item = table(spark, sf_dir, "part", "p_partkey", "p_size").where("p_size <= 45"), table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey")
    kind = F.when(F.col("p_size") <= 20, "fig").when(F.col("p_size") <= 40, "table-wrap").otherwise("sec")
    made = part.select(F.lit(1).alias("doc"), F.col("p_partkey").cast("long").alias("pre"), kind.alias("tag"), _attrs(id=F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).alias("attrs"))
    third = F.col("l_linenumber") % 3
    refs = item.select(F.lit(1).alias("doc"), (F.lit(1 << 40) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("pre"), F.lit("xref").alias("tag"), _attrs(ref_type=F.when(third == 0, "fig").when(third == 1, "table").otherwise("other"), rid=F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("attrs"))
    return validate.links(made.union(refs), "doc").groupBy("ref_type", F.coalesce("target", F.lit("-")).alias("target"), "status").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH m AS (SELECT doc_id, n_chars, l.quality, l.toxic FROM documents LEFT JOIN labels l USING (doc_id)),
    g AS (SELECT doc_id, list_filter(['DTD invalid', 'content coverage', 'failed pages', 'errors'], lambda x: CASE x WHEN 'DTD invalid' THEN n_chars = 0 WHEN 'content coverage' THEN n_chars < 200 WHEN 'failed pages' THEN coalesce(quality = 0, false) ELSE coalesce(toxic = 1, false) END) AS critical, quality IS NULL AS unknown FROM m)
    SELECT doc_id, critical, CASE WHEN len(critical) > 0 THEN 'FAILED' WHEN unknown THEN 'PASS WITH WARNINGS' ELSE 'PASS' END AS status FROM g
""")
def verdicts(spark, sf_dir):
    """The gate's findings and verdict for each document: short texts lack coverage, low quality fails pages, toxic ones are errors."""
    marked = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").withColumnRenamed("doc_id", "_doc")
    rows = table(spark, sf_dir, "documents", "doc_id", "n_chars").join(marked, F.col("doc_id") == F.col("_doc"), "left")
    one = lambda condition: F.coalesce(condition, F.lit(False)).cast("int")
    none = {c: F.lit(0) for c in ("duplicate_ids", "invalid_ids", "broken_links", "wrong_links", "missing_images", "pattern_ids")}
    made = rows.withColumns(none | {"dtd_errors": one(F.col("n_chars") == 0), "coverage": F.when(F.col("n_chars") < 200, 0.5).otherwise(1.0), "failed_pages": one(F.col("quality") == 0), "errors": one(F.col("toxic") == 1), "warnings": one(F.col("quality").isNull())})
    return validate.gate(made).select("doc_id", "critical", "status")


@query("""
    WITH i AS (SELECT o_orderkey AS book, md5(concat(o_orderstatus, o_orderpriority)) AS input_hash FROM orders),
    s AS (SELECT o_orderkey AS book, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'FAILED' ELSE 'RUNNING' END AS status, md5(concat(o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 'changed' ELSE o_orderpriority END)) AS input_hash FROM orders)
    SELECT i.book, i.input_hash FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.book = i.book AND s.input_hash = i.input_hash AND s.status <> 'RUNNING')
""")
def batch_todo(spark, sf_dir):
    """Inputs whose latest record isn't finished with the same hash: dear orders changed since, open ones ran."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice").withColumn("book", F.col("o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "PASS").when(F.col("o_orderstatus") == "O", "FAILED").otherwise("RUNNING")
    last = rows.select("book", status.alias("status"), F.md5(F.concat("o_orderstatus", F.when(F.col("o_totalprice") > 200000, "changed").otherwise(F.col("o_orderpriority")))).alias("input_hash"), F.lit(2).alias("version"))
    older = rows.select("book", F.lit("PASS").alias("status"), F.md5(F.concat("o_orderstatus", "o_orderpriority")).alias("input_hash"), F.lit(1).alias("version"))
    return batch.pending(rows.select("book", F.md5(F.concat("o_orderstatus", "o_orderpriority")).alias("input_hash")), last.union(older))


@query("""
    WITH s AS (SELECT l_suppkey AS book, lower(l_returnflag) AS family, l_linenumber / 2 AS size, l_linenumber AS w, l_orderkey * 8 + l_linenumber AS pos FROM lineitem WHERE l_linestatus = 'O'),
    c AS (SELECT book, family, size, sum(w) AS n, min(pos) AS first FROM s GROUP BY 1, 2, 3)
    SELECT book AS book_id, family AS body_family, size AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n DESC, first) AS r FROM c) WHERE r = 1
""")
def body_styles(spark, sf_dir):
    """The style of most characters in each book: a supplier's line items stand for spans, the return flag for the font."""
    rows = table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    spans = rows.select(
        F.col("l_suppkey").alias("book_id"), F.col("l_orderkey").alias("page"), F.lit(0).alias("line_no"), F.col("l_linenumber").alias("span_no"), F.col("l_returnflag").alias("font"), (F.col("l_linenumber") / 2).alias("size"),
        F.when(F.col("l_linestatus") == "O", "body").otherwise("header").alias("role"), F.lit(False).alias("sup"), F.lit(False).alias("sub"), F.repeat(F.lit("x"), F.col("l_linenumber").cast("int")).alias("text"),
    )
    return layout.body_style(spans)


@query("""
    WITH c AS (SELECT user_id, CASE event_type WHEN 'click' THEN 90 WHEN 'view' THEN 0 ELSE -90 END AS r, sum(length(event_type)) AS n FROM events GROUP BY 1, 2),
    b AS (SELECT user_id, arg_max(r, n * 1000 - r) AS r, max(n) AS most, sum(n) AS total FROM c GROUP BY 1)
    SELECT user_id, CASE WHEN most * 2 >= total THEN r ELSE 0 END AS rotation FROM b
""")
def text_rotation(spark, sf_dir):
    """The direction of most of a page's characters: a user's events stand for spans."""
    way = F.when(F.col("event_type") == "click", 90).when(F.col("event_type") == "view", 0).otherwise(-90)
    return pages.dominant_rotation(table(spark, sf_dir, "events", "user_id", "event_type").withColumn("way", way), ["user_id"], "way", "event_type")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 90 WHEN 1 THEN -90 ELSE 0 END AS turn, CASE p_size % 3 WHEN 0 THEN 792.0 - (p_size + 9) WHEN 1 THEN CAST(p_size AS DOUBLE) ELSE CAST(p_partkey % 500 AS DOUBLE) END AS x0, true AS back, p_partkey % 500 + 10 BETWEEN 2 AND 496 AND p_size + 4.5 BETWEEN 8 AND 702 AS clipped FROM part")
def turned_boxes(spark, sf_dir):
    """Boxes turned upright and back again, and whether their centre lies in the trim."""
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size")
    d = lambda c: c.cast("double")
    own = pages.box(d(F.col("p_partkey") % 500), d(F.col("p_size")), d(F.col("p_partkey") % 500 + 20), d(F.col("p_size") + 9))
    turn = F.when(F.col("p_size") % 3 == 0, 90).when(F.col("p_size") % 3 == 1, -90).otherwise(0)
    clip = pages.box(F.lit(4.0), F.lit(10.0), F.lit(494.0), F.lit(700.0))
    rows = rows.select("p_partkey", turn.alias("turn"), own.alias("b")).withColumn("u", pages.upright(F.col("b"), F.col("turn"), F.lit(612.0), F.lit(792.0)))
    return rows.select("p_partkey", "turn", F.col("u.x0").alias("x0"), (pages.turned_back(F.col("u"), F.col("turn"), F.lit(612.0), F.lit(792.0)) == F.col("b")).alias("back"), pages.inside(F.col("b"), clip).alias("clipped"))


@query("""
    WITH t AS (SELECT o_custkey AS book, o_orderkey // 64 AS folio, min(o_orderkey) AS at FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
    l AS (SELECT o_custkey AS book, o_orderkey // 64 AS folio, min(o_orderkey) AS at FROM orders GROUP BY 1, 2)
    SELECT book, folio, coalesce(t.at, l.at) AS at, t.at IS NULL AS placed FROM l LEFT JOIN t USING (book, folio)
""")
def page_marks(spark, sf_dir):
    """The first mark of each printed page, and pages without a mark, which get one at their first line."""
    rows = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus").select(F.col("o_custkey").alias("book"), F.floor(F.col("o_orderkey") / 64).alias("folio"), F.col("o_orderkey").alias("at"), "o_orderstatus")
    return pages.marks(rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), rows.drop("o_orderstatus"))


@query("""
    WITH p AS (SELECT conv_id, turn, text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS page FROM conversations),
    w AS (SELECT conv_id, page, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM p)
    SELECT conv_id, page AS target, word, count(*) AS n FROM w GROUP BY 1, 2, 3
""")
def page_texts(spark, sf_dir):
    """The words between one page target and the next: a user's turn stands for a target."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(F.col("role") == "user", F.col("turn")).alias("target"), "text")
    return pages.page_bags(rows, ["conv_id"], "turn", "target", "text")


@query(f"""
    WITH l AS (SELECT doc_id, line_no, list_distinct(regexp_extract_all(lower(line), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM ({SQL_LINES})),
    b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM benchmark),
    e AS (SELECT doc_id, line_no, unnest(w) AS word FROM l),
    h AS (SELECT doc_id, line_no, count(*) AS hit FROM e JOIN b USING (word) GROUP BY 1, 2),
    s AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN coalesce(hit, 0) / len(w) ELSE 1 END AS share FROM l LEFT JOIN h USING (doc_id, line_no))
    SELECT doc_id, CASE WHEN share >= 0.9 THEN 'matched' WHEN share >= 0.4 THEN 'changed' ELSE 'missing' END AS state, count(*) AS n FROM s GROUP BY 1, 2
""")
def line_states(spark, sf_dir):
    """Lines of documents against the words of the benchmark: matched, changed or missing."""
    own = lines(spark, sf_dir).select("doc_id", "line_no", F.lit(1).alias("text_id"), "line")
    words = table(spark, sf_dir, "benchmark", "text").select(F.lit(1).alias("text_id"), F.explode(T.words(F.col("text"))).alias("word"))
    return pages.line_states(own, words, ["text_id"], "line").groupBy("doc_id", "state").agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH k AS (SELECT DISTINCT doc_id AS k FROM labels), p AS (SELECT DISTINCT page_id AS k FROM pages)
    SELECT coalesce(k.k, p.k) AS key, CASE WHEN p.k IS NULL THEN 'left_only' WHEN k.k IS NULL THEN 'right_only' ELSE 'matched' END AS status FROM k FULL JOIN p ON k.k = p.k
""")
def inventory_pairing(spark, sf_dir):
    """Two inventories by key: labelled documents and pages."""
    from vellumframe.operators import links

    return links.pairing(table(spark, sf_dir, "labels", "doc_id"), table(spark, sf_dir, "pages", "page_id"), "doc_id", "page_id")
