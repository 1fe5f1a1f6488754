"""Queries of layout operators: driver tables stand for spans, lines, rules and marked-up documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellumframe.operators import align, pages, tables, tree, zones
from vellumframe.operators import lines as building
from vellumframe.plans.catalogue import SQL_LINES, lines, query, table
from vellumframe.shared import dealt

_SPANS = """SELECT l_orderkey // 4 AS page, l_orderkey % 4 * 8 + l_linenumber AS frag, CAST(l_partkey % 40 * 5 AS DOUBLE) AS x0, 12.0 * (1 + l_suppkey % 6) + l_linenumber % 4 * 0.5 - size AS y0,
    CAST(l_partkey % 40 * 5 + 5 + l_suppkey % 30 AS DOUBLE) AS x1, 12.0 * (1 + l_suppkey % 6) + l_linenumber % 4 * 0.5 AS y1, size, CASE l_linenumber % 3 WHEN 0 THEN '1.' WHEN 1 THEN 'word ' ELSE l_returnflag END AS text
    FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_returnflag) AS l_returnflag, CAST(6 + max(l_quantity) % 3 * 3 AS DOUBLE) AS size FROM lineitem GROUP BY 1, 2)"""
_BESIDE = """least(g.y1, f.y1) - greatest(g.y0, f.y0) >= 0.45 * least(g.y1 - g.y0, f.y1 - f.y0) AND least(g.x1, f.x1) - greatest(g.x0, f.x0) <= 0.6 * greatest(g.size, f.size)
    AND greatest(g.x0, f.x0) - least(g.x1, f.x1) < CASE WHEN regexp_full_match(CASE WHEN g.x0 <= f.x0 THEN g.text ELSE f.text END, '\\s*(\\(?[0-9]{1,3}[.)]|\\(?[A-Za-z][.)]|\\(?[ivxIVX]{1,4}[.)])\\s*') AND abs(g.y1 - f.y1) < 0.6 * greatest(g.size, f.size) THEN 3.5 ELSE 0.9 END * greatest(g.size, f.size)"""


@query(f"""
    WITH RECURSIVE f AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round_even(y1, 0), x0, frag) AS n FROM ({_SPANS})),
    s(page, n, groups) AS (
        SELECT DISTINCT page, CAST(0 AS BIGINT), CAST([] AS STRUCT(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, size DOUBLE, text VARCHAR, first BIGINT, count BIGINT)[]) FROM f
        UNION ALL
        SELECT page, n, CASE WHEN hit IS NULL THEN list_append(groups, f) ELSE list_transform(groups, lambda g, i: CASE WHEN i = hit THEN
            {{'x0': least(g.x0, f.x0), 'y0': least(g.y0, f.y0), 'x1': greatest(g.x1, f.x1), 'y1': greatest(g.y1, f.y1), 'size': greatest(g.size, f.size), 'text': g.text || f.text, 'first': least(g.first, f.first), 'count': g.count + 1}} ELSE g END) END
        FROM (SELECT page, n, groups, f, list_min(list_transform(groups, lambda g, i: CASE WHEN i > len(groups) - 6 AND {_BESIDE} THEN i END)) AS hit
              FROM (SELECT s.page, f.n, s.groups, {{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'size': size, 'text': text, 'first': CAST(frag AS BIGINT), 'count': CAST(1 AS BIGINT)}} AS f FROM s JOIN f ON f.page = s.page AND f.n = s.n + 1)))
    SELECT page, g.first AS first_frag, g.x0 AS x0, g.y0 AS y0, g.x1 AS x1, g.y1 AS y1, CAST(g.count AS INTEGER) AS n_frags FROM (SELECT page, unnest(arg_max(groups, n)) AS g FROM s GROUP BY page)
""")
def span_lines(spark, sf_dir):
    """Lines of pages: line items of four orders stand for a page's fragments."""
    item = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    item = item.groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")])
    base, x0, size = 12.0 * (1 + F.col("l_suppkey") % 6) + F.col("l_linenumber") % 4 * 0.5, (F.col("l_partkey") % 40 * 5).cast("double"), (6 + F.col("l_quantity") % 3 * 3).cast("double")
    text = F.when(F.col("l_linenumber") % 3 == 0, "1.").when(F.col("l_linenumber") % 3 == 1, "word ").otherwise(F.col("l_returnflag"))
    spans = item.select(
        F.floor(F.col("l_orderkey") / 4).alias("page"), (F.col("l_orderkey") % 4 * 8 + F.col("l_linenumber")).alias("frag"), F.lit(0).alias("span"), x0.alias("x0"), (base - size).alias("y0"),
        (x0 + 5 + F.col("l_suppkey") % 30).alias("x1"), base.alias("y1"), size.alias("size"), F.lit(False).alias("sup"), text.alias("text"),
    )
    first = F.array_min(F.transform("spans", lambda s: s["frag"]))
    return building.build(spans, ["page"]).select("page", first.alias("first_frag"), "x0", "y0", "x1", "y1", "n_frags")


_NESTED = "SELECT o_orderkey // 1024 AS doc, o_orderkey * 8 AS pre, o_orderkey * 8 + 8 * CASE WHEN o_orderkey % 64 = 0 THEN 64 WHEN o_orderkey % 16 = 0 THEN 16 WHEN o_orderkey % 4 = 0 THEN 4 ELSE 1 END - 1 AS last, o_orderstatus AS status FROM orders"


def _nested(spark, sf_dir):
    """doc, pre, last, tag: orders as elements that nest; those with keys by 64, by 16 and by 4 hold the orders up to the next."""
    key = F.col("o_orderkey")
    wide = F.when(key % 64 == 0, 64).when(key % 16 == 0, 16).when(key % 4 == 0, 4).otherwise(1)
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    return rows.select(F.floor(key / 1024).alias("doc"), (key * 8).alias("pre"), (key * 8 + 8 * wide - 1).alias("last"), "o_orderstatus")


@query(f"""
    WITH a AS (SELECT * FROM ({_NESTED}) WHERE status <> 'P'), n AS (SELECT DISTINCT l_orderkey // 1024 AS doc, l_orderkey * 8 + l_linenumber AS pre FROM lineitem)
    SELECT n.doc, n.pre, max(a.pre) AS ancestor, count(a.pre) AS around FROM n LEFT JOIN a ON n.doc = a.doc AND a.pre < n.pre AND n.pre <= a.last GROUP BY n.doc, n.pre
""")
def ancestor_context(spark, sf_dir):
    """The nearest element around each line item, and how many are: orders that aren't pending stand for elements."""
    item = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    nodes = item.select(F.floor(F.col("l_orderkey") / 1024).alias("doc"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pre")).distinct()
    holders = _nested(spark, sf_dir).where("o_orderstatus <> 'P'")
    return tree.nearest_ancestor(nodes, holders, ["doc"], "around")


@query(f"""
    WITH a AS (SELECT *, CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 2 END AS kind FROM ({_NESTED}) WHERE pre % 32 = 0), n AS (SELECT DISTINCT l_orderkey // 1024 AS doc, l_orderkey * 8 + l_linenumber AS pre FROM lineitem)
    SELECT n.doc, n.pre, CASE min(a.kind) WHEN 1 THEN 'reference' WHEN 2 THEN 'caption' WHEN 3 THEN 'sidebar' ELSE 'body' END AS context
    FROM n LEFT JOIN a ON n.doc = a.doc AND a.pre < n.pre AND n.pre <= a.last GROUP BY n.doc, n.pre
""")
def link_contexts(spark, sf_dir):
    """What the elements around a link make it: every fourth order holds the line items up to the next, as a reference, a caption or a box."""
    tag = F.when(F.col("o_orderstatus") == "F", "ref").when(F.col("o_orderstatus") == "O", "boxed-text").otherwise("caption")
    holders = _nested(spark, sf_dir).where("pre % 32 = 0").select("doc", "pre", "last", tag.alias("tag"))
    item = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    pre = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    links = item.select(F.floor(F.col("l_orderkey") / 1024).alias("doc"), pre.alias("pre"), pre.alias("last"), F.lit("xref").alias("tag"))
    return pages.contexts(holders.unionByName(links), "doc")


_PIECES = "SELECT item_id * 4096 + i AS probe, CASE item_id % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'body_p' ELSE 'reference' END AS kind, array_to_string(regexp_extract_all(lower(replace(p, chr(173), '')), '[\\p{L}\\p{N}_]+'), ' ') AS k FROM (SELECT item_id, unnest(string_split(text, '. ')) AS p, generate_subscripts(string_split(text, '. '), 1) - 1 AS i FROM benchmark)"


@query(f"""
    WITH p AS MATERIALIZED (SELECT * FROM ({_PIECES}) WHERE length(k) >= 6),
    s AS (SELECT doc_id * 65536 + line_no AS ord, doc_id, line_no, line, array_to_string(regexp_extract_all(lower(replace(line, chr(173), '')), '[\\p{{L}}\\p{{N}}_]+'), ' ') AS n FROM ({SQL_LINES})
          UNION ALL SELECT (item_id + 1000000) * 65536, item_id + 1000000, 0, text, array_to_string(regexp_extract_all(lower(replace(text, chr(173), '')), '[\\p{{L}}\\p{{N}}_]+'), ' ') FROM benchmark),
    l AS MATERIALIZED (SELECT * FROM s WHERE length(n) >= 6),
    h AS (SELECT p.probe, min(p.kind) AS kind, min(l.ord) AS ord FROM p JOIN l ON substr(n, 1, 12) = substr(k, 1, 12) AND (starts_with(k, substr(n, 1, 40)) OR starts_with(n, substr(k, 1, 40))) GROUP BY p.probe),
    f AS (SELECT h.kind, CAST(8 + s.line_no % 5 AS DOUBLE) AS size, s.doc_id % 2 = 0 AS bold FROM h JOIN s USING (ord)),
    b AS (SELECT CAST(arg_max(size, n * 1000000000000 - first) AS DOUBLE) AS body FROM (SELECT CAST(8 + line_no % 5 AS DOUBLE) AS size, sum(length(line)) AS n, min(ord) / 1000000 AS first FROM s GROUP BY 1))
    SELECT kind, count(*) AS matched, median(round(size / body, 2)) AS size_ratio_median, min(round(size / body, 2)) AS size_ratio_min, max(round(size / body, 2)) AS size_ratio_max, round(avg(CAST(bold AS INT)), 2) AS bold FROM f, b GROUP BY kind
""")
def aligned_kinds(spark, sf_dir):
    """What the lines look like that stand for sentences of the benchmark: all lines of documents, and the benchmark's own texts."""
    pieces = table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", F.posexplode(F.split("text", "\\. ")).alias("i", "text"))
    kind = F.when(F.col("item_id") % 3 == 0, "title").when(F.col("item_id") % 3 == 1, "body_p").otherwise("reference")
    probes = pieces.select(F.lit(1).alias("book"), (F.col("item_id") * 4096 + F.col("i")).alias("probe"), kind.alias("kind"), "text")
    own = table(spark, sf_dir, "benchmark", "item_id", "text").select((F.col("item_id") + 1000000).alias("doc_id"), F.lit(0).alias("line_no"), F.col("text").alias("line"))
    rows = lines(spark, sf_dir).select("doc_id", "line_no", "line").unionByName(own)
    laid = rows.select(
        F.lit(1).alias("book"), (F.col("doc_id") * 65536 + F.col("line_no")).alias("ord"), F.col("doc_id").alias("page"), F.col("line").alias("text"), (8 + F.col("line_no") % 5).cast("double").alias("size"),
        F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("y1"), F.lit(1.0).alias("page_w"), (F.col("doc_id") % 2 == 0).alias("bold"), F.lit(False).alias("italic"), F.lit("Body").alias("font"), F.lit(0).alias("color"),
    )
    return align.align(probes, laid, ["book"], most=None).select("kind", "matched", "size_ratio_median", "size_ratio_min", "size_ratio_max", "bold")


_RULES = """SELECT l_orderkey // 16 AS page, CAST(l_partkey % 3 * 100 AS DOUBLE) AS x0, l_suppkey % 12 * 30 + l_linenumber % 2 * 0.5 AS y0, CAST(l_partkey % 3 * 100 + 60 + l_quantity AS DOUBLE) AS x1,
    l_suppkey % 12 * 30 + l_linenumber % 2 * 0.5 + CASE WHEN l_linenumber % 5 = 0 THEN 29 ELSE 1 END AS y1, l_linenumber % 5 > 1 AS hline, CASE WHEN l_linenumber % 5 = 2 THEN 'l' ELSE 're' END AS kinds FROM lineitem"""
_JOINED = f"""d AS (SELECT * FROM ({_RULES})),
    g AS (SELECT DISTINCT page, x0, x1, y FROM (SELECT page, x0, x1, (y0 + y1) / 2 AS y FROM d WHERE hline OR (kinds = 're' AND x1 - x0 > 8 AND y1 - y0 < 2.5) UNION ALL
        SELECT page, x0, x1, unnest([y0, y1]) AS y FROM d WHERE kinds = 're' AND x1 - x0 > 8 AND y1 - y0 BETWEEN 2.5 AND 120)),
    h AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y, x0, x1 ROWS UNBOUNDED PRECEDING) AS line FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page ORDER BY y, x0, x1) < 1.2 THEN 0 ELSE 1 END AS new FROM g)),
    i AS (SELECT *, CASE WHEN x0 <= max(x1) OVER (PARTITION BY page, line ORDER BY x0, y, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 3 THEN 0 ELSE 1 END AS fresh FROM h),
    j AS (SELECT *, sum(fresh) OVER (PARTITION BY page, line ORDER BY x0, y, x1 ROWS UNBOUNDED PRECEDING) AS rule FROM i),
    r AS (SELECT page, min(x0) AS x0, max(x1) AS x1, arg_min(y, x0 * 100000 + y) AS y FROM j GROUP BY page, line, rule)"""


def _rules(spark, sf_dir):
    item = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    x0, y0, fifth = (F.col("l_partkey") % 3 * 100).cast("double"), F.col("l_suppkey") % 12 * 30 + F.col("l_linenumber") % 2 * 0.5, F.col("l_linenumber") % 5
    drawn = item.select(F.floor(F.col("l_orderkey") / 16).alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + 60 + F.col("l_quantity")).alias("x1"), (y0 + F.when(fifth == 0, 29).otherwise(1)).alias("y1"), (fifth > 1).alias("hline"), F.when(fifth == 2, "l").otherwise("re").alias("kinds"))
    return tables.rules(dealt(drawn, item.count(), "page"), ["page"])


@query(f"WITH {_JOINED} SELECT page, x0, x1, y FROM r")
def joined_rules(spark, sf_dir):
    """Rules of pages from their segments: line items of sixteen orders stand for a page's drawings."""
    return _rules(spark, sf_dir)


@query(f"""
    WITH {_JOINED},
    a AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY x0, x1, y ROWS UNBOUNDED PRECEDING) AS l FROM (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY page ORDER BY x0, x1, y) < 4 THEN 0 ELSE 1 END AS new FROM r)),
    b AS (SELECT page, x0, x1, y, l, sum(fresh) OVER (PARTITION BY page, l ORDER BY x1, y ROWS UNBOUNDED PRECEDING) AS e FROM (SELECT *, CASE WHEN x1 - lag(x1) OVER (PARTITION BY page, l ORDER BY x1, y) < 4 THEN 0 ELSE 1 END AS fresh FROM a)),
    c AS (SELECT page, x0, x1, y, l, e, sum(part) OVER (PARTITION BY page, l, e ORDER BY y, x0, x1 ROWS UNBOUNDED PRECEDING) AS p FROM (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page, l, e ORDER BY y, x0, x1) - 1 < 120 THEN 0 ELSE 1 END AS part FROM b))
    SELECT page, arg_min(x0, y * 10000 + x0) AS x0, min(y) - 0.5 AS y0, max(y) + 0.5 AS y1, count(*) AS n FROM c GROUP BY page, l, e, p HAVING count(*) >= 3 AND arg_min(x1, y * 10000 + x0) - arg_min(x0, y * 10000 + x0) >= 80
""")
def rule_stacks(spark, sf_dir):
    """Stacks of rules that may be tables."""
    return tables.stacks(_rules(spark, sf_dir), ["page"]).select("page", "x0", "y0", "y1", "n")


@query("""
    WITH RECURSIVE n AS (SELECT l_orderkey AS "at", count(*) AS n_rows FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1),
    t AS (SELECT o_custkey % 20 AS book, o_orderkey AS "at", o_orderpriority AS key, o_orderkey // 40 AS page, o_orderstatus = 'P' AS told, o_orderkey % 2 AS cols, o_orderkey % 3 AS heads, coalesce(n_rows, 0) AS n_rows, row_number() OVER (PARTITION BY o_custkey % 20, o_orderpriority ORDER BY o_orderkey) AS n FROM orders LEFT JOIN n ON "at" = o_orderkey),
    s(book, key, n, "at", head, hpage, hcols, held, taken, dropped, first_row) AS (
        SELECT book, key, n, "at", "at", page, cols, n_rows, n_rows, CAST(0 AS BIGINT), CAST(0 AS HUGEINT) FROM t WHERE n = 1
        UNION ALL
        SELECT t.book, t.key, t.n, t."at", CASE WHEN goes THEN head ELSE t."at" END, CASE WHEN goes THEN hpage ELSE page END, CASE WHEN goes THEN hcols ELSE cols END, CASE WHEN goes THEN held + got ELSE t.n_rows END, CASE WHEN goes THEN got ELSE t.n_rows END, CASE WHEN goes THEN cut ELSE 0 END, CASE WHEN goes THEN held ELSE 0 END
        FROM s JOIN t ON t.book = s.book AND t.key = s.key AND t.n = s.n + 1, LATERAL (SELECT told OR page = hpage + 1 AS goes), LATERAL (SELECT CASE WHEN held > 0 AND cols = hcols THEN least(heads, t.n_rows) ELSE 0 END AS cut),
             LATERAL (SELECT CASE WHEN held = 0 OR cols = hcols THEN t.n_rows - cut ELSE 0 END AS got))
    SELECT book, "at", head, CAST(first_row AS BIGINT) AS first_row, CAST(dropped AS BIGINT) AS dropped, CAST(taken AS BIGINT) AS taken FROM s
""")
def table_continuations(spark, sf_dir):
    """Tables that go on over pages, and where their rows stand: orders of one priority stand for tables of one label."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").distinct().groupBy(F.col("l_orderkey").alias("_at")).agg(F.count(F.lit(1)).alias("n_rows"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").join(rows, F.col("o_orderkey") == F.col("_at"), "left")
    made = orders.select(
        (F.col("o_custkey") % 20).alias("book"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("key"), F.floor(F.col("o_orderkey") / 40).alias("page"), (F.col("o_orderstatus") == "P").alias("continued"),
        (F.col("o_orderkey") % 2).alias("ncols"), (F.col("o_orderkey") % 3).alias("header_rows"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )
    return tables.continued(made, ["book"]).select("book", "at", "head", "first_row", "dropped", "taken")


@query("""
    WITH RECURSIVE a AS (SELECT user_id AS book, event_id AS seq, CASE event_type WHEN 'error' THEN 'undo' WHEN 'purchase' THEN 'redo' ELSE 'edit' END AS action, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    s(book, n, old, undo, redo) AS (
        SELECT DISTINCT book, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM a
        UNION ALL
        SELECT s.book, a.n, CASE WHEN action = 'edit' AND len(undo) >= 60 THEN list_append(old, undo[1]) ELSE old END,
               CASE WHEN action = 'edit' THEN CASE WHEN len(undo) >= 60 THEN list_append(undo[2:], seq) ELSE list_append(undo, seq) END WHEN action = 'undo' AND len(undo) > 0 THEN undo[:-2] WHEN action = 'redo' AND len(redo) > 0 THEN list_append(undo, redo[-1]) ELSE undo END,
               CASE WHEN action = 'edit' THEN CAST([] AS BIGINT[]) WHEN action = 'undo' AND len(undo) > 0 THEN list_append(redo, undo[-1]) WHEN action = 'redo' AND len(redo) > 0 THEN redo[:-2] ELSE redo END
        FROM s JOIN a ON a.book = s.book AND a.n = s.n + 1),
    e AS (SELECT book, unnest(list_concat(arg_max(old, n), arg_max(undo, n))) AS seq FROM s GROUP BY book),
    o AS (SELECT o_custkey % 150 AS book, o_orderkey AS uid, o_orderkey // 4 AS zid FROM orders),
    c AS (SELECT o.book, uid, max(seq) AS seq FROM o JOIN e ON e.book = o.book AND uid % 50 = seq % 50 GROUP BY 1, 2)
    SELECT o.book, o.uid, CASE WHEN c.seq IS NULL THEN o.zid ELSE 1000000 + c.seq END AS zid FROM o LEFT JOIN c ON c.book = o.book AND c.uid = o.uid WHERE c.seq IS NULL OR c.seq % 7 <> 0
""")
def owners_as_of(spark, sf_dir):
    """Owners of lines after all edits, undos and redos: orders stand for lines, events for what people did."""
    done = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "purchase", "redo").otherwise("edit")
    actions = table(spark, sf_dir, "events", "event_id", "user_id", "event_type").select(F.col("user_id").alias("book"), F.col("event_id").alias("seq"), done.alias("action"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    base = orders.select((F.col("o_custkey") % 150).alias("book"), F.col("o_orderkey").alias("uid"), F.floor(F.col("o_orderkey") / 4).alias("zid"))
    edits = actions.where("action = 'edit'").select(F.col("book").alias("_b"), "seq")
    made = base.join(edits, (F.col("book") == F.col("_b")) & (F.col("uid") % 50 == F.col("seq") % 50))
    changes = made.select("seq", "book", "uid", (F.col("seq") % 7 == 0).alias("gone"), F.struct((F.lit(1000000) + F.col("seq")).alias("zid")).alias("state"))
    return zones.as_of(base, changes, actions, ["book", "uid"])
