"""Queries on the driver tables: each applies an operator of the library to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumframe.functions import text as T
from vellumframe.operators import bags, islands, links, modes, ordered
from vellumframe.shared import TEXTS, dealt, written
from vellumframe.sources import markup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Only the columns that a query names reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def micros(column: str):
    """Microseconds since 1970 of a timestamp, with a zone or without."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of documents, doc_id among them, in partitions of about TEXTS documents: later groups by document move no more."""
    docs = table(spark, sf_dir, "documents", *columns)
    return dealt(docs, docs.count(), "doc_id", each=TEXTS)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, line_no, line: the lines of each document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return docs.select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


SQL_LINES = "SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"
#: norm_repeat in RE2, which has no look-around: a second pass takes the words whose neighbour the first one used up.
_ROMAN = "'(^|[^\\p{L}\\p{N}_])[ivxlc]+($|[^\\p{L}\\p{N}_])', '\\1#\\2', 'g'"


def sql_norm_repeat(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[0-9]+', '#', 'g'), {_ROMAN}), {_ROMAN}), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(f"""
    WITH p AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page FROM documents),
    l AS (SELECT d.source, p.page, d.line_no, {sql_norm_repeat("d.line")} AS norm FROM ({SQL_LINES}) d JOIN p USING (doc_id) WHERE trim(d.line) <> ''),
    n AS (SELECT source, page, line_no, norm, count(*) OVER (PARTITION BY source, norm ORDER BY page RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS near FROM l)
    SELECT source, page, line_no, norm, near FROM n WHERE near >= 3 AND length(norm) < 160
""")
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur, but for numbers, on at least 3 of the pages within 12 of theirs in one source."""
    pages = ordered.numbered(table(spark, sf_dir, "documents", "doc_id", "source"), ["source"], "doc_id", "page").select(F.col("doc_id").alias("_doc"), "page")
    own = lines(spark, sf_dir).where(F.trim("line") != "").select("doc_id", "source", "line_no", T.norm_repeat(F.col("line")).alias("norm")).where(F.length("norm") < 160)
    placed = own.join(pages, F.col("doc_id") == F.col("_doc")).select("source", "page", "line_no", "norm")
    # The lines of one page that are alike travel with their count, so that heads need no join back.
    near = ordered.counts_near(placed, ["source", "norm"], "page", 12, "near", also=(F.collect_list("line_no").alias("line_nos"),)).where("near >= 3")
    return near.select("source", "page", F.explode("line_nos").alias("line_no"), "norm", F.col("near").cast("long").alias("near"))


@query(f"SELECT line, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({SQL_LINES}) WHERE line <> '' GROUP BY line ORDER BY n DESC, line LIMIT 30")
def line_repeat_topk(spark, sf_dir):
    """The 30 most frequent lines."""
    counted = lines(spark, sf_dir).where("line <> ''").groupBy("line", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    return counted.groupBy("line").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("docs")).orderBy(F.desc("n"), "line").limit(30)


@query(f"SELECT doc_id, md5({sql_norm_repeat('text')}) AS norm_md5 FROM documents")
def norm_text(spark, sf_dir):
    """norm_repeat of whole texts, by digest."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(T.norm_repeat(F.col("text"))).alias("norm_md5"))


@query("""
    WITH t AS (SELECT doc_id, string_split(text, chr(10))[1] AS title FROM documents),
    f AS (SELECT doc_id, lower(strip_accents(title)) AS t FROM t)
    SELECT doc_id, trim(regexp_replace(regexp_replace(t, '^(?:[0-9]+(?:\\.[0-9]+)*|[ivxlc]+|[a-z])[.:)][ \\t\\n\\x0B\\f\\r]+', ''), '[^a-z0-9]+', ' ', 'g')) AS title FROM f
""")
def title_norm(spark, sf_dir):
    """norm_title of each document's first line."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.norm_title(F.split("text", "\n", -1)[0]).alias("title"))


_STOPS = ", ".join(f"('{k}', {i}, ['{"', '".join(v.split())}'])" for i, (k, v) in enumerate(T.STOP_WORDS.items()))
_SQL_LANG = f"""
    t AS (SELECT doc_id, length(text) AS n, regexp_extract_all(lower(text), '[a-záéíóúüñàèìòùâêîôûçäöß]+') AS w FROM documents),
    s AS (SELECT doc_id, n, lang, pos, len(list_filter(w, lambda x: list_contains(words, x))) AS hits FROM t, (VALUES {_STOPS}) v(lang, pos, words)),
    b AS (SELECT doc_id, max(n) AS n, max(hits) AS hits, sum(hits) AS total, arg_max(lang, hits * 10 - pos) AS lang FROM s GROUP BY doc_id)
"""


@query(f"WITH {_SQL_LANG} SELECT doc_id, CASE WHEN hits >= 3 AND n >= 20 THEN lang END AS lang, CAST(hits AS BIGINT) AS hits, CAST(total AS BIGINT) AS total FROM b")
def lang_stopwords(spark, sf_dir):
    """Language by stop words."""
    found = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("x", T.language(F.col("text")))
    return found.select("doc_id", F.col("x.lang").alias("lang"), F.col("x.hits").cast("long").alias("hits"), F.col("x.total").cast("long").alias("total"))


@query(f"WITH {_SQL_LANG} SELECT d.lang AS actual, CASE WHEN hits >= 3 AND n >= 20 THEN b.lang END AS detected, count(*) AS n FROM b JOIN documents d USING (doc_id) GROUP BY 1, 2")
def lang_accuracy(spark, sf_dir):
    """Detected against given languages."""
    docs = table(spark, sf_dir, "documents", "text", "lang").select(F.col("lang").alias("actual"), T.language(F.col("text"))["lang"].alias("detected"))
    return docs.groupBy("actual", "detected").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents) GROUP BY word")
def word_lexicon(spark, sf_dir):
    """How often each word occurs."""
    return table(spark, sf_dir, "documents", "text").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


_SQL_BAGS = """
    d AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents) GROUP BY 1, 2),
    b AS (SELECT word, count(*) AS m FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM benchmark) GROUP BY 1)
"""


def _doc_words(spark, sf_dir) -> DataFrame:
    docs = texts(spark, sf_dir, "doc_id", "text").select("doc_id", F.explode(T.words(F.col("text"))).alias("word"))
    return bags.bag(docs, ["doc_id"], "word")


def _benchmark_words(spark, sf_dir) -> DataFrame:
    return bags.bag(table(spark, sf_dir, "benchmark", "text").select(F.explode(T.words(F.col("text"))).alias("word")), [], "word")


@query(f"""
    WITH {_SQL_BAGS},
    c AS (SELECT doc_id, n, coalesce(m, 0) AS m, coalesce(sum(n) OVER (PARTITION BY word ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM d LEFT JOIN b USING (word))
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS words, CAST(sum(greatest(0, least(n, m - used))) AS BIGINT) AS matched FROM c GROUP BY doc_id
""")
def doc_coverage(spark, sf_dir):
    """Documents in order claim words of the benchmark, each once."""
    return bags.claimed(written(_doc_words(spark, sf_dir), "words"), _benchmark_words(spark, sf_dir), "doc_id", "word", like=table(spark, sf_dir, "documents", "doc_id"))


@query(f"""
    WITH {_SQL_BAGS}
    SELECT doc_id, CAST(sum(n) AS BIGINT) AS words, CAST(sum(least(n, coalesce(m, 0))) AS BIGINT) AS matched,
           sum(least(n, coalesce(m, 0))) / (SELECT sum(m) FROM b) AS recall, sum(least(n, coalesce(m, 0))) / sum(n) AS "precision"
    FROM d LEFT JOIN b USING (word) GROUP BY doc_id
""")
def word_overlap_pr(spark, sf_dir):
    """Word recall and precision of each document against the benchmark."""
    other = written(_benchmark_words(spark, sf_dir), "words")
    total = other.agg(F.sum("n").alias("_total"))
    found = bags.overlap(_doc_words(spark, sf_dir), other, ["doc_id"], "word")
    return found.crossJoin(F.broadcast(total)).select("doc_id", "words", F.col("matched").cast("long").alias("matched"), (F.col("matched") / F.col("_total")).alias("recall"), (F.col("matched") / F.col("words")).alias("precision"))


@query(f"""
    WITH s AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(strip_accents(line)), '[a-z0-9]+')[1:8], ' ') AS start FROM ({SQL_LINES}))
    SELECT start, count(*) AS n, count(DISTINCT doc_id) AS docs FROM s WHERE start <> '' GROUP BY start HAVING count(*) > 1
""")
def paragraph_starts(spark, sf_dir):
    """First eight words of paragraphs that begin more than one."""
    starts = lines(spark, sf_dir).select("doc_id", F.array_join(F.slice(T.ascii_words(F.col("line")), 1, 8), " ").alias("start")).where("start <> ''")
    counted = starts.groupBy("start", "doc_id").agg(F.count(F.lit(1)).alias("m"))
    return counted.groupBy("start").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("docs")).where("n > 1")


@query("SELECT sha1(text) AS sha1, min(doc_id) AS kept, count(*) AS n FROM documents GROUP BY 1")
def dup_content(spark, sf_dir):
    """Files of equal content, of which the first stays."""
    return table(spark, sf_dir, "documents", "doc_id", "text").groupBy(F.sha1("text").alias("sha1")).agg(F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("n"))


_RAW = r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->"
_SQL_RAW = f"regexp_replace(html, '{_RAW}', ' ', 'g')"


@query(f"""
    WITH t AS (SELECT page_id, unnest(regexp_extract_all({_SQL_RAW}, '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
    SELECT tag, count(*) AS n, count(DISTINCT page_id) AS docs FROM t GROUP BY tag
""")
def tag_inventory(spark, sf_dir):
    """Elements and how many pages have them."""
    tags = table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.explode(F.regexp_extract_all(F.regexp_replace("html", _RAW, " "), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    counted = tags.groupBy("tag", "page_id").agg(F.count(F.lit(1)).alias("m"))
    return counted.groupBy("tag").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("docs"))


_ATTR = '([a-z-]+)="([^"]*)"'


@query(f"""
    WITH r AS (SELECT {_SQL_RAW} AS h FROM pages),
    a AS (SELECT unnest(regexp_extract_all(h, ' {_ATTR}', 1)) AS attr, unnest(regexp_extract_all(h, ' {_ATTR}', 2)) AS v FROM r)
    SELECT attr, CASE WHEN attr IN ('id', 'href', 'src') OR length(v) > 60 THEN '<value>' ELSE v END AS value, count(*) AS n FROM a GROUP BY 1, 2
""")
def attr_inventory(spark, sf_dir):
    """Values of attributes; ids, links and long values are masked."""
    raw = table(spark, sf_dir, "pages", "html").select(F.regexp_replace("html", _RAW, " ").alias("h"))
    pairs = F.arrays_zip(F.regexp_extract_all("h", F.lit(f" {_ATTR}"), F.lit(1)).alias("attr"), F.regexp_extract_all("h", F.lit(f" {_ATTR}"), F.lit(2)).alias("v"))
    rows = raw.select(F.explode(pairs).alias("x")).select("x.attr", "x.v")
    value = F.when(F.col("attr").isin("id", "href", "src") | (F.length("v") > 60), "<value>").otherwise(F.col("v"))
    return rows.groupBy("attr", value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query()
def parent_child(spark, sf_dir):
    """Which elements stand in which, and how often. Tag soup has no SQL reading; tests hold it against another parser."""
    rows = markup.dom(table(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html", family=True)
    return rows.groupBy(F.coalesce("parent_tag", F.lit("#root")).alias("parent_tag"), F.col("tag").alias("child_tag")).agg(F.count(F.lit(1)).alias("n"))


@query()
def child_sequences(spark, sf_dir):
    """The eight most frequent sequences of children below each element, equal neighbours taken once, up to twelve."""
    rows = markup.dom(table(spark, sf_dir, "pages", "page_id", "html"), "page_id", "html", family=True).where(F.size("children") > 0)
    once = F.filter("children", lambda t, i: (i == 0) | (F.get("children", i - 1) != t))
    placed = rows.select("tag", F.array_join(F.slice(once, 1, 12), " ").alias("children"), (F.col("page_id") * (1 << 24) + F.col("pre")).alias("_order"))
    return modes.top_counts(placed, ["tag"], "children", 8, F.col("_order"))


@query("""
    SELECT array_to_string(list_transform(regexp_extract_all(url, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN concat('{N', length(p), '}') ELSE p END), '') AS shape,
           count(*) AS n, min(url) AS example FROM pages GROUP BY 1
""")
def url_shapes(spark, sf_dir):
    """Shapes of addresses, with the widths of their numbers."""
    return table(spark, sf_dir, "pages", "url").groupBy(T.id_shape(F.col("url")).alias("shape")).agg(F.count(F.lit(1)).alias("n"), F.min("url").alias("example"))


@query("""
    WITH p AS (SELECT page_id, split_part(url, ':', 1) AS scheme, split_part(url, '/', 3) AS host FROM pages),
    c AS (SELECT scheme, host, count(*) AS n, min(page_id) AS first FROM p GROUP BY 1, 2)
    SELECT scheme, host AS mode, n AS weight FROM (SELECT *, row_number() OVER (PARTITION BY scheme ORDER BY n DESC, first) AS r FROM c) WHERE r = 1
""")
def url_prefix_mode(spark, sf_dir):
    """The most frequent host of each scheme; of equal ones the first seen."""
    rows = table(spark, sf_dir, "pages", "page_id", "url").select("page_id", F.split_part("url", F.lit(":"), F.lit(1)).alias("scheme"), F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    return modes.weighted_mode(rows, ["scheme"], "host", F.lit(1).cast("long"), F.col("page_id"))


@query(f"""
    WITH h AS (SELECT page_id, unnest(regexp_extract_all({_SQL_RAW}, 'href="([^"]*)"', 1)) AS href FROM pages),
    k AS (SELECT DISTINCT '/' || split_part(url, '/', 4) AS path FROM pages)
    SELECT CASE WHEN k.path IS NOT NULL THEN 'internal' WHEN contains(href, '://') OR starts_with(href, 'www') THEN 'uri' ELSE 'unresolved' END AS kind, count(*) AS n
    FROM h LEFT JOIN k ON h.href = k.path GROUP BY 1
""")
def link_targets(spark, sf_dir):
    """Links by what they point to."""
    hrefs = table(spark, sf_dir, "pages", "page_id", "html").select(F.explode(F.regexp_extract_all(F.regexp_replace("html", _RAW, " "), F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    counted = hrefs.groupBy("href").agg(F.count(F.lit(1)).alias("m"))
    paths = table(spark, sf_dir, "pages", "url").select(F.concat(F.lit("/"), F.split_part("url", F.lit("/"), F.lit(4))).alias("path")).distinct()
    kind = F.when(F.col("path").isNotNull(), "internal").when(F.contains("href", F.lit("://")) | F.startswith("href", F.lit("www")), "uri").otherwise("unresolved")
    return counted.join(paths, F.col("href") == F.col("path"), "left").groupBy(kind.alias("kind")).agg(F.sum("m").alias("n"))


@query("""
    WITH t AS (SELECT role AS kind, conv_id AS scope, split_part(text, ' ', 1) AS key, conv_id * 1000 + turn AS target FROM conversations WHERE turn < 2),
    a AS (SELECT conv_id, turn, role AS kind, conv_id AS scope, split_part(text, ' ', 1) AS key FROM conversations),
    e AS (SELECT kind, scope, key, min(target) AS found FROM t GROUP BY ALL),
    u AS (SELECT kind, key, min(target) AS only FROM t GROUP BY ALL HAVING count(*) = 1)
    SELECT conv_id, turn, coalesce(e.found, u.only) AS found, CASE WHEN e.found IS NOT NULL THEN 'scoped' WHEN u.only IS NOT NULL THEN 'unique' ELSE 'none' END AS how
    FROM a LEFT JOIN e USING (kind, scope, key) LEFT JOIN u USING (kind, key)
""")
def scoped_lookup(spark, sf_dir):
    """First words of turns looked up among those of first turns: in the conversation, else where they are unique."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").withColumns({"kind": F.col("role"), "scope": F.col("conv_id"), "key": F.split_part("text", F.lit(" "), F.lit(1))})
    targets = rows.where("turn < 2").select("kind", "scope", "key", (F.col("conv_id") * 1000 + F.col("turn")).alias("target"))
    found = links.scoped_lookup(rows.select("conv_id", "turn", "kind", "scope", "key"), targets.withColumn("pos", F.col("target")))
    return found.select("conv_id", "turn", "found", "how")


@query("""
    WITH p AS (SELECT p_partkey FROM part WHERE p_size <= 25)
    SELECT l_partkey AS part, count(*) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.p_partkey = l.l_partkey) GROUP BY 1
""")
def broken_refs(spark, sf_dir):
    """References to parts that a catalogue of small parts lacks."""
    items = table(spark, sf_dir, "lineitem", "l_partkey")
    return links.broken(items, table(spark, sf_dir, "part", "p_partkey", "p_size").where("p_size <= 25"), "l_partkey", "p_partkey").groupBy(F.col("l_partkey").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, p_brand, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS incoming FROM part")
def link_incoming(spark, sf_dir):
    """How many lines point to each part."""
    return links.incoming(table(spark, sf_dir, "lineitem", "l_partkey"), table(spark, sf_dir, "part", "p_partkey", "p_brand"), "l_partkey", "p_partkey")


@query("SELECT l_orderkey AS order_key, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    """Line ids that occur more than once."""
    return table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").groupBy(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT regexp_full_match(c_name, '[A-Za-z_][A-Za-z0-9._-]*') OR c_custkey % 7 = 0 AND NOT regexp_full_match(c_name, '[a-z]+-[0-9]{3}')")
def invalid_ids(spark, sf_dir):
    """Names that aren't XML ids, or of every seventh customer, not of the pattern."""
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_name")
    return rows.where(~F.col("c_name").rlike("^[A-Za-z_][A-Za-z0-9._-]*$") | ((F.col("c_custkey") % 7 == 0) & ~F.col("c_name").rlike("^[a-z]+-[0-9]{3}$")))


_SQL_TURN_WORDS = "SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM conversations"


@query(f"SELECT conv_id, word, min(turn) AS turn, count(*) AS turns FROM ({_SQL_TURN_WORDS}) GROUP BY 1, 2")
def first_citation(spark, sf_dir):
    """The first turn of a conversation that has a word, and how many have it."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    return rows.groupBy("conv_id", "word").agg(F.min("turn").alias("turn"), F.countDistinct("turn").alias("turns"))


@query(f"""
    WITH f AS (SELECT conv_id, word, min(turn) AS a, max(turn) AS b FROM ({_SQL_TURN_WORDS}) GROUP BY 1, 2)
    SELECT CASE WHEN b = a THEN 'same block' WHEN b - a = 1 THEN 'immediately after' ELSE concat('+', least(b - a - 1, 5)) END AS relation, count(*) AS n FROM f GROUP BY 1
""")
def placement_relation(spark, sf_dir):
    """How far behind its first mention a word's last one stands, in blocks, five at most."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    ends = rows.groupBy("conv_id", "word").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    far = F.col("b") - F.col("a")
    relation = F.when(far == 0, "same block").when(far == 1, "immediately after").otherwise(F.concat(F.lit("+"), F.least(far - 1, F.lit(5)).cast("string")))
    return ends.groupBy(relation.alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("""
    WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
    SELECT o_orderkey, concat('c', o_custkey, '-ord', printf('%03d', n)) AS xml_id FROM o
""")
def id_numbering(spark, sf_dir):
    """Ids numbered within their part, in order, of at least three digits."""
    rows = ordered.numbered(table(spark, sf_dir, "orders", "o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "n").withColumn("n", (F.col("n") + 1).cast("long"))
    return rows.select("o_orderkey", links.numbered_ids(rows, F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit("ord"), "n").alias("xml_id"))


@query("""
    WITH o AS (SELECT o_custkey AS pdf, o_orderkey AS folio, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page FROM orders),
    c AS (SELECT pdf, folio // 100 - page AS off, count(*) AS n, min(page) AS first FROM o GROUP BY 1, 2),
    m AS (SELECT pdf, off, n FROM (SELECT *, row_number() OVER (PARTITION BY pdf ORDER BY n DESC, first) AS r FROM c) WHERE r = 1)
    SELECT o.pdf, o.page, CASE WHEN folio // 100 = page + off THEN folio // 100 WHEN n >= 3 AND page + off >= 1 THEN page + off ELSE folio // 100 END AS folio,
           CASE WHEN folio // 100 = page + off THEN 0.9 WHEN n >= 3 AND page + off >= 1 THEN 0.6 ELSE 0.9 END AS conf
    FROM o JOIN m USING (pdf)
""")
def folio_fit(spark, sf_dir):
    """Printed numbers fitted to the most frequent offset from the page, and repaired where at least three agree."""
    rows = ordered.numbered(table(spark, sf_dir, "orders", "o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "page")
    rows = rows.select(F.col("o_custkey").alias("pdf"), F.col("page").cast("long").alias("page"), F.floor(F.col("o_orderkey") / 100).alias("folio"))
    best = modes.weighted_mode(rows.withColumn("off", F.col("folio") - F.col("page")), ["pdf"], "off", F.lit(1).cast("long"), F.col("page")).withColumnRenamed("pdf", "_pdf")
    expect = F.col("page") + F.col("mode")
    fix = (F.col("folio") != expect) & (F.col("weight") >= 3) & (expect >= 1)
    return rows.join(best, F.col("pdf") == F.col("_pdf")).select("pdf", "page", F.when(fix, expect).otherwise(F.col("folio")).alias("folio"), F.when(fix, 0.6).otherwise(0.9).alias("conf"))


@query("""
    WITH c AS (SELECT l_returnflag, l_linenumber, sum(l_quantity) AS w, min(l_orderkey) AS first FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, l_linenumber AS mode, w AS weight FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY w DESC, first) AS r FROM c) WHERE r = 1
""")
def weighted_mode(spark, sf_dir):
    """The line number with most quantity for each flag: the rule of a book's body style."""
    return modes.weighted_mode(table(spark, sf_dir, "lineitem", "l_returnflag", "l_linenumber", "l_quantity", "l_orderkey"), ["l_returnflag"], "l_linenumber", F.col("l_quantity"), F.col("l_orderkey"))


@query("""
    WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
    SELECT user_id, list_sort(list(gap))[count(*) // 2 + 1] AS gap, count(*) // 2 AS at FROM g WHERE gap IS NOT NULL GROUP BY user_id
""")
def upper_median_gap(spark, sf_dir):
    """The upper median of the gaps between a user's events: the rule of a book's line pitch."""
    rows = table(spark, sf_dir, "events", "user_id", "ts", "event_id").select("user_id", micros("ts").alias("t"), "event_id")
    rows = ordered.running_before(rows, ["user_id"], "t", "t", "prev", "last", ("event_id",))
    return modes.upper_median(written(rows.select("user_id", (F.col("t") - F.col("prev")).alias("gap")), "gaps"), ["user_id"], "gap", "gap")


@query("SELECT l_partkey, list_sort(list(l_extendedprice))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1] AS edge, CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) AS at FROM lineitem GROUP BY 1")
def right_edge_p90(spark, sf_dir):
    """The value at index int(0.9 (n - 1)) of a part's prices: the rule of a page's right edge."""
    return modes.right_edge(table(spark, sf_dir, "lineitem", "l_partkey", "l_extendedprice"), ["l_partkey"], "l_extendedprice", "edge")


@query("""
    WITH e AS (SELECT user_id, epoch_us(ts) AS t, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e)
    SELECT user_id, CAST(run AS BIGINT) AS run, min(t) AS "start", max(t) AS "end", count(*) AS n FROM r GROUP BY 1, 2
""")
def islands_merge(spark, sf_dir):
    """Events no more than an hour apart merged into runs."""
    return islands.merged(table(spark, sf_dir, "events", "user_id", "ts", "event_id").select("user_id", micros("ts").alias("t"), "event_id"), ["user_id"], "t", 3_600_000_000, ["event_id"])


@query("""
    WITH i AS (SELECT DISTINCT l_suppkey, epoch_us(l_shipdate) // 86400000000 AS b, epoch_us(l_shipdate) // 86400000000 + CAST(floor(l_quantity / 10) AS BIGINT) AS e FROM lineitem),
    r AS (SELECT l_suppkey, b, max(e) OVER (PARTITION BY l_suppkey ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
    SELECT l_suppkey, reach AS gap_start, b AS gap_end FROM r WHERE b - reach >= 6
""")
def coverage_gutters(spark, sf_dir):
    """Stretches of at least six days that none of a supplier's deliveries covers: the rule of column gutters."""
    day = F.floor(micros("l_shipdate") / 86_400_000_000)
    rows = table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_quantity").select("l_suppkey", day.alias("b"), (day + F.floor(F.col("l_quantity") / 10)).alias("e"))
    return islands.gutters(rows, ["l_suppkey"], "b", "e", 6)


@query("""
    SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'too short' END, CASE WHEN l.quality = 0 THEN 'low quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS critical,
           CASE WHEN n_chars < 200 OR coalesce(l.quality = 0, false) OR coalesce(l.toxic = 1, false) THEN 'FAILED' WHEN l.doc_id IS NULL THEN 'PASS WITH WARNINGS' ELSE 'PASS' END AS status
    FROM documents LEFT JOIN labels l USING (doc_id)
""")
def quality_gate(spark, sf_dir):
    """Critical findings and the verdict of each document."""
    marks = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").withColumnRenamed("doc_id", "_doc")
    docs = table(spark, sf_dir, "documents", "doc_id", "n_chars").join(marks, F.col("doc_id") == F.col("_doc"), "left")
    found = F.filter(F.array(F.when(F.col("n_chars") < 200, "too short"), F.when(F.col("quality") == 0, "low quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    return docs.select("doc_id", "_doc", found.alias("critical")).select("doc_id", "critical", F.when(F.size("critical") > 0, "FAILED").when(F.col("_doc").isNull(), "PASS WITH WARNINGS").otherwise("PASS").alias("status"))


@query("SELECT event_type AS code, count(*) AS n, count(*) FILTER (value > 50) AS severe FROM events GROUP BY 1")
def issue_rollup(spark, sf_dir):
    """Counts by code."""
    return table(spark, sf_dir, "events", "event_type", "value").groupBy(F.col("event_type").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("severe"))


@query("""
    WITH s AS (SELECT source, count(*) AS docs, count(*) FILTER (n_chars > 5000) AS long_docs, count(DISTINCT lang) AS langs FROM documents GROUP BY 1),
    t AS (SELECT source, list_filter([CASE WHEN docs > 40 THEN 'many' END, CASE WHEN long_docs > 5 THEN 'long' END, CASE WHEN langs > 3 THEN 'multilingual' END], lambda x: x IS NOT NULL) AS tags FROM s)
    SELECT source, CASE WHEN len(tags) = 0 THEN ['textbook'] ELSE tags END AS tags FROM t
""")
def profile_tags(spark, sf_dir):
    """Tags of each source by thresholds."""
    s = table(spark, sf_dir, "documents", "source", "n_chars", "lang").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n_chars") > 5000).alias("long_docs"), F.countDistinct("lang").alias("langs"))
    tags = F.filter(F.array(F.when(F.col("docs") > 40, "many"), F.when(F.col("long_docs") > 5, "long"), F.when(F.col("langs") > 3, "multilingual")), lambda x: x.isNotNull())
    return s.select("source", tags.alias("t")).select("source", F.when(F.size("t") == 0, F.array(F.lit("textbook"))).otherwise(F.col("t")).alias("tags"))


@query("SELECT p_type, p_brand, count(*) AS n, sum(count(*)) OVER (PARTITION BY p_type) AS total, count(*) / sum(count(*)) OVER (PARTITION BY p_type) AS share FROM part GROUP BY 1, 2")
def dominant_share(spark, sf_dir):
    """How often each pattern occurs within its kind: the evidence of a convention."""
    return modes.shares(table(spark, sf_dir, "part", "p_type", "p_brand"), ["p_type"], "p_brand")


@query("""
    WITH RECURSIVE t AS (
        SELECT 'r' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent, CAST(0 AS DOUBLE) AS value FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, CAST(0 AS DOUBLE) FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_acctbal FROM customer
    ), u AS (SELECT node AS top, node FROM t WHERE node[1] <> 'c' UNION ALL SELECT u.top, t.node FROM u JOIN t ON t.parent = u.node)
    SELECT top AS node, count(*) - 1 AS below, round(sum(value), 2) AS total FROM u JOIN t USING (node) GROUP BY 1
""")
def subtree_agg(spark, sf_dir):
    """Descendants of each inner node of a tree and the sum of their values."""
    from vellumframe.operators import tree

    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    rows = (
        table(spark, sf_dir, "region", "r_regionkey").select(node("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0.0).alias("value"))
        .union(table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(node("n", "n_nationkey"), node("r", "n_regionkey"), F.lit(0.0)))
        .union(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal").select(node("c", "c_custkey"), node("n", "c_nationkey"), "c_acctbal"))
    )
    return tree.subtree_sums(rows, "node", "parent", "value", levels=2).where("below > 0").select("node", "below", F.round("total", 2).alias("total"))


_TEXTS = ["1. First item", "2) Second", "• bullet", "•touching", "– dash", "i. letter or numeral", "ii. numeral", "IV. numeral", "a) letter", "B. letter", "no marker", "12.5 not a marker", "(3) in brackets", "xii. last"]


@query()
def list_markers(spark, sf_dir):
    """Markers at the start of lines: of fixed examples and of all documents' lines that have one."""
    fixed = spark.createDataFrame([(-1, i, t) for i, t in enumerate(_TEXTS)], "doc_id long, line_no int, line string")
    rows = fixed.union(lines(spark, sf_dir).select("doc_id", "line_no", "line")).withColumn("m", T.marker(F.col("line"))).where("m is not null")
    return rows.select("doc_id", "line_no", F.col("m.type").alias("type"), F.col("m.marker").alias("marker"), T.ordinal(F.col("m.type"), F.col("m.marker")).alias("ordinal"))
