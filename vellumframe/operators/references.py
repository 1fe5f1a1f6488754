"""Citations resolved to targets, floats placed after their first citation, and ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumframe.operators.ordered import first_of

#: Kinds of targets that a kind of citation looks for, in order, and how: scoped (then unique), own scope only,
#: or anywhere. head: only the number before a hyphen counts.
LOOKS = {
    "fig": [("fig", "scoped", False)], "table": [("table", "scoped", False)], "box": [("box", "scoped", False)], "table-or-box": [("table", "scoped", False), ("box", "scoped", False)],
    "chapter": [("chapter", "any", False)], "app": [("app", "any", False)], "bibr-paren": [("bibr", "own", True)], "bibr": [("bibr", "scoped", True)], "fn": [("fn", "scoped", False)],
    "bibr-or-fn": [("fn", "scoped", False), ("bibr", "scoped", True)], "bibr-ay": [("bibr-ay", "scoped", False)], "eq": [("eq", "scoped", False)],
}
REF_TYPE = {"fig": "fig", "table": "table", "box": "boxed-text", "chapter": "chapter", "app": "app", "bibr": "bibr", "fn": "fn", "bibr-ay": "bibr", "eq": "disp-formula"}
SILENT = ("bibr-paren", "bibr-or-fn")


def looks(spark) -> DataFrame:
    rows = [(kind, i, target, how, head) for kind, steps in LOOKS.items() for i, (target, how, head) in enumerate(steps)]
    return spark.createDataFrame(rows, "cite_kind string, step int, target_kind string, how string, head boolean")


def resolve(cites: DataFrame, targets: DataFrame) -> DataFrame:
    """cites (cite_id, kind, scope, key) with rid, target_kind, ref_type, status and severity.

    targets: (kind, scope, key, target, pos), in the order registered. Each citation asks for its kinds of target in turn:
    in its own scope the first registered; else, where that is allowed, the one target that has the key once in all
    scopes. A range whose ends are both known stands for its first. Citations and targets meet in equi-joins, one row for each step.
    """
    spark = cites.sparkSession
    head = F.regexp_extract("key", r"^([^-–]*)", 1)
    tail = F.regexp_extract("key", r"([^-–]*)$", 1)
    asks = cites.join(F.broadcast(looks(spark)), F.col("kind") == F.col("cite_kind"), "left").withColumn("ask", F.when(F.col("head"), head).when(F.col("kind") == "bibr-ay", F.lower("key")).otherwise(F.col("key")))
    exact = first_of(targets, ["kind", "scope", "key"], [F.col("pos")], ["target"]).select(F.col("kind").alias("_k"), F.col("scope").alias("_s"), F.col("key").alias("_y"), F.col("target").alias("_t"))
    once = targets.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("_n"), F.min("target").alias("_t")).where("_n = 1").select(F.col("kind").alias("_k"), F.col("key").alias("_y"), "_t")

    def lookup(rows: DataFrame, key, out: str) -> DataFrame:
        a = exact.withColumnRenamed("_t", f"{out}_e")
        b = once.withColumnRenamed("_t", f"{out}_u")
        rows = rows.withColumn("_ask", key)
        rows = rows.join(a, (F.col("target_kind") == F.col("_k")) & (F.col("scope") == F.col("_s")) & (F.col("_ask") == F.col("_y")), "left").drop("_k", "_s", "_y")
        rows = rows.join(b, (F.col("target_kind") == F.col("_k")) & (F.col("_ask") == F.col("_y")), "left").drop("_k", "_y")
        value = F.when(F.col("how") == "own", F.col(f"{out}_e")).when(F.col("how") == "any", F.col(f"{out}_u")).otherwise(F.coalesce(f"{out}_e", f"{out}_u"))
        return rows.withColumn(out, value).drop(f"{out}_e", f"{out}_u", "_ask")

    rows = lookup(lookup(lookup(asks, F.col("ask"), "full"), head, "begin"), tail, "finish")
    ranged = F.col("kind").isin("fig", "table", "box", "table-or-box") & F.contains("key", F.lit("-")) & F.col("finish").isNotNull()
    rows = rows.withColumn("rid", F.coalesce("full", F.when(ranged, F.col("begin"))))
    best = rows.groupBy(*[F.col(c) for c in cites.columns]).agg(F.min_by(F.struct("rid", "target_kind"), F.struct(F.col("rid").isNull(), "step")).alias("_b"))
    kind = F.when(F.col("_b.rid").isNotNull(), F.col("_b.target_kind"))
    ref_type = F.element_at(F.create_map(*[F.lit(x) for kv in REF_TYPE.items() for x in kv]), kind)
    status = F.when(F.col("_b.rid").isNotNull(), "resolved").otherwise("unresolved")
    severity = F.when(F.col("_b.rid").isNull() & ~F.col("kind").isin(*SILENT), F.when(F.col("kind").isin("fig", "table", "table-or-box"), "warning").otherwise("info"))
    return best.select(*cites.columns, F.col("_b.rid").alias("rid"), kind.alias("target_kind"), ref_type.alias("ref_type"), status.alias("status"), severity.alias("severity"))


def place(floats: DataFrame, cites: DataFrame) -> DataFrame:
    """floats (book, pre, last, part, kind, key) with anchor, slot and status.

    cites: (book, part, pre, seq, block, block_last, in_list, kind, key, ctx). The first citation in document order from
    running or boxed text, of the same part, that stands outside the float decides: the float goes after its block, or
    to the end of a list item's paragraph; floats of one block keep the order in which they stand. Without one it stays.
    """
    kind = F.when(F.col("kind") == "table-or-box", "table").otherwise(F.col("kind"))
    asks = cites.where("ctx in ('body', 'sidebar')").select(F.col("book").alias("_b"), F.col("part").alias("_part"), kind.alias("_kind"), F.col("key").alias("_key"), F.col("pre").alias("_pre"), "seq", "block", "block_last", "in_list")
    met = floats.join(asks, (F.col("book") == F.col("_b")) & (F.col("part") == F.col("_part")) & (F.col("kind") == F.col("_kind")) & (F.col("key") == F.col("_key")) & ~F.col("_pre").between(F.col("pre"), F.col("last")))
    first = met.groupBy(F.col("book").alias("_fb"), F.col("pre").alias("_fp")).agg(F.min_by(F.struct("block", "block_last", "in_list"), F.struct("_pre", "seq")).alias("_first"), F.count(F.lit(1)).alias("citations"))
    rows = floats.join(first, (F.col("book") == F.col("_fb")) & (F.col("pre") == F.col("_fp")), "left").drop("_fb", "_fp")
    inside = F.col("pre").between(F.col("_first.block"), F.col("_first.block_last"))
    rows = rows.withColumns({"anchor": F.when(F.col("_first").isNotNull(), F.col("_first.block")), "where": F.when(F.col("_first").isNull(), "physical").when(inside, "inside").when(F.col("_first.in_list"), "list-item").otherwise("after")})
    slot = F.row_number().over(Window.partitionBy("book", "anchor", "where").orderBy("pre")) - 1
    return rows.select(*floats.columns, F.coalesce("citations", F.lit(0)).alias("citations"), "anchor", "where", F.when(F.col("where") == "after", slot).alias("slot"), F.when(F.col("_first").isNull(), "NO_FIRST_CITATION").otherwise("PLACED").alias("status"))


def assign_ids(df: DataFrame) -> DataFrame:
    """df (book, part, pre, code, number) with xml_number and collision; numbers below a part and code, in document order.

    A code whose elements of a part are all labelled takes the label's number, unless an earlier one has it or has used
    it: then the next number after the largest so far. If one is unlabelled, all are numbered in order. The numbers of a
    part and code depend on all before, so a part's elements of a code are one group: as many as a chapter's figures.
    """
    import pandas as pd

    keys = ["book", "part", "code"]

    def number(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pre")
        labelled = group["number"].notna().all()
        used, most, out, hit = set(), 0, [], []
        for n in group["number"]:
            clash = False
            if labelled:
                n = int(n)
                clash = n in used
            if not labelled or clash:
                n = most + 1
                while n in used:
                    n += 1
            used.add(n)
            most = max(most, n)
            out.append(n)
            hit.append(clash)
        return group.assign(xml_number=out, collision=hit)

    kind = df.schema
    from pyspark.sql.types import BooleanType, LongType, StructField, StructType

    return df.groupBy(*keys).applyInPandas(number, StructType([*kind.fields, StructField("xml_number", LongType()), StructField("collision", BooleanType())]))
