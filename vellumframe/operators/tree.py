"""Trees as edge tables and as intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumframe.operators import ordered
from vellumframe.shared import written


def subtree_sums(df: DataFrame, node: str, parent: str, value: str, levels: int | None = None) -> DataFrame:
    """node, below, total: descendants and the sum of value over a node and them. One aggregate per level, from the leaves up,
    so an edge is moved once a level. levels: the depth below the root, if known; else rounds go on, each written, until no
    node gets more descendants. A tree that is deeper than said stops the job, and so does a cycle after as many rounds as
    there are nodes."""
    own = df.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.lit(0).cast("long").alias("below"), F.col(value).cast("double").alias("total"))

    def raised(base: DataFrame) -> DataFrame:
        up = base.where("parent is not null").groupBy("parent").agg(F.sum(F.col("below") + 1).alias("_below"), F.sum("total").alias("_total")).withColumnRenamed("parent", "_of")
        return own.join(up, F.col("node") == F.col("_of"), "left").select("node", "parent", F.coalesce("_below", F.lit(0).cast("long")).alias("below"), (F.col("total") + F.coalesce("_total", F.lit(0.0))).alias("total"))

    base = own
    if levels is not None:
        for _ in range(levels):
            base = raised(base)
        after = raised(base).select(F.col("node").alias("_node"), F.col("below").alias("_after"))
        deeper = F.raise_error(F.lit(f"the tree has more than {levels} levels below its root")).cast("long")
        return base.join(after, F.col("node") == F.col("_node")).select("node", F.when(F.col("below") == F.col("_after"), F.col("below")).otherwise(deeper).alias("below"), "total")
    before, most = -1, None
    while True:
        base = written(raised(base), "subtrees")
        seen = base.agg(F.sum("below").alias("below"), F.count(F.lit(1)).alias("n")).first()
        if (seen["below"] or 0) == before or not seen["n"]:
            return base.select("node", "below", "total")
        before, most = seen["below"], seen["n"] if most is None else most - 1
        if most < 0:
            raise ValueError("the edges have a cycle")


def same(keys: list[str], prefix: str):
    """Equality, nulls too, of keys and of columns whose names have the prefix."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return on


def _opened(nodes: DataFrame, ancestors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _order, _kind (0 a node, 1 an ancestor's beginning), _open: how many ancestors are open there.

    Beginnings and ends of ancestors and the nodes are put into one order, and a running sum counts what has begun and not
    ended. It runs over buckets of the order (ordered.py), so a document of any size is divided."""
    spans = ancestors.groupBy(*keys, "pre").agg(F.max("last").alias("last"))
    event = lambda df, order, kind, step: df.select(*keys, order.cast("long").alias("_order"), F.lit(kind).alias("_kind"), F.lit(step).cast("long").alias("_step"))
    events = event(nodes.select(*keys, "pre").distinct(), 2 * F.col("pre"), 0, 0).unionByName(event(spans, 2 * F.col("pre"), 1, 1)).unionByName(event(spans, 2 * F.col("last") + 1, 2, -1))
    placed = ordered.running_before(written(events, "events"), keys, "_order", "_step", "_open", "sum", ("_kind",))
    return placed.where("_kind < 2").select(*keys, "_order", "_kind", "_open")


def _met(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pre, ancestor of nodes at the levels they name: of the ancestors that begin at a level, the last one before a node
    is the one open there, since intervals nest. So a running maximum by level finds it."""
    rows = written(rows.withColumn("_begin", F.when(F.col("_kind") == 1, F.col("_order") / 2).cast("long")), "levels")
    found = ordered.running_before(rows, [*keys, "_level"], "_order", "_begin", "_at", "max", ("_kind",))
    return found.where("_kind = 0").select(*keys, (F.col("_order") / 2).cast("long").alias("pre"), F.col("_at").alias("ancestor"), "_level")


def around(nodes: DataFrame, ancestors: DataFrame, keys: list[str], name: str) -> DataFrame:
    """nodes with `name`: how many of the ancestors they are inside of. Intervals pre to last nest, as those of a tree do."""
    counted = _opened(nodes, ancestors, keys).where("_kind = 0").select(*[F.col(k).alias(f"_n_{k}") for k in keys], (F.col("_order") / 2).cast("long").alias("_n_pre"), F.col("_open").alias(name))
    return nodes.join(counted, same([*keys, "pre"], "_n_")).select(*nodes.columns, name)


def within(outer: DataFrame, inner: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of an ancestor and its descendants in one document: (keys, outer_pre, inner_pre). The cost goes with the nodes and the
    pairs, whatever the size of a document: a node meets the one ancestor of each level, not all of its document."""
    opened = _opened(inner, outer, keys)
    levels = F.when(F.col("_kind") == 1, F.array(F.col("_open") + 1)).when(F.col("_open") > 0, F.sequence(F.lit(1).cast("long"), F.col("_open")))
    pairs = _met(opened.withColumn("_level", F.explode(levels)), keys)
    return pairs.select(*keys, F.col("ancestor").alias("outer_pre"), F.col("pre").alias("inner_pre"))


def nearest_ancestor(nodes: DataFrame, ancestors: DataFrame, keys: list[str], count: str | None = None) -> DataFrame:
    """nodes with ancestor: the deepest of the given ancestors around each node, null without one; and how many there are, under
    the name of count. Two running passes over
    beginnings, ends and nodes; no node meets more than one ancestor."""
    level = F.when(F.col("_kind") == 1, F.col("_open") + 1).otherwise(F.col("_open"))
    pairs = _met(_opened(nodes, ancestors, keys).withColumn("_level", level).where("_level > 0"), keys)
    pairs = pairs.select(*[F.col(k).alias(f"_n_{k}") for k in keys], F.col("pre").alias("_n_pre"), "ancestor", F.col("_level").alias("_n_level"))
    more = [] if count is None else [F.coalesce("_n_level", F.lit(0).cast("long")).alias(count)]
    return nodes.join(pairs, same([*keys, "pre"], "_n_"), "left").select(*nodes.columns, "ancestor", *more)
