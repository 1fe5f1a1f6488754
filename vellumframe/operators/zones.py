"""Edits of zones: a table of which zone owns which line, and a log of edits that is applied to it.

owners: (book, uid, page, ord, zid, kind, level); zones: (book, zid, parent, pos, kind, level). An edit gives a new table. What it
changed is appended to a log under the edit's number, and so are undo and redo, as moves of a cursor: any version is the
latest change of each row by the edits that stand then (standing, as_of).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumframe.operators import ordered, tree
from vellumframe.shared import written

#: How many edits can be undone; kinds that hold a flow, and what may follow a section in one.
DEPTH = 60
FLOWS, AFTER_SECTIONS = ("body", "named-book-part-body", "sec", "boxed-text", "back", "app"), ("notes", "fn-group", "glossary", "ref-list", "sig-block", "sec")


def retag(owners: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: (book, zid, new_kind, new_level). Zones get another kind, and a level if one is named."""
    met = owners.join(edits, ["book", "zid"], "left")
    return met.select("book", "uid", "page", "ord", "zid", F.coalesce("new_kind", "kind").alias("kind"), F.coalesce("new_level", "level").alias("level"))


def merge(owners: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: (book, zid, into): lines of zid go to another zone, whose kind and level they take."""
    first = owners.groupBy("book", F.col("zid").alias("into")).agg(F.min_by("kind", "ord").alias("_kind"), F.min_by("level", "ord").alias("_level"))
    moves = edits.join(first, ["book", "into"])
    met = owners.join(moves, ["book", "zid"], "left")
    return met.select("book", "uid", "page", "ord", F.coalesce("into", "zid").alias("zid"), F.coalesce("_kind", "kind").alias("kind"), F.when(F.col("into").isNotNull(), F.col("_level")).otherwise(F.col("level")).alias("level"))


def split(owners: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: (book, zid, at_uid, new_zid): lines from at_uid on make a new zone; a split at the first line changes nothing.
    The new part of a section is a paragraph."""
    at = owners.select("book", "zid", F.col("uid").alias("at_uid"), F.col("ord").alias("_at"))
    begin = owners.groupBy("book", "zid").agg(F.min("ord").alias("_begin"))
    cuts = edits.join(at, ["book", "zid", "at_uid"]).join(begin, ["book", "zid"]).where("_at > _begin").select("book", "zid", "new_zid", "_at")
    met = owners.join(cuts, ["book", "zid"], "left")
    moved = F.col("_at").isNotNull() & (F.col("ord") >= F.col("_at"))
    return met.select("book", "uid", "page", "ord", F.when(moved, F.col("new_zid")).otherwise(F.col("zid")).alias("zid"), F.when(moved & (F.col("kind") == "sec"), "p").otherwise(F.col("kind")).alias("kind"), F.when(moved & (F.col("kind") == "sec"), F.lit(None)).otherwise(F.col("level")).alias("level"))


def delete(owners: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: (book, zid): their lines have no owner."""
    return owners.join(edits, ["book", "zid"], "left_anti")


def unowned(lines: DataFrame, owners: DataFrame) -> DataFrame:
    return lines.join(owners.select("book", "uid"), ["book", "uid"], "left_anti")


def renest(sections: DataFrame) -> DataFrame:
    """sections (book, zid, ord, level) with parent: the last earlier section of a smaller level, null for none. A null level is 1.

    Levels are those of the data, however many: a section asks, for each smaller level of its book, for the last section of
    that level before it, and takes the latest. Each is a running maximum over buckets, so a book of any length is divided."""
    own = written(sections.select("book", "zid", F.col("ord").cast("long").alias("ord"), F.coalesce("level", F.lit(1)).cast("long").alias("level")), "sections")
    levels = own.groupBy("book").agg(F.array_sort(F.collect_set("level")).alias("_all")).select(F.col("book").alias("_book"), "_all")
    asks = own.join(levels, F.col("book").eqNullSafe(F.col("_book"))).select("book", "ord", F.explode(F.filter("_all", lambda n: n < F.col("level"))).alias("_level"), F.lit(None).cast("long").alias("_at"), F.lit(0).alias("_kind"))
    there = own.select("book", "ord", F.col("level").alias("_level"), F.col("ord").alias("_at"), F.lit(1).alias("_kind"))
    found = ordered.running_before(written(asks.unionByName(there), "levels"), ["book", "_level"], "ord", "_at", "_last", "max", ("_kind",)).where("_kind = 0")
    last = found.groupBy(F.col("book").alias("_b"), F.col("ord").alias("_o")).agg(F.max("_last").alias("_last"))
    named = own.select(F.col("book").alias("_nb"), F.col("ord").alias("_no"), F.col("zid").alias("parent"))
    met = sections.join(last, F.col("book").eqNullSafe(F.col("_b")) & (F.col("ord") == F.col("_o")), "left").join(named, F.col("book").eqNullSafe(F.col("_nb")) & (F.col("_last") == F.col("_no")), "left")
    return met.select(*sections.columns, "parent")


def reflow(flow: DataFrame) -> DataFrame:
    """flow (book, zid, ord, kind, level) with parent: sections nest by level, and a block belongs to the last section before it."""
    nested = renest(flow.where("kind = 'sec'").select("book", "zid", "ord", "level")).select(F.col("book").alias("_sb"), F.col("zid").alias("_sz"), F.col("parent").alias("_section"))
    rows = flow.withColumn("ord", F.col("ord").cast("long")).withColumn("_sec", F.when(F.col("kind") == "sec", F.struct("ord", "zid")))
    placed = ordered.running_before(written(rows, "flow"), ["book"], "ord", "_sec", "_before", "max")
    met = placed.join(nested, F.col("book").eqNullSafe(F.col("_sb")) & (F.col("zid") == F.col("_sz")) & (F.col("kind") == "sec"), "left")
    return met.select(*flow.columns, F.when(F.col("kind") == "sec", F.col("_section")).otherwise(F.col("_before.zid")).alias("parent"))


def misplaced(zones: DataFrame) -> DataFrame:
    """book, parent: flows in which a block that may not stands after a section; normalize nests these anew."""
    kinds = zones.select(F.col("book").alias("_b"), F.col("zid").alias("_z"), F.col("kind").alias("_holds"))
    kids = zones.join(kinds, F.col("book").eqNullSafe(F.col("_b")) & (F.col("parent") == F.col("_z"))).where(F.col("_holds").isin(*FLOWS))
    ends = kids.groupBy("book", "parent").agg(F.min(F.when(F.col("kind") == "sec", F.col("pos"))).alias("_first"), F.max(F.when(~F.col("kind").isin(*AFTER_SECTIONS), F.col("pos"))).alias("_last"))
    return ends.where("_last > _first").select("book", "parent")


def normalize(zones: DataFrame) -> DataFrame:
    """zones in which blocks after a section of a misplaced flow belong to that section, behind what it holds. Sections in a flow
    keep their place; one pass mends each flow, and what it moved has no flow of its own."""
    bad = misplaced(zones).select(F.col("book").alias("_b"), F.col("parent").alias("_p"), F.lit(True).alias("_bad"))
    rows = zones.join(bad, F.col("book").eqNullSafe(F.col("_b")) & (F.col("parent") == F.col("_p")), "left").drop("_b", "_p")
    before = Window.partitionBy("book", "parent").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # children of one element
    rows = rows.withColumn("_to", F.when(F.col("_bad") & ~F.col("kind").isin(*AFTER_SECTIONS), F.last(F.when(F.col("kind") == "sec", F.col("zid")), ignorenulls=True).over(before)))
    return _numbered(rows.select("book", "zid", F.coalesce("_to", "parent").alias("parent"), "kind", "level", F.struct(F.col("_to").isNotNull().cast("int").alias("a"), F.col("pos").alias("b"), F.lit(0).cast("long").alias("c")).alias("_at")))


def _numbered(rows: DataFrame) -> DataFrame:
    """zones whose children stand by _at, numbered from 0."""
    pos = F.row_number().over(Window.partitionBy("book", "parent").orderBy("_at", "zid")) - 1  # children of one element
    return rows.withColumn("pos", pos.cast("long")).select("book", "zid", "parent", "pos", "kind", "level")


def _place(a: Column, b: Column | None = None, c: Column | None = None) -> Column:
    return F.struct(a.cast("int").alias("a"), (F.lit(0) if b is None else b).cast("long").alias("b"), (F.lit(0) if c is None else c).cast("long").alias("c"))


def set_level(zones: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: (book, zid, new_level)."""
    met = zones.join(edits, ["book", "zid"], "left")
    return met.select("book", "zid", "parent", "pos", "kind", F.coalesce("new_level", "level").alias("level"))


def wrap(zones: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: (book, zid, into, new_kind): zones of one parent become children of a new zone `into`, which stands where the first
    of them did. Those whose parent isn't that of the first stay."""
    met = zones.join(edits, ["book", "zid"], "left")
    first = met.where("into is not null").groupBy(F.col("book").alias("_b"), F.col("into").alias("_into")).agg(F.min_by(F.struct("parent", "pos", "new_kind"), F.struct("pos", "zid")).alias("_f"))
    met = met.join(first, F.col("book").eqNullSafe(F.col("_b")) & (F.col("into") == F.col("_into")), "left")
    goes = F.col("into").isNotNull() & F.col("parent").eqNullSafe(F.col("_f.parent"))
    kids = met.select("book", "zid", F.when(goes, F.col("into")).otherwise(F.col("parent")).alias("parent"), "kind", "level", _place(F.lit(0), F.col("pos")).alias("_at"))
    made = first.select(F.col("_b").alias("book"), F.col("_into").alias("zid"), F.col("_f.parent").alias("parent"), F.col("_f.new_kind").alias("kind"), F.lit(None).cast(zones.schema["level"].dataType).alias("level"), _place(F.lit(0), F.col("_f.pos")).alias("_at"))
    return _numbered(kids.unionByName(made))


def unwrap(zones: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: (book, zid): the children of a zone take its place, and it goes. Of a zone in another that goes too, the inner one's
    children come up by one edit at a time."""
    gone = zones.join(edits, ["book", "zid"], "left_semi").select(F.col("book").alias("_b"), F.col("zid").alias("_z"), F.col("parent").alias("_up"), F.col("pos").alias("_pos"))
    met = zones.join(edits, ["book", "zid"], "left_anti").join(gone, F.col("book").eqNullSafe(F.col("_b")) & (F.col("parent") == F.col("_z")), "left")
    up = F.col("_z").isNotNull()
    at = F.when(up, _place(F.lit(0), F.col("_pos"), F.col("pos"))).otherwise(_place(F.lit(0), F.col("pos")))
    return _numbered(met.select("book", "zid", F.when(up, F.col("_up")).otherwise(F.col("parent")).alias("parent"), "kind", "level", at.alias("_at")))


def move(zones: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: (book, zid, to, after): a zone becomes a child of another, behind its child at `after` (-1: the first). Edits that would
    put a zone into itself or below itself change nothing; what is above is found by one join a level."""
    up = zones.select(F.col("book").alias("_b"), F.col("zid").alias("_z"), F.col("parent").alias("_up"))
    asked, bad = written(edits.select("book", "zid", F.col("to").alias("_now")), "moves"), None
    while True:
        met = asked.where(F.col("zid") == F.col("_now")).select("book", "zid")
        bad = met if bad is None else bad.union(met)
        asked = written(asked.where(F.col("zid") != F.col("_now")).join(up, F.col("book").eqNullSafe(F.col("_b")) & (F.col("_now") == F.col("_z"))).where("_up is not null").select("book", "zid", F.col("_up").alias("_now")), "moves")
        if asked.isEmpty():
            break
    good = edits.join(bad.distinct(), ["book", "zid"], "left_anti")
    met = zones.join(good, ["book", "zid"], "left")
    at = F.when(F.col("to").isNotNull(), _place(F.lit(0), F.col("after"), F.lit(1))).otherwise(_place(F.lit(0), F.col("pos")))
    return _numbered(met.select("book", "zid", F.coalesce("to", "parent").alias("parent"), "kind", "level", at.alias("_at")))


def changed(before: DataFrame, after: DataFrame, keys: list[str], seq: int) -> DataFrame:
    """What an edit adds to the log: seq, keys, gone, state (the row) of rows that are new, other or gone."""
    state = F.struct(*[c for c in after.columns if c not in keys])
    old = before.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.struct(*[c for c in after.columns if c not in keys]).alias("_old"), F.lit(True).alias("_was"))
    met = after.select(*keys, state.alias("state"), F.lit(True).alias("_is")).join(old, tree.same(keys, "_o_"), "full").where("_is is null or _was is null or not (state <=> _old)")
    key = [F.when(F.col("_is"), F.col(k)).otherwise(F.col(f"_o_{k}")).alias(k) for k in keys]
    return met.select(F.lit(seq).cast("long").alias("seq"), *key, F.col("_is").isNull().alias("gone"), "state")


def standing(actions: DataFrame, at: int | None = None, depth: int = DEPTH) -> DataFrame:
    """book, edit: the edits that stand after the actions (book, seq, action) up to `at`. An undo takes back the last edit of the
    last `depth` that stand, a redo brings back what was undone last, and an edit forgets what could be redone.

    A book's actions are what people did in it; they are folded, and carry numbers alone."""
    rows = actions if at is None else actions.where(F.col("seq") <= at)
    held = rows.groupBy("book").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "action"))).alias("_all"))
    shape = "struct<old:array<bigint>,undo:array<bigint>,redo:array<bigint>>"
    state = lambda old, undo, redo: F.struct(old.alias("old"), undo.alias("undo"), redo.alias("redo"))
    none = F.array().cast("array<bigint>")

    def step(s: Column, a: Column) -> Column:
        grown = F.array_append(s["undo"], a["seq"])
        over = F.greatest(F.size(grown) - depth, F.lit(0))
        edit = state(F.concat(s["old"], F.slice(grown, F.lit(1), over)), F.slice(grown, over + 1, F.lit(depth)), none)
        back = lambda x: F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0)))
        undo = state(s["old"], back(s["undo"]), F.array_append(s["redo"], F.try_element_at(s["undo"], F.lit(-1))))
        redo = state(s["old"], F.array_append(s["undo"], F.try_element_at(s["redo"], F.lit(-1))), back(s["redo"]))
        return F.when(a["action"] == "edit", edit).when((a["action"] == "undo") & (F.size(s["undo"]) > 0), undo).when((a["action"] == "redo") & (F.size(s["redo"]) > 0), redo).otherwise(s)

    folded = held.select("book", F.aggregate("_all", state(none, none, none).cast(shape), step).alias("_s"))
    return folded.select("book", F.explode(F.concat("_s.old", "_s.undo")).alias("edit"))


def as_of(base: DataFrame, changes: DataFrame, actions: DataFrame, keys: list[str], at: int | None = None, depth: int = DEPTH) -> DataFrame:
    """base with the changes (seq, keys, gone, state) of the edits that stand after the actions up to `at`: of each row the latest.
    One aggregate over base and log; rows that are gone are left out."""
    names = [c for c in base.columns if c not in keys]
    stand = standing(actions, at, depth).select(F.col("book").alias("_b"), F.col("edit").alias("_e"))
    kept = changes.join(stand, F.col("book").eqNullSafe(F.col("_b")) & (F.col("seq") == F.col("_e")), "left_semi")
    first = base.select(F.lit(None).cast("long").alias("seq"), *keys, F.lit(False).alias("gone"), F.struct(*names).alias("state"))
    last = F.max_by(F.struct("gone", "state"), F.struct(F.col("seq").isNotNull(), "seq"))
    latest = first.unionByName(kept.select("seq", *keys, "gone", "state")).groupBy(*keys).agg(last.alias("_l"))
    return latest.where("not _l.gone").select(*keys, *[F.col(f"_l.state.{n}").alias(n) for n in names])


def boxes(lines: DataFrame) -> DataFrame:
    """book, zid, page, run, x0, y0, x1, y1: boxes around a zone's lines, a new one where a page or column ends or a gap is
    over three line heights. lines: (book, zid, page, ord, bbox)."""
    order = Window.partitionBy("book", "zid").orderBy("ord")
    prev = F.lag(F.struct("page", "bbox")).over(order)
    rows = lines.withColumn("_prev", prev)
    height = F.col("bbox.y1") - F.col("bbox.y0")
    new = F.col("_prev").isNull() | (F.col("_prev.page") != F.col("page")) | (F.col("bbox.y0") < F.col("_prev.bbox.y0") - height) | (F.col("bbox.y0") - F.col("_prev.bbox.y1") > 3 * height)
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return rows.groupBy("book", "zid", "page", "run").agg(F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"))


def flagged(zones: DataFrame, least: float = 0.75) -> DataFrame:
    """Zones (flags, conf, reviewed, page, zid) to look at."""
    return zones.where(~F.col("reviewed") & ((F.size("flags") > 0) | (F.col("conf") < least))).orderBy("page", "zid")
