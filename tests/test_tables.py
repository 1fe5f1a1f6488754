"""Rules, stacks, grids and lines below captions."""

from __future__ import annotations

from vellumframe.operators import tables as TB

BOX = "x0 double, y0 double, x1 double, y1 double"


def got(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_rules_and_stacks(spark):
    seg = lambda page, x0, y, x1: (page, x0, y - 0.2, x1, y + 0.2, True, "l")
    rows = [seg(1, 50.0, 100.0, 120.0), seg(1, 122.0, 100.3, 200.0), seg(1, 210.0, 100.0, 300.0), seg(1, 50.0, 160.0, 200.0), seg(1, 51.0, 220.0, 201.0), seg(1, 50.0, 350.0, 200.0), (1, 50.0, 400.0, 200.0, 440.0, False, "re"), (1, 50.0, 500.0, 55.0, 501.0, False, "re"), (2, 0.0, 0.0, 9.0, 0.0, None, None)]
    df = spark.createDataFrame(rows, f"page int, {BOX}, hline boolean, kinds string")
    ruled = TB.rules(df, ["page"])
    assert got(ruled.where("page = 1"), "x0", "x1", "y") == [(50.0, 200.0, 100.0), (50.0, 200.0, 160.0), (50.0, 200.0, 350.0), (50.0, 200.0, 400.0), (50.0, 200.0, 440.0), (51.0, 201.0, 220.0), (210.0, 300.0, 100.0)]
    assert ruled.where("page = 2").count() == 0
    found = TB.stacks(ruled, ["page"])
    assert got(found, "stack", "x0", "y0", "x1", "y1", "n") == [(0, 50.0, 99.5, 200.0, 220.5, 3), (1, 50.0, 349.5, 200.0, 440.5, 3)]
    area = spark.createDataFrame([(1, 7, 50.0, 90.0, 200.0, 230.0), (1, 8, 0.0, 0.0, 9.0, 9.0)], f"page int, area int, {BOX}")
    assert got(TB.rules_within(ruled, area, ["page"], "area"), "area", "ys") == [(7, [100.0, 160.0, 220.0]), (8, [])]
    lines = [(1, 52.0 + 80 * c, 110.0 + 20 * r, 90.0 + 80 * c, 120.0 + 20 * r) for r in range(3) for c in range(2)] + [(1, 52.0, 360.0 + 15 * r, 190.0, 370.0 + 15 * r) for r in range(5)]
    ldf, none = spark.createDataFrame(lines, f"page int, {BOX}"), spark.createDataFrame([], f"page int, {BOX}")
    assert got(TB.ruled_regions(ruled, ldf, none, ["page"], 10.0), "stack") == [(0,)]  # the second's lines leave no gap
    taken = spark.createDataFrame([(1, 190.0, 200.0, 260.0, 210.0)], f"page int, {BOX}")
    assert TB.ruled_regions(ruled, ldf, taken, ["page"], 10.0).count() == 0
    assert TB.ruled_regions(TB.rules(df.limit(0), ["page"]), ldf, none, ["page"], 10.0).count() == 0


def test_lines_below(spark):
    line = lambda cap, i, y, text, x1=150.0, size=10.0, like=False: (cap, i, 50.0, y, x1, y + 10, size, text, like)
    rows = [line(1, 0, 100.0, "cell"), line(1, 1, 120.0, "cell two", like=True, x1=300.0), line(1, 2, 160.0, "Source: us"), line(1, 3, 172.0, "goes on", size=10.2), line(1, 4, 190.0, "Running text again", x1=300.0, size=12.0, like=True), line(1, 5, 200.0, "Note after the end"),
            line(2, 0, 100.0, "wide first", x1=300.0, like=True), line(2, 1, 112.0, "cell"), line(2, 2, 130.0, "text resumes here", x1=300.0, like=True), line(2, 3, 140.0, "cell after"), line(3, 0, 20.0, "above")]
    ldf = spark.createDataFrame([(r[0], *r[1:]) for r in rows], f"page int, ord int, {BOX}, size double, text string, like_body boolean")
    ruled = spark.createDataFrame([(1, 50.0, 300.0, 95.0), (1, 50.0, 300.0, 150.0), (2, 50.0, 300.0, 95.0)], "page int, x0 double, x1 double, y double")
    caps = spark.createDataFrame([(p, 0, 90.0, 500.0, 50.0, 300.0) for p in (1, 2, 3)], "page int, caption int, bottom double, stop_y double, x0 double, x1 double")
    found = TB.lines_below(caps, ldf, ruled, ["page"], 10.0)
    assert got(found, "page", "ord", "part") == [(1, 0, "body"), (1, 1, "body"), (1, 2, "foot"), (1, 3, "foot"), (2, 0, "body"), (2, 1, "body")]


def cells(spark, lines, ys=()):
    """lines: (x0, y0, text[, width[, bold]])."""
    rows = [(1, i, float(x), float(y), float(x + (r[0] if r else 60)), float(y + 10), 10.0, t, len(r) > 1, 12.0) for i, (x, y, t, *r) in enumerate(lines)]
    df = spark.createDataFrame(rows, f"t int, ord int, {BOX}, size double, text string, bold boolean, pitch double")
    return sorted(TB.grids(df, spark.createDataFrame([(1, float(y)) for y in ys], "t int, y double"), ["t"]).collect(), key=lambda c: (c["row"], c["col"]))


def test_grid(spark):
    lines = [(0, 0, "Name", 60, True), (100, 0, "Dose", 60, True), (0, 20, "Alpha"), (100, 20, "1 mg"), (0, 40, "Beta"), (100, 40, "2 mg and"), (100, 51, "more")]
    made = cells(spark, lines)
    assert [(c["row"], c["col"], c["text"], c["header"]) for c in made] == [(0, 0, "Name", True), (0, 1, "Dose", True), (1, 0, "Alpha", False), (1, 1, "1 mg", False), (2, 0, "Beta", False), (2, 1, "2 mg and more", False)]
    assert {(c["ncols"], c["header_rows"], c["conf"]) for c in made} == {(2, 1, 0.95)}
    ruled = cells(spark, lines, [35])
    assert sum(c["header"] for c in ruled) == 4
    one = cells(spark, [(0, 0, "one"), (0, 12, "two")])
    assert [(c["text"], c["ncols"], c["conf"], c["issues"]) for c in one] == [("one two", 1, 0.7, ["SINGLE_COLUMN"])]
    assert cells(spark, [(0, 0, "alone")]) == []


def test_grid_wraps_and_spans(spark):
    # A band that hangs in its columns and goes on small is no row, though it begins in the first column.
    hung = cells(spark, [(0, 0, "Size of the"), (100, 0, "1 mg"), (8, 11, "unit here", 40), (0, 22, "Next"), (100, 22, "2 mg"), (0, 33, "Last"), (100, 33, "3 mg")])
    assert [c["text"] for c in hung] == ["Size of the unit here", "1 mg", "Next", "2 mg", "Last", "3 mg"]
    # A title across both columns hides the gap; without the widest eighth it shows. The title spans two columns.
    wide = cells(spark, [(0, 0, "A title over all of it", 160), (0, 20, "a"), (100, 20, "b"), (0, 40, "c"), (100, 40, "d")])
    assert [(c["row"], c["col"], c["colspan"]) for c in wide] == [(0, 0, 2), (1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 1, 1)]
    sparse = cells(spark, [(0, 0, "a"), (100, 20, "b"), (200, 40, "c"), (300, 60, "d")])
    assert {tuple(c["issues"]) for c in sparse} == {("SPARSE_TABLE",)}


def test_continued(spark):
    rows = [
        ("b", 0, "1", 3, False, 2, 1, 3), ("b", 1, "1", 4, False, 2, 1, 4), ("b", 2, "1", 5, False, 2, 1, 2), ("b", 3, "1", 5, True, 3, 1, 2), ("b", 4, "1", 9, True, 2, 1, 2),
        ("b", 5, "2", 1, None, None, None, None), ("b", 6, "2", 2, None, 3, 1, 2), ("b", 7, None, 3, True, 2, 0, 1), ("b", 8, None, 4, True, 2, 0, 1), (None, 9, "1", 6, False, 2, 5, 1), (None, 10, "1", 7, False, 2, 5, 1),
    ]
    df = spark.createDataFrame(rows, "book string, at long, key string, page int, continued boolean, ncols int, header_rows int, n_rows int")
    linked = TB.continued(df, ["book"])
    assert got(linked, "at", "head", "first_row", "dropped", "taken") == [
        (0, 0, 0, 0, 3), (1, 0, 3, 1, 3), (2, 2, 0, 0, 2), (3, 2, 2, 0, 0), (4, 2, 2, 1, 1), (5, 5, 0, 0, 0), (6, 5, 0, 0, 2), (7, 7, 0, 0, 1), (8, 8, 0, 0, 1), (9, 9, 0, 0, 1), (10, 9, 1, 1, 0),
    ]
    cells = spark.createDataFrame([(b, at, r, f"{at}.{r}") for b, at, *_, n in rows for r in range(n or 0)], "book string, at long, row int, text string")
    made = TB.merge_rows(cells, linked, ["book"])
    assert got(made.where("head = 0"), "new_row", "text") == [(0, "0.0"), (1, "0.1"), (2, "0.2"), (3, "1.1"), (4, "1.2"), (5, "1.3")]
    assert got(made.where("head = 2"), "new_row", "text") == [(0, "2.0"), (1, "2.1"), (2, "4.1")] and got(made.where("head = 5"), "new_row", "text") == [(0, "6.0"), (1, "6.1")]
    assert TB.continued(df.limit(0), ["book"]).count() == 0


def test_continued_against_a_fold(spark):
    """Random tables of few pages, held against one that goes through them in order."""
    import random

    r, rows, want = random.Random(5), [], []
    for book in range(60):
        page, state = 0, {}
        for at in range(40):
            page = r.choice([page, page, page + 1, page + 1, page + 2, 0])
            t = (book, at, r.choice(["a", "b", None]), r.choice([page] * 9 + [None]), r.choice([True, False, False, False, None]))
            rows.append(t)
            key = t[2] if t[2] is not None else f"alone {at}"
            head = state.get(key)
            if head and (t[4] or (t[3] is not None and head[1] is not None and t[3] == head[1] + 1)):
                want.append((book, at, head[0]))
            else:
                state[key] = (at, t[3])
                want.append((book, at, at))
    df = spark.createDataFrame([(*t, 1, 0, 1) for t in rows], "book int, at long, key string, page int, continued boolean, ncols int, header_rows int, n_rows int")
    assert got(TB.continued(df, ["book"]), "book", "at", "head") == sorted(want)


def test_continued_many_of_one_key(spark):
    """40,000 tables of one label: with a list of all of them copied at each step this takes minutes."""
    import time

    df = spark.range(40_000).selectExpr("1 AS book", "id AS at", "'k' AS key", "id div 3 AS page", "false AS continued", "2 AS ncols", "0 AS header_rows", "1L AS n_rows")
    began = time.time()
    linked = TB.continued(df, ["book"])
    assert linked.where("at = head").count() == 20_001 and linked.where("first_row > 0").count() == 19_999 and time.time() - began < 60


def test_rules_move_segments_once(spark):
    """Repeated segments are left out where they are sorted: no exchange of their own, and no sort for the last aggregate."""
    rows = [(1, 0.0, 10.0, 50.0, 10.4, True, "l")] * 3 + [(1, 60.0, 10.0, 40.0, 10.4, True, "l")] * 2
    df = spark.createDataFrame(rows, f"page int, {BOX}, hline boolean, kinds string")
    ruled = TB.rules(df, ["page"])
    assert got(ruled, "x0", "x1", "y") == [(0.0, 50.0, 10.2), (60.0, 40.0, 10.2)]
    plan = ruled._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert plan.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in plan
