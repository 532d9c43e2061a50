"""Evidence operators: the newest generation decides, what can't be read stays open, and every reason is named."""

from pyspark.sql import functions as F

from quantloom.operators import evidence as E

MIN = 60_000
NOW = 1_000 * MIN


def test_states_of_families(spark):
    families = spark.createDataFrame(
        [("unreadable", 0, False), ("stale", 0, True), ("live", 0, True), ("undecided", 0, True), ("decided", 0, True), ("closed", 0, True), ("unregistered", None, True), ("launching", NOW - 60 * MIN, True), ("abandoned", NOW - 61 * MIN, True)],
        "family string, created_t long, readable boolean",
    )
    attempts = spark.createDataFrame(
        [("unreadable", 1, "a", NOW, False), ("stale", 1, "a", NOW - 91 * MIN, False), ("live", 1, "a", NOW, True), ("live", 2, "b", NOW - 90 * MIN, False), ("undecided", 2, "a", NOW, True), ("decided", 1, "a", NOW, True), ("launching", 1, "a", None, False)],
        "family string, round long, run string, activity long, terminal boolean",
    )
    verdicts = spark.createDataFrame([("live", 1), ("undecided", 1), ("decided", 1), ("closed", 7), ("closed", 7)], "family string, round long")
    got = {r.family: (r.run, r.status, r.in_flight) for r in E.family_states(families, attempts, verdicts, F.lit(NOW)).collect()}
    assert len(got) == 9 and all(status == family for family, (_, status, _) in got.items())
    assert {f for f, (_, _, held) in got.items() if held} == {"unreadable", "live", "undecided", "unregistered", "launching"}
    assert got["live"][0] == "b" and got["launching"][0] is None and got["unreadable"][0] is None


def test_open_incidents(spark):
    line = lambda i, f, r="r1", a="x": f'{{"incident_id":"{i}","family_id":"{f}","round_id":"{r}","run_id":"{a}"}}'
    lines = [line(1, "won"), line(2, "f"), line(3, "f", a="clean"), line(4, "f", r="r2", a="clean"), line(4, "f", r="r2", a="clean"), '{"incident_id":"5"}', '{"incident_id":"6","family_id":""}', "[oops", "  ", "", None]
    got = E.open_incidents(spark.createDataFrame([(x,) for x in lines], "line string"), spark.createDataFrame([("won",)], "family string"), spark.createDataFrame([("f", "r1", "clean")], "family string, round string, run string"))
    assert sorted((r.incident or "", r.why) for r in got.collect()) == [("", "unparsable"), ("2", "unresolved"), ("4", "unresolved"), ("4", "unresolved"), ("5", "no family"), ("6", "no family")]


def test_progress_of_the_newest_attempt(spark):
    rows = [
        ("a", 1, "x", 5, 100, 90, None, None, None), ("a", 2, "y", 6, 100, 10, None, None, None), ("b", 1, "x", None, 100, 20, 1, 3, None), ("c", 1, "x", 1, 100, 20, 4, 3, None), ("d", 1, "x", 1, 100, 20, None, None, "DONE"),
        ("e", 1, "x", 1, 100, 20, None, None, "FAILED"), ("f", 1, "x", 1, None, 20, 1, 1, None), ("g", 1, "x", 1, 100, 120, None, None, None), ("h", 9, "x", None, 100, 1, None, None, None), ("h", 1, "x", 1, 100, 2, None, None, None),
    ]
    got = E.progress(spark.createDataFrame(rows, "family string, round long, run string, created long, total long, rows long, steps_done long, steps_total long, terminal string"))
    assert {r.family: (r.done, r.pct) for r in got.collect()} == {"a": (10, 10.0), "b": (33, 33.0), "c": (20, 20.0), "d": (100, 100.0), "e": (0, 0.0), "f": (20, 0.0), "g": (120, 100.0), "h": (2, 2.0)}


def test_cells_and_winners(spark):
    cells = spark.createDataFrame([("p", 1, "A", 5.0), ("p", 1, "N", 4.0), ("p", 2, "A", 5.0), ("p", 2, "N", 1.0), ("p", 2, "R", 0.0), ("q", 1, "N", 2.0), ("q", 1, "Z", 9.0)], "cohort string, size long, grid string, net_pnl double")
    assert sorted(tuple(r) for r in E.missing_grids(cells, ["cohort", "size"], ["R", "N", "A"]).collect()) == [("p", 1, "R"), ("q", 1, "A,R")]
    assert [tuple(r) for r in E.winners_in_grids(cells, "cohort", ["size"], "A", ["A", "N", "R"]).collect()] == [("p", 1, 2, 5.0, 4.0, None)]


def test_problems_of_slices(spark):
    slices = [("a", 1, 20, 30, "p", "b"), ("a", 2, 30, 20, "p", "b"), ("a", 3, 10, 11, "z", None), ("n", 4, 20, 30, "p", "b"), ("o", 5, 20, 30, "p", "b")]
    entries = spark.createDataFrame([("a", "p", "b", 10), ("n", "p", "b", None)], "survivor string, params string, bundle string, cutoff long")
    over = spark.createDataFrame([("a", 3), ("a", 3)], "survivor string, slice long")
    got = E.slice_problems(spark.createDataFrame(slices, "survivor string, slice long, start long, end long, params string, bundle string"), entries, over)
    assert {r.slice: r.problems for r in got.collect()} == {2: "dates", 3: "params,bundle,cutoff,overlap", 4: "cutoff", 5: "survivor"}


def test_funnel_prefers_published_totals(spark):
    families = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "family string, now long")
    attempts = spark.createDataFrame([("a", 1, 7), ("a", 2, None), ("b", 3, None)], "family string, run long, total long")
    rows = spark.createDataFrame([("a", 1, 95), ("a", 2, 90), ("a", 2, 91), ("a", 2, 101)], "family string, run long, t long")
    got = E.funnel(families, attempts, rows, F.col("now"), span=10)
    assert sorted(tuple(r) for r in got.collect()) == [("a", True, 10, 2), ("b", False, 0, 0), ("c", False, 0, 0)]
