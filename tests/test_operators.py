"""Hand-made frames with known answers, prefix invariance and order independence."""

import math
import random

from pyspark.sql import functions as F

from quantloom.operators import joins as J
from quantloom.operators import orderstats as O
from quantloom.operators import portfolio as P
from quantloom.operators import quality as Q
from quantloom.operators import rolling as W
from quantloom.operators import scan as S
from quantloom.operators import statistics as T

H = 3_600_000


def series(spark, n=300, seed=1, symbols=("a", "b")):
    rng, rows = random.Random(seed), []
    for s in symbols:
        p = 100.0
        for i in range(n):
            p *= math.exp(rng.gauss(0, 0.01))
            rows.append((s, i * H, p, p * 1.01, p * 0.99, p * math.exp(rng.gauss(0, 0.002)), float(rng.randint(0, 9))))
    return spark.createDataFrame(rows, "symbol string, t long, open double, high double, low double, close double, volume double")


def test_ema_over_many_blocks_equals_loop(spark):
    rows = series(spark, 5000, symbols=("a",)).withColumn("close", F.when(F.col("t") % (7 * H) == 0, None).otherwise(F.col("close")))
    got = [r for r in S.ema(rows, "close", 0.1, "y").orderBy("t").collect()]
    y = None
    for r in got:
        if r.close is not None:
            y = r.close if y is None else 0.1 * r.close + 0.9 * y
        assert (r.y is None) == (y is None) and (y is None or abs(r.y - y) < 1e-9)


def test_bricks_equal_loop(spark):
    got = S.bricks(series(spark, 3000, symbols=("a",)), 0.01).orderBy("t").collect()
    k, first = 0, got[0].close
    for r in got:
        x = round(math.log(r.close / first) / math.log(1.01), 9)
        k = min(max(k, math.floor(x)), math.ceil(x))
        assert r.level == k


def test_hurdle_position_equals_loop(spark):
    rows = series(spark, 1000, symbols=("a",)).withColumn("f", (F.col("close") - F.col("open")) / F.col("open") * 100)
    p = 0
    for r in S.hurdle_position(rows, "f", 0.15, "p").orderBy("t").collect():
        g = (r.f > 0) - (r.f < 0)
        p = g if abs(r.f) > 0.15 * abs(g - p) else p
        assert r.p == p


def test_scan_of_empty_frame(spark):
    assert S.ema(series(spark, 3).where("false"), "close", 0.1, "y").count() == 0


def test_asof_sides(spark):
    bars = spark.createDataFrame([("a", 0), ("a", 10), ("a", 20)], "symbol string, t long")
    events = spark.createDataFrame([("a", 10), ("a", 15), ("a", -1)], "symbol string, e long")
    at = lambda strict: {r.e: r.matched_at for r in J.asof(events, bars, key="symbol", left_time="e", right_time="t", values=[], strict=strict).collect()}
    assert at(True) == {10: 0, 15: 10, -1: None}
    assert at(False) == {10: 10, 15: 10, -1: None}
    nxt = {r.e: r.next_at for r in J.next_row(events, bars, key="symbol", left_time="e", right_time="t", values=[]).collect()}
    assert nxt == {10: 20, 15: 20, -1: 0}


def test_prefix_invariance_of_window_features(spark):
    rows, cut = series(spark, 120), 80 * H
    for make in (
        lambda d: d.withColumn("x", W.sma(F.col("close"), 10)), lambda d: d.withColumn("x", W.trailing_beta(F.col("close"), F.col("open"), 20, 8)),
        lambda d: d.withColumn("x", W.rank_in_rows(F.col("close"), 12)), lambda d: S.ema(d, "close", 0.2, "x"), lambda d: S.rsi(d, 14, "x"),
        lambda d: O.expanding_rank(d, "close", block=16).withColumnRenamed("expanding_rank", "x"),
    ):
        assert all(r.n_moved == 0 for r in Q.look_ahead_probe(rows, make, cut).collect())


def test_look_ahead_is_caught(spark):
    leak = lambda d: d.withColumn("x", F.lead("close").over(__import__("quantloom.functions.expr", fromlist=["over"]).over()))
    assert any(r.n_moved for r in Q.look_ahead_probe(series(spark, 50), leak, 40 * H).collect())


def test_non_overlap(spark):
    e = spark.createDataFrame([("a", 0, 10), ("a", 5, 15), ("a", 10, 20), ("a", 19, 29), ("a", 20, 30)], "symbol string, entry_t long, exit_t long")
    assert sorted(r.entry_t for r in P.non_overlapping(e).collect()) == [0, 10, 20]


def test_gap_report(spark):
    b = spark.createDataFrame([("a", 0, 1.0), ("a", H, 0.0), ("a", 3 * H, 1.0), ("a", 7 * H, 1.0)], "symbol string, t long, volume double")
    r = Q.gap_report(b, H).first()
    assert (r.n, r.gaps, r.missing, r.zero_volume, r.expected) == (4, 2, 4, 1, 8)


def test_auroc_ties_and_missing_class(spark):
    x = spark.createDataFrame([(1, 2.0), (0, 2.0), (1, 3.0), (0, 1.0)], "y int, s double")
    assert T.auroc(x, "y", "s").first().auroc == 0.875
    assert T.auroc(x.where("y = 1"), "y", "s").first().auroc is None


def test_overlaps_include_ends(spark):
    s = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 20), (1, 3, 21, 31), (2, 4, 0, 10)], "o int, n int, start long, end long")
    assert {(r.n, r.overlaps) for r in Q.overlaps(s, "o", "n", max_length=10).collect()} == {(1, 1), (2, 1)}


def test_bars_do_not_depend_on_row_order(spark):
    from quantloom.operators.bars import bars_from_ticks

    rows = [("a", i * 1000, i, float(i % 7), 1.0) for i in range(200)]
    make = lambda r: sorted(map(tuple, bars_from_ticks(spark.createDataFrame(r, "symbol string, us long, seq long, price double, qty double"), 50).collect()))
    shuffled = rows[:]
    random.Random(3).shuffle(shuffled)
    assert make(rows) == make(shuffled)


def test_tampered_ledger_is_reported(spark):
    from quantloom.operators.evidence import reconcile

    e = spark.createDataFrame([(1, "x", 1.0, 1), (2, "x", 2.0, 1)], "episode long, symbol string, fees double, n_fills long")
    f = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, 9.0)], "episode long, fee double")
    got = {r.symbol: (r.differ, r.orphans) for r in reconcile(e, f).collect()}
    assert got == {"x": (1, 0), None: (0, 1)}


def test_folds_cover_all_months(spark):
    from quantloom.operators.models import folds_to_end
    from quantloom.plans.statistics import _folds

    for n in (48, 60, 61, 80, 200):
        tested = [m for a, b, c in folds_to_end(5, 4 + n, 48, 12) for m in range(b, c)]
        assert tested == list(range(53, 5 + n))
    assert folds_to_end(0, 71, 60, 6, expanding=True) == [(0, 60, 66), (0, 66, 72)]
    months = spark.range(80).select(F.col("id").cast("int").alias("month"))
    assert _folds(months) == [(0, 48, 60), (12, 60, 72), (24, 72, 80)] and _folds(months.where("false")) == []


def test_transfer_reads_every_symbol(spark, sf):
    from quantloom import registry

    got = registry.queries()["ml_07_cross_symbol_transfer"](spark, sf).collect()
    names = {r.to_symbol for r in got}
    assert all(r.n > 50 and 0 <= r.rank_ic <= 1 and 0 <= r.hit_rate <= 1 for r in got)
    assert len(names) == 5 and {(r.from_symbol, r.to_symbol) for r in got} == {(a, b) for a in names for b in names if a != b}
