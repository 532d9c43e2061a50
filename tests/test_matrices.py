"""Vector scans and the panel network: twins over histories longer than the warm-ups, loops, causality."""

import math

import pytest
from pyspark.sql import functions as F

from quantloom import registry
from quantloom.operators import scan as S
from quantloom.operators.xsection import network_momentum

from .oracle import differences
from .test_operators import H, series


@pytest.mark.parametrize("name", ["rec_07_whole_matrix", "rec_12_six_speeds", "sig_15_panel_network"])
def test_twins_past_the_warm_up(spark, name):
    f = registry.queries()[name]
    last = {"rec_07_whole_matrix": "macd_168", "rec_12_six_speeds": "osc_6", "sig_15_panel_network": "score"}[name]
    assert f(spark, "/root/testdata/sf0.01").where(F.col(last).isNotNull()).count() > 1000
    assert differences(spark, f, registry.oracle_sql()[name], "/root/testdata/sf0.01") is None


def test_vector_scan_equals_loop_over_blocks(spark):
    rows = series(spark, 700, symbols=("a",)).withColumn("close", F.when(F.col("t") % (7 * H) == 0, None).otherwise(F.col("close")))
    got = S.emas(rows, {"x": ("close", 0.1), "y": ("close", 0.5), "z": ("volume", 0.2)}).orderBy("t").collect()
    state = {"x": None, "y": None, "z": None}
    for r in got:
        for n, (c, a) in {"x": ("close", 0.1), "y": ("close", 0.5), "z": ("volume", 0.2)}.items():
            if r[c] is not None:
                state[n] = r[c] if state[n] is None else a * r[c] + (1 - a) * state[n]
            assert (r[n] is None) == (state[n] is None)
            assert state[n] is None or math.isclose(r[n], state[n], rel_tol=1e-9)


def test_later_bars_change_no_score(spark):
    bars = series(spark, 260, symbols=("a", "b", "c"))
    key = lambda df: {(r.symbol, r.t): (r.state, r.event, round(r.score, 8)) for r in df.collect()}
    whole, part = key(network_momentum(bars, warm_up=30)), key(network_momentum(bars.where(F.col("t") < 200 * H), warm_up=30))
    assert len(part) == 3 * 170
    assert all(whole[k] == v for k, v in part.items())


def test_a_time_without_some_key_is_left_out_and_flat_prices_have_no_score(spark):
    bars = series(spark, 80, symbols=("a", "b", "c")).where(~((F.col("symbol") == "b") & (F.col("t") == 50 * H)))
    assert network_momentum(bars, 5, warm_up=10).where(F.col("t") == 50 * H).count() == 0
    flat = network_momentum(bars.withColumn("close", F.lit(7.0)), 5, warm_up=10).collect()
    assert flat and all(r.score is None and r.state == 0 and r.event == 0 for r in flat)
    assert network_momentum(bars.limit(0), 5).collect() == []
