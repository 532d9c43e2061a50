"""Delay and slippage of fills."""

import math

from quantloom import registry
from quantloom.operators import portfolio as P

from .oracle import differences


def test_delay_and_slippage_move_fills_against_the_side(spark):
    bars = spark.createDataFrame([("a", t, 100.0 + t, 0.0) for t in range(9)], "symbol string, t long, open double, close double")
    entries = spark.createDataFrame([("a", 1, 1), ("a", 4, -1)], "symbol string, t long, side int")
    rows = {(r.t, r.scenario): r for r in P.stressed_episodes(bars, entries, 3, {"base": (0, 0), "late": (1, 0), "slip": (0, 2)}, tick_size=0.5).collect()}
    assert set(rows) == {(1, "base"), (1, "late"), (1, "slip"), (4, "base"), (4, "slip")}  # the late exit of the second is past the last bar
    assert (rows[1, "base"].entry, rows[1, "base"].exit) == (102.0, 105.0)
    assert (rows[1, "late"].entry_t, rows[1, "late"].exit_t, rows[1, "late"].entry) == (3, 6, 103.0)
    assert (rows[1, "slip"].entry, rows[1, "slip"].exit) == (103.0, 104.0)
    assert (rows[4, "slip"].entry, rows[4, "slip"].exit) == (104.0, 109.0)
    assert math.isclose(rows[4, "slip"].gross, -(109 / 104 - 1))


def test_twin(spark):
    name = "pf_06_execution_stress"
    assert differences(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.01") is None
