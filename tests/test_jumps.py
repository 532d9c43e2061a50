"""Chains of jumps beside plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from quantloom import registry
from quantloom.operators import portfolio as P

from .oracle import differences


def kept_by_loop(rows, strict=False):
    out, busy, at_open = [], None, True
    for entry, leave, opened in sorted(rows, key=lambda r: r[:2]):
        if busy is None or entry > busy or (entry == busy and (at_open or not strict)):
            out.append(entry)
            busy, at_open = leave, opened
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_long_key_of_episodes_equals_loop(spark, strict):
    rng, t = random.Random(5), 0
    rows = []
    for _ in range(10_000):
        t += rng.choice((1, 1, 2, 5, 40))
        rows.append((t, t + rng.choice((1, 3, 9, 400)), rng.random() < 0.5))
    data = [("a", *r, i) for i, r in enumerate(rows)] + [("b", *r, i) for i, r in enumerate(rows[:70])] + [("c", 5, 9, True, 0)]
    df = spark.createDataFrame(data, "symbol string, entry_t long, exit_t long, opened boolean, n int").repartition(7)
    got = P.non_overlapping(df, exit_at_open="opened" if strict else None)
    assert got.columns == df.columns
    for k, part in (("a", rows), ("b", rows[:70]), ("c", [(5, 9, True)])):
        assert sorted(r.entry_t for r in got.where(F.col("symbol") == k).collect()) == kept_by_loop(part, strict), k


def test_repeats_missing_times_and_no_rows(spark):
    schema = "symbol string, entry_t long, exit_t long, _x string"
    df = spark.createDataFrame([("a", 1, 4, "p"), ("a", 1, 4, "p"), ("a", None, 5, "q"), ("a", 4, None, "r"), ("a", 9, 12, "s"), ("b", 3, 3, "u"), ("b", 3, 3, "u")], schema)
    assert sorted(tuple(r) for r in P.non_overlapping(df).collect()) == [("a", 1, 4, "p"), ("a", 4, None, "r"), ("b", 3, 3, "u"), ("b", 3, 3, "u")]
    assert P.non_overlapping(df.limit(0)).collect() == []


@pytest.mark.parametrize("band", [0.0, 0.05, 0.4, 5.0])
def test_band_equals_loop(spark, band):
    rng, w, rows = random.Random(2), 0.0, []
    for i in range(5000):
        w += rng.gauss(0, 0.02)
        rows.append(("a", i, None if i % 97 == 5 else w))
    rows += [("b", i, float(i % 3)) for i in range(10)]
    got = {(r.symbol, r.t): r.held for r in P.no_trade_band(spark.createDataFrame(rows, "symbol string, t long, w double").repartition(5), "w", band).collect()}
    assert len(got) == len(rows)
    held = {"a": 0.0, "b": 0.0}
    for k, t, w in rows:
        if w is not None and abs(w - held[k]) > band:
            held[k] = w
        assert got[k, t] == held[k], (k, t)


@pytest.mark.parametrize("name", ["pf_05_non_overlap", "rec_10_no_trade_band"])
def test_queries_with_other_data(spark, name):
    assert differences(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.01") is None
