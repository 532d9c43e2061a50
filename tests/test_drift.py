"""Drift and the gate of trust beside direct computations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quantloom import registry
from quantloom.operators import drift as D

from .oracle import differences


@pytest.mark.parametrize("name", ["xs_17_feature_drift", "xs_17_score_drift", "sig_16_trust_gate"])
def test_twins_past_the_warm_up(spark, name):
    assert differences(spark, registry.queries()[name], registry.oracle_sql()[name], "/root/testdata/sf0.01") is None


def gap(a, b):
    return max(abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) for x in [*a, *b])


def test_score_drift_equals_direct_gap_with_ties_and_nulls(spark):
    rng = random.Random(4)
    rows = [(t, None if rng.random() < 0.1 else float(rng.randint(0, 6) + (t > 25))) for t in range(40) for _ in range(rng.randint(1, 6))]
    rows = [(t, None if t == 30 else v) for t, v in rows]
    got = {r.t: r.ks for r in D.score_drift(spark.createDataFrame(rows, "t long, s double").repartition(5), "s", window=7, min_pool=10).collect()}
    assert set(got) == set(range(40))
    for t in range(40):
        now, pool = [v for u, v in rows if u == t and v is not None], [v for u, v in rows if t - 7 <= u < t and v is not None]
        if not now or len(pool) < 10:
            assert got[t] is None
        else:
            assert math.isclose(got[t], gap(now, pool), abs_tol=1e-12), t
    assert got[30] is None and sum(v is not None for v in got.values()) > 25


def panel(spark, n, seed=3):
    rng, rows = random.Random(seed), []
    for t in range(n):
        for k in "abcde":
            rows.append((k, t, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1) if t % 11 else None, rng.gauss(0, 1) if t + 5 < n else None))
    return spark.createDataFrame(rows, "symbol string, t long, score double, f double, g double, ahead double")


def test_gate_is_null_without_history_and_knows_no_unmatured_label(spark):
    options = {"horizon": 5, "half_life": 10.0, "min_matured": 8, "min_count": 20, "window": 100}
    whole = panel(spark, 200)
    first = {r.t: r for r in D.score_trust(whole, "score", "ahead", ["f", "g"], **options).collect()}
    assert first[10].gate is None and first[12].health is not None and first[11].health is None
    assert all(r.gate is None or 0 <= r.gate <= 1 for r in first.values()) and sum(r.gate is not None for r in first.values()) > 30
    assert all(first[t].disagreement is None for t in range(0, 200, 11))
    # labels of the last five times before 120 are not known at 120, so changing them changes nothing up to there
    other = whole.withColumn("ahead", F.when(F.col("t") > 115, -F.col("ahead") * 3).otherwise(F.col("ahead")))
    second = {r.t: r for r in D.score_trust(other, "score", "ahead", ["f", "g"], **options).collect()}
    assert all(first[t] == second[t] for t in range(121))
    assert any(first[t].health != second[t].health for t in range(121, 200))


def test_no_rows(spark):
    none = panel(spark, 1).limit(0)
    assert D.score_drift(none, "score").collect() == [] and D.feature_drift(none, ["f"]).collect() == []
