"""Folds and matured labels, fits beside numpy, ranks and order statistics beside loops, prefix-sum bootstraps beside direct sums."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import models as M
from quantloom.operators import orderstats as O
from quantloom.operators import pointintime as T
from quantloom.operators import statistics as S

DAY = 86_400_000


def daily(spark, n=900, seed=4, leak=False):
    """Two symbols, a label of the next five days; with ``leak`` the label of the last days before each half-year is all the features tell."""
    rng, rows = random.Random(seed), []
    for s in ("a", "b"):
        x = [(rng.gauss(0, 1), rng.gauss(2, 3)) for _ in range(n)]
        for i in range(n):
            day = 11_000 + i
            y = int(x[i][0] + 0.3 * x[i][1] + rng.gauss(0, 1) > 0.5)
            rows.append((s, day * DAY, x[i][0], x[i][1], y, (day + 5) * DAY if i + 5 < n else None))
    df = spark.createDataFrame(rows, "symbol string, t long, f0 double, f1 double, y int, known_t long")
    date = F.date_from_unix_date((F.col("t") / DAY).cast("int"))
    return df.withColumns({"month": (F.year(date) * 12 + F.month(date) - 1).cast("long"), "year": F.year(date)}), rows


def folds_of(df):
    a, b = df.agg(F.min("month"), F.max("month")).first()
    return M.folds_to_end(a, b, 12, 6, expanding=True), M.folds_to_end(a, b, 12, 6)


def members(rows, fold, purge=0, embargo=0):
    a, b, c = fold
    start = T.month_start(b)
    month = lambda t: (lambda d: d.year * 12 + d.month - 1)(__import__("datetime").date(1970, 1, 1) + __import__("datetime").timedelta(days=t // DAY))
    learn = [r for r in rows if r[5] is not None and month(r[1]) >= a and r[5] + purge < start]
    score = [r for r in rows if b <= month(r[1]) < c and r[1] >= start + embargo]
    return learn, score


@pytest.mark.parametrize("kind", [0, 1])
def test_fold_membership(spark, kind):
    df, rows = daily(spark)
    folds = folds_of(df)[kind]
    got = T.with_folds(df, folds, purge_ms=DAY, embargo_ms=2 * DAY).collect()
    for k, fold in enumerate(folds):
        learn, score = members(rows, fold, DAY, 2 * DAY)
        assert sorted((r.symbol, r.t) for r in got if r._first is not None and r._first <= k <= r._last) == sorted(r[:2] for r in learn)
        assert sorted((r.symbol, r.t) for r in got if r._test == k) == sorted(r[:2] for r in score)
    assert T.with_folds(df, []).where(T.trained() | F.col("_test").isNotNull()).count() == 0


def test_ridge_and_logit_of_all_folds_equal_numpy(spark):
    df, rows = daily(spark)
    folds = folds_of(df)[1]
    m = T.with_folds(df, folds)
    ridge = {k: (n, b) for k, n, b in T.fold_ridge(m, ["f0", "f1"], "y", len(folds), ridge=0.5)}
    fits = {f["fold"]: f for f in T.fold_logit(m, ["f0", "f1"], "y", len(folds), year="year")}
    scored = {(r.symbol, r.t): r.p for r in T.scored_by_logit(m, list(fits.values()), ["f0", "f1"], year="year").collect()}
    years = sorted({r.year for r in df.select("year").distinct().collect()})
    year = lambda t: 1970 + int(np.datetime64(t, "ms").astype("datetime64[Y]").astype(int))
    for k, fold in enumerate(folds):
        learn, score = members(rows, fold)
        x, y = np.array([r[2:4] for r in learn]), np.array([r[4] for r in learn], float)
        a = np.hstack([np.ones((len(x), 1)), x])
        assert ridge[k][0] == len(x)
        assert np.allclose(ridge[k][1], np.linalg.solve(a.T @ a + np.diag([0, 0.5, 0.5]), a.T @ y), atol=1e-9)
        mean, sd = x.mean(axis=0), x.std(axis=0)
        design = lambda some: np.hstack([np.ones((len(some), 1)), (np.array([r[2:4] for r in some]) - mean) / sd, np.array([[year(r[1]) == z for z in years[1:]] for r in some], float)])  # noqa: E731, B023
        d, beta = design(learn), np.zeros(3 + len(years) - 1)
        for _ in range(50):
            mu = 1 / (1 + np.exp(-d @ beta))
            beta += np.linalg.solve((d * (mu * (1 - mu))[:, None]).T @ d + np.eye(len(beta)), d.T @ (y - mu) - beta)
        assert np.allclose(fits[k]["beta"], beta, atol=1e-7) and fits[k]["n"] == len(x)
        assert np.allclose([scored[r[:2]] for r in score], 1 / (1 + np.exp(-design(score) @ beta)), atol=1e-7)


def test_a_planted_future_label_is_not_learned(spark):
    """f0 is the label itself on the rows whose label is known only within the test months, and noise elsewhere: no fold may use it."""
    df, rows = daily(spark)
    folds = folds_of(df)[0]
    starts = [T.month_start(b) for _, b, _ in folds]
    late = F.lit(False)
    for start in starts:
        late = late | ((F.col("t") < start) & (F.col("known_t") >= start))
    planted = df.withColumn("f0", F.when(late, F.col("y") * 1000.0 - 500).otherwise(F.pmod(F.xxhash64("symbol", "t"), F.lit(1000)) / 1000.0)).where(late | F.col("known_t").isNotNull())
    honest = T.fold_logit(T.with_folds(planted, folds[:1]), ["f0"], "y", 1)[0]
    leaking = T.fold_logit(T.with_folds(planted.withColumn("known_t", F.col("t")), folds[:1]), ["f0"], "y", 1)[0]
    assert honest["sd"][0] < 1 and leaking["sd"][0] > 10  # the planted rows are outside of the honest fold's training
    model = M.walk_forward(planted, ["f0"], "y", folds[:1], "logit")
    assert model.where("abs(f0) < 2 and (score < 0.02 or score > 0.98)").count() == 0


def test_fold_with_one_class_is_left_out(spark):
    df, _ = daily(spark)
    folds = folds_of(df)[0]
    m = T.with_folds(df.withColumn("y", F.lit(1)), folds)
    assert T.fold_logit(m, ["f0"], "y", len(folds)) == []
    assert M.walk_forward(df.withColumn("y", F.lit(1)), ["f0"], "y", folds[:1], "logit").count() == 0


def history(spark, n=260, seed=8):
    rng, rows = random.Random(seed), []
    for s, k in (("a", n), ("b", 40), (None, 9)):
        rows += [(s, i * 7, rng.choice([None, -0.0, 0.0, 1.5, rng.gauss(0, 1), 3.0]), "x") for i in range(k)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, t long, v double, _i string").repartition(5), rows


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_expanding_ranks_and_quantiles_equal_loops(spark, block):
    df, rows = history(spark)
    ranks = {(r.symbol, r.t): (r.expanding_rank, r.expanding_mid_rank) for r in O.expanding_rank(df.where("symbol is not null"), "v", block=block).collect()}
    marks = {q: {(r.symbol, r.t): r.q for r in O.expanding_quantile(df.where("symbol is not null"), "v", q, "q", block=block).collect()} for q in (0.0, 0.37, 1.0)}
    shifted = {(r.symbol, r.t): r.q for r in O.expanding_quantile(df.where("symbol is not null"), "v", 0.5, "q", shift=2, block=block).collect()}
    for s in ("a", "b"):
        seen = []
        for _, t, v, _ in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]):
            if v is None:
                assert ranks[s, t] == (None, None) and marks[0.37][s, t] is None
                continue
            assert shifted[s, t] is None if len(seen) < 2 else abs(shifted[s, t] - np.quantile(seen[: len(seen) - 1], 0.5)) < 1e-12
            seen.append(v)
            below, equal = sum(x < v for x in seen), sum(x == v for x in seen)
            assert ranks[s, t] == pytest.approx(((below + equal) / len(seen), (below + equal / 2) / len(seen)), abs=1e-12)
            for q, got in marks.items():
                assert got[s, t] == pytest.approx(float(np.quantile(seen, q)), abs=1e-12)


def test_running_sums_and_average_ranks(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 30), rng.randint(0, 5)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v int, w long").repartition(7)
    for r in O.running_sums(df.groupBy("k", "v").agg(F.sum("w").alias("w")), ["k"], ["v"], {"before": "w"}).collect():
        assert r.before == sum(w for k, v, w in rows if k == r.k and v < r.v)
    for r in O.average_ranks(df, ["v"], ["k"]).collect():
        same = [v for k, v, _ in rows if k == r.k]
        assert r.rank_v == sum(v < r.v for v in same) + (sum(v == r.v for v in same) + 1) / 2
    assert O.running_sums(df.where("false"), [], ["v"], {"b": "w"}).count() == 0


def test_block_bootstrap_equals_direct_sums(spark):
    rng = random.Random(1)
    values = {"a": [rng.gauss(0, 1) for _ in range(130)], "b": [rng.gauss(1, 1) for _ in range(3)]}
    df = spark.createDataFrame([(k, i * 10, v) for k, vs in values.items() for i, v in enumerate(vs)], "k string, t long, v double").repartition(3)
    got = {(r.k, r.draw): r["mean"] for r in S.block_bootstrap_means(df, "k", "t", "v", 50).collect()}
    assert len(got) == 100
    for (k, draw), mean in got.items():
        vs, j, picked = values[k], 0, []
        most = 2 * -(-len(vs) // 21) + 64
        while len(picked) < len(vs):
            h = hashlib.md5(f"42:{k}:{draw}:{j}".encode()).hexdigest()
            u, v = ((int(x, 16) + 0.5) / (1 << 52) for x in (h[:13], h[16:29]))
            length = 1 + math.floor(math.log(u) / math.log(1 - 1 / 21))
            start = math.floor(v * len(vs))
            if j == most - 1:
                length = len(vs)
            picked += [vs[(start + i) % len(vs)] for i in range(min(length, len(vs) - len(picked)))]
            j += 1
        assert mean == pytest.approx(sum(picked) / len(vs), abs=1e-9)


def test_tampered_ledgers_are_found(spark):
    from quantloom.operators.evidence import reconcile

    episodes = [(1, "a", 2.0, 2, "F"), (2, "a", 1.0, 1, "O"), (3, "a", 1.0, 1, "F"), (4, "b", None, 1, "P"), (5, "b", 1.0, 1, "X")]
    fills = [(1, 1.0), (1, 1.0), (2, 1.5), (4, 1.0), (5, 1.0), (9, 1.0)]
    e = spark.createDataFrame(episodes, "episode long, symbol string, fees double, n_fills long, exit_reason string")
    got = {r.symbol: r for r in reconcile(e, spark.createDataFrame(fills, "episode long, fee double")).collect()}
    assert (got["a"].n, got["a"].differ, got["a"].no_fills, got["a"].orphans) == (3, 2, 1, 0)  # wrong fees, and no fills at all
    assert (got["b"].n, got["b"].differ) == (2, 1) and got["b"].exits_f + got["b"].exits_o + got["b"].exits_p == 1  # an unknown exit reason breaks the partition
    assert (got[None].n, got[None].orphans) == (0, 1)


@pytest.mark.parametrize("chunk", [1, 4, 90])
def test_drawdown_of_chunks_equals_a_running_peak(spark, chunk):
    from quantloom.operators.evidence import equity_measures

    rng = random.Random(6)
    steps = {"a": [rng.gauss(0, 5) for _ in range(200)], "b": [-1.0, -2.0], "c": [3.0]}
    df = spark.createDataFrame([(k, 100 + 2 * i, x) for k, xs in steps.items() for i, x in enumerate(xs)], "symbol string, day long, net double").repartition(4)
    for r in equity_measures(df, "day", "net", 1000.0, chunk=chunk).collect():
        equity = 1000 + np.cumsum(steps[r.symbol])
        assert r.days == len(equity) and r.max_dd == pytest.approx(float((equity - np.maximum.accumulate(equity)).min()), abs=1e-9)
        back = np.diff(equity) / equity[:-1]
        assert r.sharpe == pytest.approx(float(back.mean() / back.std(ddof=1) * math.sqrt(365)) if len(equity) > 2 else 0.0, abs=1e-9)


def test_shuffled_values_stay_with_their_key(spark):
    rng = random.Random(9)
    rows = [(k, i, rng.choice([None, 1.0, 2.0, rng.random()])) for k in ("a", "b", None) for i in range(150)]
    df = spark.createDataFrame(rows, "symbol string, t long, v double").repartition(5)
    got = S.shuffled(df, "v").collect()
    assert len(got) == len(rows)
    for k in ("a", "b", None):
        before = [v for s, _, v in rows if s == k]
        after = [r.placebo for r in sorted((r for r in got if r.symbol == k), key=lambda r: r.t)]
        assert sorted(map(str, before)) == sorted(map(str, after)) and before != after


def test_macd_in_one_scan_equals_loops(spark):
    from quantloom.operators import scan as scans

    rng = random.Random(12)
    rows = [(k, i, None if i < 3 or rng.random() < 0.1 else 100 + rng.gauss(0, 3)) for k in ("a", "b") for i in range(400)]
    got = scans.macd(spark.createDataFrame(rows, "symbol string, t long, close double").repartition(3)).collect()
    for k in ("a", "b"):
        f = s = g = None
        for r in sorted((r for r in got if r.symbol == k), key=lambda r: r.t):
            if r.close is not None:
                f = r.close if f is None else f + 2 / 13 * (r.close - f)
                s = r.close if s is None else s + 2 / 27 * (r.close - s)
                g = f - s if g is None else g + 0.2 * (f - s - g)
            assert (r.macd, r.macd_signal) == (None, None) if f is None else (abs(r.macd - (f - s)) < 1e-9 and abs(r.macd_signal - g) < 1e-9)


def test_lookups_of_a_block_bootstrap_are_never_broadcast(spark, monkeypatch):
    """The planner takes the draws for as small as the sizes that they are made from; one broadcast of them filled the driver."""
    df = spark.range(900).selectExpr("'a' AS k", "id AS t", "sin(id) AS v")
    means = []
    for most in (S.BROADCAST_SUMS, 0):
        monkeypatch.setattr(S, "BROADCAST_SUMS", most)
        got = S.block_bootstrap_means(df, "k", "t", "v", 20)
        means.append(sorted((r.draw, round(r["mean"], 9)) for r in got.collect()))
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        joins = [line for line in plan.splitlines() if "Join" in line and "_at#" in line]
        assert joins and all(("Broadcast" in line) == (most > 0) and "BuildRight" in line for line in joins)
    assert means[0] == means[1] and len(means[0]) == 20
