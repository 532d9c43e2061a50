"""Rule re-selection breaks ties by sum and rule; weighted MACD starts where its whole price does; weighted correlation beside numpy."""

import numpy as np

from quantloom.operators.portfolio import reselect
from quantloom.operators.scan import weighted_macd
from quantloom.operators.xsection import ew_correlation


def test_reselection_ranks_by_sharpe_sum_and_rule(spark):
    rows = [("a", d, rule, v * (1 + d % 2)) for d in range(8) for rule, v in ((0, -1.0), (1, 1.0), (2, 2.0), (3, 2.0))] + [("b", 0, 0, 1.0)]
    got = reselect(spark.createDataFrame(rows, "symbol string, day long, rule long, r double"), 4, 2).collect()
    assert sorted((r.symbol, r.step, r.rule, r.train_pnl, r.test_pnl) for r in got) == [("a", 0, 2, 12.0, 6.0), ("a", 1, 2, 12.0, 6.0)]  # equal Sharpe for 1, 2, 3


def test_weighted_macd_waits_for_its_price(spark):
    bars = spark.createDataFrame([("a", i, 10.0 + i % 3, 12.0 + i % 3, 9.0, 11.0 + i % 2, 5.0 + i) for i in range(30)], "symbol string, t long, open double, high double, low double, close double, volume double")
    got = {r.t: r for r in weighted_macd(bars).where("variant = 'full'").collect()}
    assert [t for t in got if got[t].price is not None] and min(t for t in got if got[t].price is not None) == 19 and got[18].macd is None and got[19].macd == 0
    x = sorted(bars.collect(), key=lambda r: r.t)
    span = np.array([r.high - r.low for r in x])
    weight = [x[i].close * x[i].volume * np.std(span[i - 9 : i + 1]) / x[i].close * abs(x[i].close - x[i].open) / span[i] for i in range(9, 30)]
    assert abs(got[25].price - sum(weight[6:16]) / sum(r.volume for r in x[15:25])) < 1e-12


def test_weighted_correlation(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(50, 2))
    rows = [("a", "b", i, float(p), float(q)) for i, (p, q) in enumerate(v)] + [("a", "c", i, 1.0, float(i)) for i in range(5)]
    got = {r.b: (r.n, r.rho) for r in ew_correlation(spark.createDataFrame(rows, "a string, b string, t long, ra double, rb double"), 30, 30.0).collect()}
    w = 0.5 ** (np.arange(29, -1, -1) / 30)
    c = np.cov(v[20:].T, aweights=w, ddof=0)
    assert got["b"][0] == 30 and abs(got["b"][1] - c[0, 1] / np.sqrt(c[0, 0] * c[1, 1])) < 1e-12 and got["c"] == (5, 0.0)
