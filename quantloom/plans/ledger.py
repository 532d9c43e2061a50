"""Aggregates over ledgers and grids, evidence operators, sources."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import day_of, over, past, quarter_ordinal, tidy
from ..registry import query
from ..sources import roles as R
from ..sources.roles import with_roles

C = F.col
EP, DAILY, GRID, SL = with_roles("episodes"), with_roles("daily"), with_roles("grid"), with_roles("slices")
r4 = lambda c: F.round(c, 4) + 0.0


@query("agg_01_ledger_summary", EP + """, k AS (SELECT o_orderpriority AS symbol, sum(amount) AS turnover, sum(amount + fee + funding) AS costs FROM fills JOIN orders ON o_orderkey = episode GROUP BY 1), p AS (SELECT o_orderpriority AS symbol, sum(o_totalprice) AS paid FROM orders SEMI JOIN fills ON o_orderkey = episode GROUP BY 1)
SELECT e.symbol, count(*) AS n, round(sum(gross), 4) + 0.0 AS gross, round(sum(fees), 4) + 0.0 AS fees, round(sum(e.funding), 4) + 0.0 AS funding, round(sum(gross - fees - e.funding), 4) + 0.0 AS net, sum(n_fills)::BIGINT AS fills, sum(greatest(n_fills - 1, 0))::BIGINT AS adds, round(any_value(turnover), 4) + 0.0 AS turnover, count(*) FILTER (exit_reason = 'F') AS exits_f, count(*) FILTER (exit_reason = 'O') AS exits_o, round(max(amount), 4) + 0.0 AS max_capital, abs(sum(gross - fees - e.funding) - (any_value(paid) - any_value(costs))) < 0.001 AS adds_up FROM episodes e JOIN k ON k.symbol = e.symbol JOIN p ON p.symbol = e.symbol GROUP BY 1""")
def agg_01(s, d):
    """Sums of the episode ledger; adds_up compares its net with prices paid less what the fill ledger itself says was spent.

    Sums of episodes are decimal: those of doubles are off by more than the 0.001 allowed once they pass some 1e11.
    """
    exact = lambda c: F.sum((C(c) if isinstance(c, str) else c).cast("decimal(28,10)"))
    r4 = lambda c: F.round(c, 4).cast("double") + 0.0
    e, f, o = R.episodes(s, d), R.fills(s, d), R.read(s, d, "orders").select(C("o_orderkey").alias("episode"), C("o_orderpriority").alias("symbol"), "o_totalprice")
    spent = f.groupBy("episode").agg(F.sum("amount").alias("a"), F.sum(C("amount") + C("fee") + C("funding")).alias("c"))
    own = o.join(spent, "episode").groupBy("symbol").agg(exact("a").alias("turnover"), (exact("o_totalprice") - exact("c")).alias("_net"))
    net = C("gross") - C("fees") - C("funding")
    g = e.groupBy("symbol").agg(
        F.count("*").alias("n"), r4(exact("gross")).alias("gross"), r4(exact("fees")).alias("fees"), r4(exact("funding")).alias("funding"), r4(exact(net)).alias("net"), exact(net).alias("_sum"), F.sum("n_fills").alias("fills"), F.sum(F.greatest(C("n_fills") - 1, F.lit(0))).alias("adds"),
        F.count_if(C("exit_reason") == "F").alias("exits_f"), F.count_if(C("exit_reason") == "O").alias("exits_o"), r4(F.max("amount")).alias("max_capital"),
    )
    return g.join(own, "symbol").withColumns({"turnover": r4(C("turnover")), "adds_up": F.abs(C("_sum") - C("_net")) < 0.001}).drop("_sum", "_net")


_RET = ", x AS (SELECT symbol, t, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM daily) "


def rets(s, d):
    return R.bars_1d(s, d).withColumn("r", C("close") / F.lag("close").over(over()) - 1)


@query("agg_02_sharpe", DAILY + _RET + "SELECT symbol, round(CASE WHEN min(close) <= 0 THEN NULL WHEN stddev_samp(r) = 0 THEN 0 ELSE avg(r) / stddev_samp(r) * sqrt(365) END, 6) + 0.0 AS sharpe FROM x GROUP BY 1")
def agg_02(s, d):
    g = rets(s, d).groupBy("symbol").agg(F.min("close").alias("lo"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))
    return tidy(g, "symbol", sharpe=F.when(C("lo") > 0, F.when(C("sd") == 0, 0.0).otherwise(C("m") / C("sd") * F.sqrt(F.lit(365.0)))))


@query("agg_03_equity_curve", EP + ", e AS (SELECT symbol, t // 86400000 AS day, sum(gross - fees - funding) AS net FROM episodes GROUP BY 1, 2), sp AS (SELECT symbol, min(day) AS a, max(day) AS b FROM e GROUP BY 1), c AS (SELECT symbol, unnest(range(a, b + 1)) AS day FROM sp) SELECT symbol, day, round(sum(coalesce(net, 0)) OVER (PARTITION BY symbol ORDER BY day), 4) + 0.0 AS equity FROM c LEFT JOIN e USING (symbol, day)")
def agg_03(s, d):
    e = R.episodes(s, d).groupBy("symbol", day_of(C("t")).alias("day")).agg(F.sum(C("gross") - C("fees") - C("funding")).alias("net"))
    days = e.groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("b")).select("symbol", F.explode(F.sequence("a", "b")).alias("day"))
    full = days.join(e, ["symbol", "day"], "left").fillna(0.0, ["net"])
    return full.select("symbol", "day", (F.round(F.sum("net").over(over("symbol", "day")), 4) + 0.0).alias("equity"))


@query("agg_04_growth", DAILY + "SELECT symbol, round(last(close ORDER BY t) / first(close ORDER BY t) - 1, 6) + 0.0 AS total, round(pow(last(close ORDER BY t) / first(close ORDER BY t), 365.0 / ((max(t) - min(t)) / 86400000)) - 1, 6) + 0.0 AS cagr FROM daily GROUP BY 1")
def agg_04(s, d):
    by = F.struct("t", "close")
    g = R.bars_1d(s, d).groupBy("symbol").agg((F.max(by)["close"] / F.min(by)["close"]).alias("q"), ((F.max("t") - F.min("t")) / 86_400_000).alias("days"))
    return tidy(g, "symbol", total=C("q") - 1, cagr=F.pow("q", 365.0 / C("days")) - 1)


_TAIL = "avg(r) FILTER ({k} <= ceil({p} * c))"


@query("agg_05_tail_risk", DAILY + _RET + ", k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY r, t) AS n, row_number() OVER (PARTITION BY symbol ORDER BY r DESC, t) AS m, count(*) OVER (PARTITION BY symbol) AS c FROM x WHERE r IS NOT NULL), " + f"g AS (SELECT symbol, avg(r) AS mean, stddev_samp(r) FILTER (r < 0) AS down, {_TAIL.format(k='n', p=0.05)} AS low5, {_TAIL.format(k='m', p=0.05)} AS top5, {_TAIL.format(k='n', p=0.01)} AS low1, {_TAIL.format(k='m', p=0.01)} AS top1 FROM k GROUP BY 1) SELECT symbol, round(low5, 6) + 0.0 AS cvar_95, round(low1, 6) + 0.0 AS cvar_99, round(-top5 / low5, 6) + 0.0 AS rachev_95, round(-top1 / low1, 6) + 0.0 AS rachev_99, round(mean / abs(low5), 6) + 0.0 AS starr, round(mean / down * sqrt(365), 6) + 0.0 AS sortino FROM g")
def agg_05(s, d):
    """Means of the worst and best ceil(share * n) returns, their ratios, mean over CVaR, and the annualised Sortino ratio over the deviation of negative returns."""
    w = Window.partitionBy("symbol")
    x = rets(s, d).where("r is not null").withColumns({"n": F.row_number().over(w.orderBy("r", "t")), "m": F.row_number().over(w.orderBy(C("r").desc(), "t")), "c": F.count("*").over(w)})
    tail = lambda k, p: F.avg(F.when(C(k) <= F.ceil(p * C("c")), C("r")))
    g = x.groupBy("symbol").agg(F.avg("r").alias("mean"), F.stddev_samp(F.when(C("r") < 0, C("r"))).alias("down"), tail("n", 0.05).alias("low5"), tail("m", 0.05).alias("top5"), tail("n", 0.01).alias("low1"), tail("m", 0.01).alias("top1"))
    return tidy(g, "symbol", cvar_95=C("low5"), cvar_99=C("low1"), rachev_95=-C("top5") / C("low5"), rachev_99=-C("top1") / C("low1"), starr=C("mean") / F.abs("low5"), sortino=C("mean") / C("down") * F.sqrt(F.lit(365.0)))


@query("agg_06_hill_index", DAILY + _RET + ", k AS (SELECT symbol, -r AS l, row_number() OVER (PARTITION BY symbol ORDER BY r, t) AS n, count(*) OVER (PARTITION BY symbol) AS c FROM x WHERE r < 0) SELECT symbol, max(floor(sqrt(c)))::BIGINT AS k, round(1 / (avg(ln(l)) FILTER (n <= floor(sqrt(c))) - max(ln(l)) FILTER (n = floor(sqrt(c)) + 1)), 6) + 0.0 AS hill FROM k GROUP BY 1")
def agg_06(s, d):
    w = Window.partitionBy("symbol")
    x = rets(s, d).where("r < 0").withColumns({"l": -C("r"), "n": F.row_number().over(w.orderBy("r", "t")), "k": F.floor(F.sqrt(F.count("*").over(w))).cast("long")})
    g = x.groupBy("symbol").agg(F.max("k").alias("k"), (1 / (F.avg(F.when(C("n") <= C("k"), F.log("l"))) - F.max(F.when(C("n") == C("k") + 1, F.log("l"))))).alias("hill"))
    return tidy(g, "symbol", "k", hill=C("hill"))


@query("agg_07_hedge_half_life", with_roles("bars") + ", p AS (SELECT a.symbol AS a, b.symbol AS b, a.t, ln(a.close) AS y, ln(b.close) AS x FROM bars a JOIN bars b ON a.t = b.t AND a.symbol < b.symbol WHERE a.close > 0 AND b.close > 0), h AS (SELECT a, b, regr_slope(y, x) AS beta, regr_intercept(y, x) AS alpha FROM p GROUP BY 1, 2), e AS (SELECT a, b, t, y - alpha - beta * x AS e FROM p JOIN h USING (a, b)), l AS (SELECT a, b, e - lag(e) OVER w AS de, lag(e) OVER w AS e1 FROM e WINDOW w AS (PARTITION BY a, b ORDER BY t)), q AS (SELECT a, b, regr_slope(de, e1) AS phi, count(de) AS n, sum(de * pow(e1, 3)) / sum(pow(e1, 6)) AS c, sum(de * de) AS dd, sum(de * pow(e1, 3)) AS du, sum(pow(e1, 6)) AS uu FROM l GROUP BY 1, 2) SELECT a, b, round(beta, 6) + 0.0 AS beta, round(phi, 6) + 0.0 AS phi, round(CASE WHEN phi > -1 AND phi < 0 THEN -ln(2) / ln(1 + phi) END, 4) + 0.0 AS half_life, round(CASE WHEN n > 1 AND dd - c * du > 0 THEN c / sqrt((dd - c * du) / (n - 1) / uu) END, 4) + 0.0 AS cubic_t FROM h JOIN q USING (a, b)")
def agg_07(s, d):
    """Hedge ratio of log prices, half-life of the residual's AR(1), and the t of its change on its cubed level (a cubic unit-root test)."""
    from ..operators.joins import symbol_pairs

    p = symbol_pairs(R.bars_1h(s, d).where("close > 0").withColumn("close", F.log("close")), "close")
    h = p.groupBy("a", "b").agg(F.regr_slope("ra", "rb").alias("beta"), F.regr_intercept("ra", "rb").alias("alpha"))
    e = p.join(h, ["a", "b"]).withColumn("e", C("ra") - C("alpha") - C("beta") * C("rb")).withColumn("e1", F.lag("e").over(over(["a", "b"])))
    e = e.withColumns({"de": C("e") - C("e1"), "u": F.pow("e1", F.lit(3.0))})
    q = e.groupBy("a", "b").agg(F.first("beta").alias("beta"), F.regr_slope("de", "e1").alias("phi"), F.count("de").alias("n"), F.sum(C("de") ** 2).alias("dd"), F.sum(C("de") * C("u")).alias("du"), F.sum(C("u") ** 2).alias("uu"))
    q = q.withColumn("c", C("du") / C("uu")).withColumn("rest", C("dd") - C("c") * C("du"))
    half = F.when((C("phi") > -1) & (C("phi") < 0), -math.log(2) / F.log(1 + C("phi")))
    cubic = F.when((C("n") > 1) & (C("rest") > 0), C("c") / F.sqrt(C("rest") / (C("n") - 1) / C("uu")))
    return tidy(q, "a", "b", beta=C("beta"), phi=C("phi"), half_life=F.round(half, 4), cubic_t=F.round(cubic, 4))


@query("agg_08_grouped_regression", DAILY + ", x AS (SELECT symbol, close AS y, open AS x FROM daily) SELECT symbol, count(*) AS n, round(regr_slope(y, x), 6) + 0.0 AS slope FROM x GROUP BY 1")
def agg_08(s, d):
    from ..operators.models import grouped_ols

    x = R.bars_1d(s, d).select("symbol", C("close").alias("y"), C("open").alias("x0"))
    return tidy(grouped_ols(x, "symbol", "y", ["x0"], ridge=0.0), "symbol", "n", slope=F.element_at("coef", 2))


@query("agg_09_level_histogram", with_roles("fills") + "SELECT level, count(*) AS n FROM fills GROUP BY 1")
def agg_09(s, d):
    return R.fills(s, d).groupBy("level").agg(F.count("*").alias("n"))


@query("agg_09_pnl_by_year", EP + "SELECT year(make_timestamp(t * 1000))::BIGINT AS year, count(*) AS n, round(sum(gross), 3) + 0.0 AS gross FROM episodes GROUP BY 1")
def agg_09y(s, d):
    from ..functions.expr import date_of

    return R.episodes(s, d).groupBy(F.year(date_of(C("t"))).cast("long").alias("year")).agg(F.count("*").alias("n"), (F.round(F.sum("gross"), 3) + 0.0).alias("gross"))


@query("agg_10_medians_shares", GRID + "SELECT grid, round(quantile_cont(net_pnl, 0.5), 6) + 0.0 AS median_pnl, round(avg(CASE WHEN net_pnl > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share_positive FROM grid GROUP BY 1")
def agg_10(s, d):
    g = R.grid(s, d).groupBy("grid").agg(F.percentile("net_pnl", 0.5).alias("m"), F.avg(F.when(C("net_pnl") > 0, 1.0).otherwise(0.0)).alias("p"))
    return tidy(g, "grid", median_pnl=C("m"), share_positive=C("p"))


_Q = "(year(make_timestamp(t * 1000)) * 4 + quarter(make_timestamp(t * 1000)) - 1)::BIGINT"


@query("agg_11_stress_quarters", DAILY + _RET + f", g AS (SELECT t, avg(r) AS r FROM x WHERE r IS NOT NULL GROUP BY 1), q AS (SELECT {_Q} AS quarter, t, r, exp(sum(ln(1 + r)) OVER (PARTITION BY {_Q} ORDER BY t)) AS level FROM g WHERE r > -1), k AS (SELECT quarter, r, level / greatest(1.0, max(level) OVER (PARTITION BY quarter ORDER BY t)) - 1 AS dd FROM q) SELECT quarter, round(sum(r), 6) + 0.0 AS ret, round(min(least(dd, 0)), 6) + 0.0 AS max_dd FROM k GROUP BY 1 ORDER BY sum(r), 1 LIMIT 4")
def agg_11(s, d):
    """The four worst calendar quarters of the market's mean return (a top-k report), each with the deepest drawdown inside it."""
    g = rets(s, d).where("r is not null").groupBy("t").agg(F.avg("r").alias("r")).where("r > -1").withColumn("quarter", quarter_ordinal(C("t")))
    g = g.withColumn("level", F.exp(F.sum(F.log(1 + C("r"))).over(past("quarter"))))
    g = g.withColumn("dd", C("level") / F.greatest(F.lit(1.0), F.max("level").over(past("quarter"))) - 1)
    g = g.groupBy("quarter").agg(F.sum("r").alias("x"), F.min(F.least("dd", F.lit(0.0))).alias("dd"))
    return tidy(g.orderBy("x", "quarter").limit(4), "quarter", ret=C("x"), max_dd=C("dd"))


@query("agg_12_funnel_counts", "SELECT count(*) AS registered, count(*) FILTER (n > 0) AS evaluated, sum(n)::BIGINT AS evaluations FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1)")
def agg_12(s, d):
    o = R.read(s, d, "orders").groupBy(C("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return R.read(s, d, "customer").join(o, "c_custkey", "left").agg(F.count("*").alias("registered"), F.count_if(C("n") > 0).alias("evaluated"), F.sum("n").alias("evaluations"))


@query("agg_13_slice_aggregation", SL + ", c AS (SELECT *, sum(pnl) OVER w AS level FROM slices WINDOW w AS (PARTITION BY survivor ORDER BY start, slice)), k AS (SELECT *, level - greatest(0.0, max(level) OVER (PARTITION BY survivor ORDER BY start, slice)) AS dd FROM c) SELECT survivor, count(*) AS slices, sum(n_episodes)::BIGINT AS episodes, round(sum(pnl), 4) + 0.0 AS pnl, round(sum(sharpe * n_episodes) / nullif(sum(n_episodes), 0), 6) + 0.0 AS sharpe, round(min(dd), 4) + 0.0 AS min_drawdown, min(start) AS first_start, max(\"end\") AS last_end FROM k GROUP BY 1")
def agg_13(s, d):
    """Sums over a survivor's slices, the episode-weighted Sharpe, and the deepest fall of the summed PnL below its peak or zero."""
    along = past("survivor", ["start", "slice"])
    x = R.slices(s, d).withColumn("level", F.sum("pnl").over(along))
    x = x.withColumn("dd", C("level") - F.greatest(F.lit(0.0), F.max("level").over(along)))
    g = x.groupBy("survivor").agg(F.count("*").alias("slices"), F.sum("n_episodes").alias("episodes"), r4(F.sum("pnl")).alias("pnl"), (F.sum(C("sharpe") * C("n_episodes")) / F.nullif(F.sum("n_episodes"), F.lit(0))).alias("sh"), r4(F.min("dd")).alias("min_drawdown"), F.min("start").alias("first_start"), F.max("end").alias("last_end"))
    return g.select("survivor", "slices", "episodes", "pnl", "min_drawdown", "first_start", "last_end", (F.round("sh", 6) + 0.0).alias("sharpe"))


@query("agg_14_stress_floor", GRID + ", g AS (SELECT cohort, grid, sum(net_pnl) AS net FROM grid GROUP BY 1, 2) SELECT cohort, grid AS floor_grid, round(net, 4) + 0.0 AS floor_net FROM g QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY net, grid) = 1")
def agg_14(s, d):
    g = R.grid(s, d).groupBy("cohort", "grid").agg(F.sum("net_pnl").alias("net")).groupBy("cohort").agg(F.min(F.struct("net", "grid")).alias("x"))
    return g.select("cohort", C("x.grid").alias("floor_grid"), r4(C("x.net")).alias("floor_net"))


@query("agg_15_trade_frequency", EP + "SELECT symbol, round(count(*) * 365.25 / (max(t) // 86400000 - min(t) // 86400000 + 1), 6) + 0.0 AS per_year FROM episodes GROUP BY 1")
def agg_15(s, d):
    from ..functions.expr import days_inclusive

    g = R.episodes(s, d).groupBy("symbol").agg(F.count("*").alias("n"), days_inclusive(F.min("t"), F.max("t")).alias("days"))
    return tidy(g, "symbol", per_year=C("n") * 365.25 / C("days"))


@query("agg_16_subtotals", GRID + "SELECT coalesce(grid, '*') AS grid, coalesce(cohort, '*') AS cohort, count(*) AS n, round(sum(net_pnl), 4) + 0.0 AS net FROM grid GROUP BY ROLLUP (grid, cohort)")
def agg_16(s, d):
    g = R.grid(s, d).rollup("grid", "cohort").agg(F.count("*").alias("n"), (F.round(F.sum("net_pnl"), 4) + 0.0).alias("net"))
    return g.fillna("*", ["grid", "cohort"])


@query("agg_17_concentration", EP + ", g AS (SELECT symbol, sum(greatest(gross, 0)) AS p FROM episodes GROUP BY 1) SELECT symbol, round(p / sum(p) OVER (), 6) + 0.0 AS share, p / sum(p) OVER () > 0.7 AS flagged FROM g")
def agg_17(s, d):
    g = R.episodes(s, d).groupBy("symbol").agg(F.sum(F.greatest("gross", F.lit(0.0))).alias("p"))
    g = g.withColumn("share", C("p") / F.sum("p").over(Window.partitionBy()))
    return tidy(g.withColumn("flagged", C("share") > 0.7), "symbol", "flagged", share=C("share"))


@query("agg_18_verdict", GRID + "SELECT cohort, CASE WHEN bool_or(CASE WHEN episodes >= 3 THEN net_pnl < -50000 END) THEN 'FALSIFIED' WHEN count(CASE WHEN episodes >= 3 THEN 1 END) = 0 THEN 'INDETERMINATE' ELSE 'NOT_FALSIFIED' END AS verdict FROM grid GROUP BY 1")
def agg_18(s, d):
    flag = F.when(C("episodes") >= 3, C("net_pnl") < -50000)
    g = R.grid(s, d).groupBy("cohort").agg(F.bool_or(flag).alias("any"), F.count(flag).alias("n"))
    return g.select("cohort", F.when(C("any"), "FALSIFIED").when(C("n") == 0, "INDETERMINATE").otherwise("NOT_FALSIFIED").alias("verdict"))


@query("agg_19_range_drawdown", DAILY + f", q AS (SELECT symbol, t, {_Q} AS quarter, close FROM daily), m AS (SELECT symbol, quarter, close / max(close) OVER (PARTITION BY symbol, quarter ORDER BY t) - 1 AS dd FROM q) SELECT symbol, quarter, round(min(dd), 6) + 0.0 AS max_dd FROM m GROUP BY 1, 2")
def agg_19(s, d):
    q = R.bars_1d(s, d).withColumn("quarter", quarter_ordinal(C("t")))
    m = q.withColumn("dd", C("close") / F.max("close").over(past(["symbol", "quarter"])) - 1)
    return tidy(m.groupBy("symbol", "quarter").agg(F.min("dd").alias("x")), "symbol", "quarter", max_dd=C("x"))


@query("ev_01_ledger_reconciliation", EP + """, f AS (SELECT episode, sum(fee) AS ff, count(*) AS fn FROM fills GROUP BY 1), j AS (SELECT e.*, ff, fn FROM episodes e FULL JOIN f ON f.episode = e.episode),
r AS (SELECT symbol, count(episode) AS n, count(*) FILTER (episode IS NOT NULL AND (fn IS NULL OR NOT coalesce(abs(fees - ff) <= 0.001 AND n_fills = fn, false))) AS differ, count(*) FILTER (episode IS NOT NULL AND fn IS NULL) AS no_fills, count(*) FILTER (episode IS NULL) AS orphans, count(*) FILTER (exit_reason = 'F') AS exits_f, count(*) FILTER (exit_reason = 'O') AS exits_o, count(*) FILTER (exit_reason = 'P') AS exits_p, round(sum(gross), 2) + 0.0 AS gross, round(sum(fees), 2) + 0.0 AS fees, round(sum(funding), 2) + 0.0 AS funding FROM j GROUP BY 1),
d AS (SELECT symbol, t // 86400000 AS day, sum(gross - fees - funding) AS net FROM episodes GROUP BY 1, 2), c AS (SELECT symbol, day, sum(net) OVER w AS c FROM d WINDOW w AS (PARTITION BY symbol ORDER BY day)), p AS (SELECT symbol, c - max(c) OVER w AS dd, (1e12 + c) / (1e12 + lag(c) OVER w) - 1 AS ret FROM c WINDOW w AS (PARTITION BY symbol ORDER BY day)),
m AS (SELECT symbol, count(*) AS days, round(min(dd), 2) + 0.0 AS max_dd, round(avg(ret) / stddev_samp(ret) * sqrt(365), 4) + 0.0 AS sharpe FROM p GROUP BY 1)
SELECT r.*, exits_f + exits_o + exits_p = n AS partition_ok, days, max_dd, sharpe FROM r LEFT JOIN m ON m.symbol = r.symbol""")
def ev_01(s, d):
    """Each symbol's ledger beside its fills: episodes, exit reasons, sums, what differs or is missing, and drawdown and Sharpe recomputed from the daily nets."""
    from ..operators.evidence import equity_measures, reconcile

    e = R.episodes(s, d)
    nets = e.groupBy("symbol", day_of(C("t")).alias("day")).agg(F.sum(C("gross") - C("fees") - C("funding")).alias("net"))
    r, r2 = reconcile(e, R.fills(s, d)), lambda c: F.round(c, 2) + 0.0
    m = equity_measures(nets, "day", "net", 1e12)
    got = r.join(m, "symbol", "left").withColumns({c: r2(c) for c in ("gross", "fees", "funding", "max_dd")} | {"sharpe": F.round("sharpe", 4) + 0.0})
    return got.withColumn("partition_ok", C("exits_f") + C("exits_o") + C("exits_p") == C("n"))


@query("ev_02_identity", GRID + ", i AS (SELECT cohort, size, kind, grid, 'sv-' || substr(sha256('{\"cohort\":\"' || cohort || '\",\"grid\":\"' || grid || '\",\"kind\":\"' || kind || '\",\"size\":' || size || '}'), 1, 16) AS id FROM grid) SELECT *, count(*) OVER (PARTITION BY id) > 1 AS refused FROM i")
def ev_02(s, d):
    """Ids from canonical JSON; all rows of an id that repeats are refused."""
    from ..operators.evidence import identity

    x = R.grid(s, d).select("cohort", "size", "kind", "grid", identity("cohort", "grid", "kind", "size").alias("id"))
    return x.withColumn("refused", F.count("*").over(Window.partitionBy("id")) > 1)


@query("ev_04_evidence_state", SL + ", a AS (SELECT survivor, sum(n_episodes) AS n, sum(pnl) AS pnl FROM slices GROUP BY 1) SELECT c_custkey AS survivor, CASE WHEN n IS NULL THEN 'FROZEN_ONLY' WHEN n < 30 THEN 'ACCUMULATING' WHEN pnl > 0 THEN 'FORWARD_POSITIVE' ELSE 'FORWARD_DEGRADED' END AS state FROM customer LEFT JOIN a ON c_custkey = survivor")
def ev_04(s, d):
    a = R.slices(s, d).groupBy("survivor").agg(F.sum("n_episodes").alias("n"), F.sum("pnl").alias("pnl"))
    j = R.read(s, d, "customer").select(C("c_custkey").alias("survivor")).join(a, "survivor", "left")
    return j.select("survivor", F.when(C("n").isNull(), "FROZEN_ONLY").when(C("n") < 30, "ACCUMULATING").when(C("pnl") > 0, "FORWARD_POSITIVE").otherwise("FORWARD_DEGRADED").alias("state"))


@query("ev_05_axis_split", GRID + "SELECT cohort, count(*) AS n, max('size=' || size) AS strategy_axis, max('kind=' || kind) AS ladder_axis FROM grid GROUP BY 1")
def ev_05(s, d):
    axes = F.create_map(F.lit("size"), C("size").cast("string"), F.lit("kind"), C("kind"))
    text = lambda name: F.array_join(F.transform(F.map_entries(F.map_filter("m", lambda k, v: k == name)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return R.grid(s, d).withColumn("m", axes).groupBy("cohort").agg(F.count("*").alias("n"), F.max(text("size")).alias("strategy_axis"), F.max(text("kind")).alias("ladder_axis"))


@query("ev_06_lifecycle_events", with_roles("runs") + "SELECT 'complete' AS kind, run, t FROM runs WHERE state = 'done' UNION ALL SELECT 'running', run, t FROM runs WHERE state = 'running' UNION ALL SELECT 'preparing', run, t FROM runs WHERE state = 'started'")
def ev_06(s, d):
    x = R.run_events(s, d)
    part = lambda state, kind: x.where(C("state") == state).select(F.lit(kind).alias("kind"), "run", "t")
    return part("done", "complete").unionByName(part("running", "running")).unionByName(part("started", "preparing"))


@query("ev_07_runtime_state", with_roles("runs") + ", l AS (SELECT run, arg_max(state, ordinal) AS state, max(t) AS t FROM (SELECT *, max(t) OVER (PARTITION BY run) AS mt FROM runs) WHERE t = mt GROUP BY 1), n AS (SELECT max(t) AS now FROM runs) SELECT run, CASE WHEN state IN ('done', 'failed') THEN 'terminal' WHEN now - t > 5400000 THEN 'stale' ELSE 'in_flight' END AS status FROM l, n")
def ev_07(s, d):
    x = R.run_events(s, d)
    last = x.groupBy("run").agg(F.max(F.struct("t", "ordinal", "state")).alias("x")).select("run", "x.*")
    now = x.agg(F.max("t").alias("now"))
    return last.crossJoin(F.broadcast(now)).select("run", F.when(C("state").isin("done", "failed"), "terminal").when(C("now") - C("t") > 5_400_000, "stale").otherwise("in_flight").alias("status"))


@query("ev_08_open_incidents", with_roles("runs") + "SELECT f.run, f.ordinal FROM runs f WHERE f.state = 'failed' AND NOT EXISTS (SELECT 1 FROM runs d WHERE d.run = f.run AND d.state = 'done' AND d.t > f.t)")
def ev_08(s, d):
    x = R.run_events(s, d)
    done = x.where("state = 'done'").groupBy("run").agg(F.max("t").alias("last_done"))  # one row a run, so the anti join is an equi-join
    return x.where("state = 'failed'").join(done, "run", "left").where("last_done is null or last_done <= t").select("run", "ordinal")


@query("ev_09_progress", with_roles("runs") + "SELECT run, round(least(100.0, count(*) FILTER (state = 'done') * 100.0 / greatest(count(*) FILTER (state = 'started'), 1)), 6) + 0.0 AS pct FROM runs GROUP BY 1")
def ev_09(s, d):
    g = R.run_events(s, d).groupBy("run").agg(F.count_if(C("state") == "done").alias("a"), F.count_if(C("state") == "started").alias("b"))
    return tidy(g, "run", pct=F.least(F.lit(100.0), C("a") * 100.0 / F.greatest("b", F.lit(1))))


@query("ev_10_verdict_inputs", GRID + "SELECT grid, count(*) AS n, count(*) FILTER (episodes > 1) AS traded, round(sum(net_pnl), 4) + 0.0 AS net FROM grid GROUP BY 1")
def ev_10(s, d):
    return R.grid(s, d).groupBy("grid").agg(F.count("*").alias("n"), F.count_if(C("episodes") > 1).alias("traded"), (F.round(F.sum("net_pnl"), 4) + 0.0).alias("net"))


@query("fn_03_json", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k, event_type || ':' || (props::JSON->>'k') AS label FROM events")
def fn_03(s, d):
    k = F.get_json_object("props", "$.k")
    return R.read(s, d, "events").select("event_id", k.cast("long").alias("k"), F.concat_ws(":", "event_type", k).alias("label"))


@query("fn_04_arrays", "SELECT vec_id, len(embedding)::BIGINT AS n, round(list_max(embedding)::DOUBLE, 4) + 0.0 AS hi, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS positive FROM embeddings")
def fn_04(s, d):
    return R.read(s, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), (F.round(F.array_max("embedding").cast("double"), 4) + 0.0).alias("hi"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"))


@query("fn_05_fill_price", with_roles("fills") + "SELECT episode, level, round(price + 0.02, 9) + 0.0 AS buy_2_ticks, round(price - price * (pi() / 10000), 6) + 0.0 AS sell_bps FROM fills")
def fn_05(s, d):
    from ..functions.expr import fill_price

    buy, sell = fill_price(C("price"), F.lit(1), ticks=2), fill_price(C("price"), F.lit(-1), bps=math.pi)
    return R.fills(s, d).select("episode", "level", (F.round(buy, 9) + 0.0).alias("buy_2_ticks"), (F.round(sell, 6) + 0.0).alias("sell_bps"))


@query("src_01_bar_shards", with_roles("bars") + "SELECT symbol, count(*) AS n, min(t) AS first_t, round(sum(close), 4) + 0.0 AS closes FROM bars WHERE t BETWEEN 1704844800000 AND 1705708799999 GROUP BY 1")
def src_01(s, d):
    """Hourly and daily bars written as gzip JSON shards by symbol, interval and month; ten days of hourly bars scanned back, other intervals and months pruned by name."""
    from ..sources import stores as St

    shape = [C("t").alias("open_time_ms"), "open", "high", "low", "close", "volume"]
    hours = R.bars_1h(s, d).select("symbol", *shape, (C("t") + 3_599_999).alias("close_time_ms"), F.lit("1h").alias("interval"))
    days = R.bars_1d(s, d).select("symbol", *shape, (C("t") + 86_399_999).alias("close_time_ms"), F.lit("1d").alias("interval"))
    root = St.scratch(s, "shards")
    St.write_bar_shards(hours.unionByName(days), root)
    x = St.scan_shards(s, root, intervals=["1h"], start_ms=1_704_844_800_000, end_ms=1_705_708_799_999)
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.min("open_time_ms").alias("first_t"), r4(F.sum("close")).alias("closes"))


@query("src_02_settlement_scan", with_roles("settlements") + "SELECT status, count(*) AS n FROM settlements GROUP BY 1")
def src_02(s, d):
    from ..sources import stores as St

    path = St.scratch(s, "settlements")
    R.settlements(s, d).select(C("st").alias("funding_time_ms"), C("rate").alias("funding_rate"), C("mark").alias("mark_price"), C("status").alias("truth_status")).write.json(path)
    good, refused = St.scan_settlements(s, path)
    return good.groupBy(C("truth_status").alias("status")).agg(F.count("*").alias("n")).unionByName(refused.where("refused is not null").select(C("truth_status").alias("status"), C("count").alias("n")))


@query("src_05_grid_sink", GRID + "SELECT grid, count(*) AS n, round(sum(net_pnl), 4) + 0.0 AS net FROM grid GROUP BY 1")
def src_05(s, d):
    from ..sources import stores as St

    path = St.scratch(s, "grids")
    St.write_grid(R.grid(s, d), path)
    return s.read.parquet(path).groupBy("grid").agg(F.count("*").alias("n"), (F.round(F.sum("net_pnl"), 4) + 0.0).alias("net"))


@query("src_06_grid_csv_scan", GRID + "SELECT grid, count(*) AS n, sum(episodes)::BIGINT AS episodes FROM grid GROUP BY 1")
def src_06(s, d):
    from ..sources import stores as St

    path = St.scratch(s, "grid-csv")
    St.write_grid(R.grid(s, d), path, fmt="csv")
    x = s.read.schema("cohort string, size long, kind string, net_pnl double, sharpe double, episodes long, grid string").option("header", True).csv(path)
    return x.groupBy("grid").agg(F.count("*").alias("n"), F.sum("episodes").alias("episodes"))


@query("src_11_universe_legality", "SELECT p_brand AS symbol, count(*) AS parts, bool_and(p_retailprice IS NOT NULL) AND count(*) > 5 AS legal FROM part GROUP BY 1")
def src_11(s, d):
    return R.read(s, d, "part").groupBy(C("p_brand").alias("symbol")).agg(F.count("*").alias("parts"), (F.bool_and(C("p_retailprice").isNotNull()) & (F.count("*") > 5)).alias("legal"))


@query("src_09_dataset_inventory", with_roles("bars") + "SELECT symbol, count(*) AS n, min(t) AS first_t, max(t) AS last_t, symbol IN ('click', 'view', 'purchase') AS required FROM bars GROUP BY 1")
def src_09(s, d):
    g = R.bars_1h(s, d).groupBy("symbol").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return g.withColumn("required", C("symbol").isin("click", "view", "purchase"))
