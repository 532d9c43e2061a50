"""Further forms of operators that other modules have in their first form."""

from pyspark.sql import functions as F

from ..functions.expr import month_ordinal, over, past, rolling, same_time, tidy
from ..operators import models as M
from ..operators import rolling as W
from ..operators import statistics as T
from ..registry import query
from ..sources import roles as R
from ..sources.roles import DAY_MS, with_roles

C = F.col
BARS, DAILY = with_roles("bars"), with_roles("daily")
_R = ", x AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS r FROM {}) "
_BETA = "CASE WHEN count({x}) OVER f >= 20 AND avg({x} * {x}) OVER f - (avg({x}) OVER f) * (avg({x}) OVER f) > 1e-14 THEN (avg({x} * {y}) OVER f - (avg({x}) OVER f) * (avg({y}) OVER f)) / (avg({x} * {x}) OVER f - (avg({x}) OVER f) * (avg({x}) OVER f)) END"
_SD20 = "CASE WHEN count(r) OVER f = 20 THEN stddev_pop(r) OVER f END"


@query("sig_07_ar1_baseline", BARS + _R.format("bars") + ", l AS (SELECT symbol, t, r, lag(r) OVER (PARTITION BY symbol ORDER BY t) AS p FROM x), k AS (SELECT symbol, t, r, CASE WHEN p IS NOT NULL THEN r END AS y, p FROM l WHERE r IS NOT NULL), b AS (SELECT symbol, t, r, " + _BETA.format(x="p", y="y") + " AS phi FROM k WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)) SELECT symbol, t, round(phi, 6) + 0.0 AS phi, round(phi * r, 6) + 0.0 AS forecast FROM b")
def sig_07_ar1(s, d):
    """Forecast of the next return by the slope of returns on those before, over the 48 rows before this one."""
    x = W.with_log_return(R.bars_1h(s, d)).withColumn("p", F.lag("r").over(over())).where("r is not null")
    x = x.withColumn("phi", W.trailing_beta(C("r"), C("p"), 48, 20))
    return tidy(x, "symbol", "t", phi=C("phi"), forecast=C("phi") * C("r"))


@query("win_23_index_features", DAILY + _R.format("daily") + ", v AS (SELECT symbol, t, r, " + _SD20 + " AS own FROM x WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), g AS (SELECT t, avg(r) AS r, avg(own) AS own FROM v GROUP BY 1 HAVING avg(r) IS NOT NULL), l AS (SELECT *, exp(sum(r) OVER (ORDER BY t)) AS level FROM g) SELECT t, " + ", ".join(f"round(CASE WHEN count(r) OVER w{n} = {n} THEN sum(r) OVER w{n} END, 6) + 0.0 AS ret{n}" for n in (1, 5, 20, 60)) + ", " + ", ".join(f"round(CASE WHEN count(r) OVER w{n} = {n} THEN stddev_pop(r) OVER w{n} END, 6) + 0.0 AS vol{n}" for n in (5, 20, 60)) + ", round(CASE WHEN count(r) OVER w20 = 20 THEN stddev_pop(CASE WHEN r < 0 THEN r END) OVER w20 END, 6) + 0.0 AS downside20, round(level / max(level) OVER w60 - 1, 6) + 0.0 AS dd60, round(own, 6) + 0.0 AS symbol_vol20 FROM l WINDOW " + ", ".join(f"w{n} AS (ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (1, 5, 20, 60)))
def win_23_index(s, d):
    """Features of the market index (mean log return of all symbols); after the mean there is one row a day, which one sort holds."""
    x = W.with_log_return(R.bars_1d(s, d)).withColumn("own", rolling(C("r"), 20, F.stddev_pop))
    g = x.groupBy("t").agg(F.avg("r").alias("r"), F.avg("own").alias("own")).where("r is not null").withColumn("market", F.lit(1))
    g = g.withColumn("level", F.exp(F.sum("r").over(past("market"))))
    back = lambda n: over("market").rowsBetween(1 - n, 0)
    full = lambda c, n: F.when(F.count("r").over(back(n)) == n, c.over(back(n)))
    return tidy(
        g, "t", **{f"ret{n}": full(F.sum("r"), n) for n in (1, 5, 20, 60)}, **{f"vol{n}": full(F.stddev_pop("r"), n) for n in (5, 20, 60)},
        downside20=full(F.stddev_pop(F.when(C("r") < 0, C("r"))), 20), dd60=C("level") / F.max("level").over(back(60)) - 1, symbol_vol20=C("own"),
    )


@query("agg_17_split_half", BARS + _R.format("bars") + ", k AS (SELECT symbol, sign(r) AS a, lead(sign(r)) OVER w AS b, ntile(2) OVER w AS half FROM x WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY t)), p AS (SELECT symbol, a, half, count(b) AS n, avg(CASE WHEN b > 0 THEN 1.0 ELSE 0.0 END) FILTER (b IS NOT NULL) AS up FROM k GROUP BY 1, 2, 3), h AS (SELECT symbol, a, max(up) FILTER (half = 1) - max(up) FILTER (half = 2) AS gap FROM p WHERE n >= 20 GROUP BY 1, 2) SELECT symbol, count(gap) AS states, round(max(abs(gap)), 6) + 0.0 AS deviation FROM h GROUP BY 1")
def agg_17_halves(s, d):
    """Largest gap between the halves of a history in the chance that an up bar follows a state, of states with 20 rows in both."""
    w = over()
    x = W.with_log_return(R.bars_1h(s, d)).where("r is not null")
    k = x.select("symbol", F.signum("r").alias("a"), F.lead(F.signum("r")).over(w).alias("b"), F.ntile(2).over(w).alias("half"))
    p = k.groupBy("symbol", "a", "half").agg(F.count("b").alias("n"), F.avg((C("b") > 0).cast("double")).alias("up")).where("n >= 20")
    one = lambda i: F.max(F.when(C("half") == i, C("up")))
    h = p.groupBy("symbol", "a").agg((one(1) - one(2)).alias("gap")).groupBy("symbol").agg(F.count("gap").alias("states"), F.max(F.abs("gap")).alias("g"))
    return tidy(h, "symbol", "states", deviation=C("g"))


@query("agg_08_two_regressors", DAILY + ", m AS (SELECT symbol, count(*) AS n, covar_pop(close, open) AS cy1, covar_pop(close, volume) AS cy2, var_pop(open) AS v1, var_pop(volume) AS v2, covar_pop(open, volume) AS c12 FROM daily GROUP BY 1 HAVING count(*) >= 10) SELECT symbol, n, round((cy1 * v2 - cy2 * c12) / (v1 * v2 - c12 * c12), 4) + 0.0 AS on_open, round((cy2 * v1 - cy1 * c12) / (v1 * v2 - c12 * c12), 2) + 0.0 AS on_volume FROM m")
def agg_08_two(s, d):
    """Least squares of close on open and volume by symbol, from Gram sums, with an intercept and ten rows at least."""
    x = R.bars_1d(s, d).select("symbol", C("close").alias("y"), C("open").alias("x0"), C("volume").alias("x1"))
    g = M.grouped_ols(x, "symbol", "y", ["x0", "x1"], ridge=0.0).where("n >= 10")
    return tidy(g, "symbol", "n", on_open=F.round(F.element_at("coef", 2), 4), on_volume=F.round(F.element_at("coef", 3), 2))


@query("stat_10_fejer_ratio", BARS + _R.format("bars") + ", c AS (SELECT symbol, t, r - avg(r) OVER p AS e, var_pop(r) OVER p AS v, count(*) OVER p AS n FROM x WHERE r IS NOT NULL WINDOW p AS (PARTITION BY symbol)), l AS (SELECT symbol, v, n, " + ", ".join(f"e * lag(e, {k}) OVER w AS p{k}" for k in range(1, 5)) + " FROM c WINDOW w AS (PARTITION BY symbol ORDER BY t)) SELECT symbol, round(1 + 2 * (" + " + ".join(f"(1 - {k} / 5.0) * sum(p{k}) / (max(n) - {k}) / max(v)" for k in range(1, 5)) + "), 6) + 0.0 AS ratio FROM l GROUP BY 1")
def stat_10_fejer(s, d):
    """The variance ratio of five periods rebuilt from autocorrelations with triangular weights."""
    rho = T.autocorrelation(W.with_log_return(R.bars_1h(s, d)).where("r is not null"), "r", [1, 2, 3, 4])
    return tidy(rho.groupBy("symbol").agg((1 + 2 * F.sum((1 - C("k") / 5) * C("rho"))).alias("q")), "symbol", ratio=C("q"))


_MONTH = "(year(make_timestamp(t * 1000)) * 12 + month(make_timestamp(t * 1000)) - 1)::BIGINT"


@query("pf_12_monthly_year_alpha", DAILY + f", m AS (SELECT t, avg(close) AS mkt FROM daily GROUP BY 1), a AS (SELECT symbol, t, close, mkt, {_MONTH} AS month FROM daily JOIN m USING (t)), f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY symbol, month ORDER BY t) = 1), y AS (SELECT f.symbol, f.month, b.close / f.close - b.mkt / f.mkt AS alpha FROM f ASOF JOIN a b ON f.symbol = b.symbol AND f.t + 31536000000 <= b.t) SELECT symbol, month, round(alpha, 6) + 0.0 AS alpha FROM y")
def pf_12_monthly(s, d):
    """Return over the market in the 365 days from the first row of each month."""
    from ..operators.joins import next_row

    x = R.bars_1d(s, d)
    a = x.withColumn("mkt", F.avg("close").over(same_time())).select("symbol", "t", "close", "mkt", month_ordinal(C("t")).alias("month"))
    first = a.groupBy("symbol", "month").agg(F.min(F.struct("t", "close", "mkt")).alias("x")).select("symbol", "month", "x.*", (C("x.t") + 365 * DAY_MS - 1).alias("due"))
    later = a.select("symbol", C("t").alias("t2"), C("close").alias("c2"), C("mkt").alias("m2"))
    y = next_row(first, later, key="symbol", left_time="due", right_time="t2", values=["c2", "m2"]).where("next_at is not null")
    return tidy(y, "symbol", "month", alpha=C("c2") / C("close") - C("m2") / C("mkt"))


@query("stat_15_area_by_year", DAILY + ", p AS (SELECT a.symbol AS a, b.symbol AS b, a.t, a.t // 2592000000 AS win, ln(a.close) AS x, ln(b.close) AS y FROM daily a JOIN daily b ON a.t = b.t AND a.symbol < b.symbol), l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY a, b, win ORDER BY t)), s AS (SELECT a, b, win, year(make_timestamp(min(t) * 1000))::BIGINT AS year, sum(px * (y - py) - py * (x - px)) AS area FROM l GROUP BY 1, 2, 3) SELECT a, b, year, count(area) AS n, round(avg(area) / (stddev_samp(area) / sqrt(count(area))), 6) + 0.0 AS t_value FROM s GROUP BY 1, 2, 3 HAVING count(area) >= 6")
def stat_15_year(s, d):
    """t of the mean signed area of pairs of log prices over windows of 30 days, by year, with six windows at least."""
    from ..functions.expr import date_of
    from ..operators.joins import symbol_pairs

    p = symbol_pairs(R.bars_1d(s, d).withColumn("close", F.log("close")), "close").withColumn("win", F.floor(C("t") / (30 * DAY_MS)))
    w = over(["a", "b", "win"])
    p = p.withColumns({"px": F.lag("ra").over(w), "py": F.lag("rb").over(w)})
    areas = p.groupBy("a", "b", "win").agg(F.min("t").alias("t"), F.sum(C("px") * (C("rb") - C("py")) - C("py") * (C("ra") - C("px"))).alias("area"))
    g = areas.groupBy("a", "b", F.year(date_of(C("t"))).cast("long").alias("year")).agg(F.count("area").alias("n"), (F.avg("area") / (F.stddev_samp("area") / F.sqrt(F.count("area")))).alias("tv"))
    return tidy(g.where("n >= 6"), "a", "b", "year", "n", t_value=C("tv"))


@query("stat_07_shuffled_values", with_roles("bars") + ", n AS (SELECT symbol, t, close, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i, row_number() OVER (PARTITION BY symbol ORDER BY md5('42:' || symbol || ':' || t)) AS j FROM bars) SELECT a.symbol, a.t, round(b.close, 6) + 0.0 AS placebo FROM n a JOIN n b ON a.symbol = b.symbol AND a.i = b.j")
def stat_07_shuffled(s, d):
    """Closes of each symbol in random order."""
    from ..operators.statistics import shuffled

    return tidy(shuffled(R.bars_1h(s, d).select("symbol", "t", "close"), "close"), "symbol", "t", placebo=F.col("placebo"))


_UNIFORM = "(('0x' || substr(md5({x}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496"


@query("stat_07_random_walk", with_roles("bars") + ", x AS (SELECT symbol, t, close, ln(close / lag(close) OVER w) AS s, first_value(close) OVER w AS f FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)), z AS (SELECT *, CASE WHEN s IS NULL THEN 0 ELSE stddev_pop(s) OVER (PARTITION BY symbol) * sqrt(-2 * ln(" + _UNIFORM.format(x="'42:' || symbol || ':' || t") + ")) * cos(2 * pi() * " + _UNIFORM.format(x="'43:' || symbol || ':' || t") + ") END AS e FROM x) SELECT symbol, t, round(ln(f * exp(sum(e) OVER (PARTITION BY symbol ORDER BY t))), 6) + 0.0 AS log_placebo FROM z")
def stat_07_walk(s, d):
    """Logs of a random walk in place of each symbol's closes."""
    from ..operators.statistics import random_walk

    return tidy(random_walk(R.bars_1h(s, d).select("symbol", "t", "close"), "close"), "symbol", "t", log_placebo=F.log("placebo"))
