"""Signals, cross-section and portfolio queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import ln, over, rolling, same_time, sigmoid, tidy
from ..operators import portfolio as P
from ..operators import rolling as W
from ..operators.joins import symbol_pairs
from ..operators.statistics import average_rank
from ..registry import query
from ..sources import roles as R
from ..sources.roles import with_roles

C = F.col
BARS, DAILY = with_roles("bars"), with_roles("daily")
RET = ", x AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS r FROM bars) "


def _r(x, name):
    return f"round({x}, 6) + 0.0 AS {name}"


def with_r(s, d):
    return W.with_log_return(R.bars_1h(s, d))


def crossings(bars, w=20):
    """Bars whose close comes above its mean of w bars, and was not above on the bar before."""
    above = bars.withColumn("above", C("close") > W.sma(C("close"), w))
    return above.withColumn("fresh", F.coalesce(C("above"), F.lit(False)) & ~F.coalesce(F.lag("above").over(over()), F.lit(False)))


_CROSS = ", a AS (SELECT symbol, t, open, high, low, close, CASE WHEN count(*) OVER f = 20 THEN close > avg(close) OVER f END AS above FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), c AS (SELECT *, coalesce(above, false) AND NOT coalesce(lag(above) OVER (PARTITION BY symbol ORDER BY t), false) AS fresh FROM a) "


@query("sig_01_fresh_crossing", BARS + _CROSS + "SELECT symbol, t, fresh FROM c")
def sig_01(s, d):
    return crossings(R.bars_1h(s, d)).select("symbol", "t", "fresh")


@query("sig_02_line_cross", BARS + ", a AS (SELECT symbol, t, avg(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) - avg(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS g FROM bars) SELECT symbol, t, CASE WHEN g > 0 AND l < 0 THEN 1 WHEN g < 0 AND l > 0 THEN -1 ELSE 0 END::BIGINT AS cross_dir FROM (SELECT *, lag(g) OVER (PARTITION BY symbol ORDER BY t) AS l FROM a)")
def sig_02(s, d):
    gap = F.avg("close").over(over().rowsBetween(-4, 0)) - F.avg("close").over(over().rowsBetween(-19, 0))
    x = R.bars_1h(s, d).withColumn("g", gap).withColumn("l", F.lag("g").over(over()))
    return x.select("symbol", "t", F.when((C("g") > 0) & (C("l") < 0), 1).when((C("g") < 0) & (C("l") > 0), -1).otherwise(0).cast("long").alias("cross_dir"))


@query("sig_03_three_in_a_row", BARS + ", a AS (SELECT symbol, t, close > open AS up FROM bars) SELECT symbol, t, coalesce(up = l1 AND up = l2, false) AS stable FROM (SELECT *, lag(up) OVER w AS l1, lag(up, 2) OVER w AS l2 FROM a WINDOW w AS (PARTITION BY symbol ORDER BY t))")
def sig_03(s, d):
    x = R.bars_1h(s, d).withColumn("up", C("close") > C("open"))
    return x.select("symbol", "t", F.coalesce((C("up") == F.lag("up").over(over())) & (C("up") == F.lag("up", 2).over(over())), F.lit(False)).alias("stable"))


@query("sig_05_lag3_contrarian", BARS + RET + "SELECT symbol, t, -sign(lag(r, 2) OVER (PARTITION BY symbol ORDER BY t))::BIGINT AS side FROM x QUALIFY lag(r, 2) OVER (PARTITION BY symbol ORDER BY t) <> 0")
def sig_05(s, d):
    x = with_r(s, d).withColumn("q", F.lag("r", 2).over(over()))
    return x.where("q <> 0").select("symbol", "t", (-F.signum("q")).cast("long").alias("side"))


@query("sig_06_percentile_extreme", BARS + ", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM bars), p AS (SELECT a.symbol, a.t, CASE WHEN a.i >= 48 THEN count(*) FILTER (b.close <= a.close) / 48.0 END AS pct FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 47 AND a.i GROUP BY a.symbol, a.t, a.i) SELECT symbol, t, round(pct, 6) + 0.0 AS pct FROM p WHERE pct <= 0.1")
def sig_06(s, d):
    x = R.bars_1h(s, d).withColumn("pct", W.rank_in_rows(C("close"), 48)).where("pct <= 0.1")
    return tidy(x, "symbol", "t", pct=C("pct"))


@query("sig_07_baselines", BARS + RET + "SELECT symbol, t, sign(sum(r) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))::BIGINT AS momentum, -sign(r)::BIGINT AS reversal, sign(sum(r) OVER (PARTITION BY symbol, (t // 3600000) % 24 ORDER BY t ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))::BIGINT AS same_hour FROM x")
def sig_07(s, d):
    """Where a close comes again, the sum of returns is zero but for the last bits of the logarithms, so these are the C library's, as in the SQL."""
    x = R.bars_1h(s, d).withColumn("r", ln(C("close") / F.lag("close").over(over()))).withColumn("h", F.floor(C("t") / 3_600_000) % 24)
    sg = lambda c: F.signum(c).cast("long")
    return x.select("symbol", "t", sg(F.sum("r").over(over().rowsBetween(-5, 0))).alias("momentum"), (-sg(C("r"))).alias("reversal"), sg(F.sum("r").over(over(["symbol", "h"]).rowsBetween(-5, -1))).alias("same_hour"))


_STATE = ", st AS (SELECT symbol, t, CASE WHEN d < -5 THEN 0 WHEN d < 0 THEN 1 WHEN d < 5 THEN 2 WHEN d IS NOT NULL THEN 3 ELSE -1 END * 3 + CASE WHEN volume < m * 0.8 THEN 0 WHEN volume < m * 1.2 THEN 1 ELSE 2 END AS joint, d IS NULL OR n < 24 AS unknown FROM (SELECT *, close - lag(close) OVER w AS d, avg(volume) OVER f AS m, count(*) OVER f AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t), f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))), sv AS (SELECT symbol, t, CASE WHEN unknown THEN -1 ELSE joint END::BIGINT AS state FROM st) "


def _states(s, d):
    dd, m, n = C("close") - F.lag("close").over(over()), F.avg("volume").over(over().rowsBetween(-23, 0)), F.count("*").over(over().rowsBetween(-23, 0))
    x = R.bars_1h(s, d).withColumns({"d": dd, "m": m, "n": n})
    price = F.when(C("d") < -5, 0).when(C("d") < 0, 1).when(C("d") < 5, 2).otherwise(3)
    volume = F.when(C("volume") < C("m") * 0.8, 0).when(C("volume") < C("m") * 1.2, 1).otherwise(2)
    return x.select("symbol", "t", "d", F.when(C("d").isNull() | (C("n") < 24), -1).otherwise(price * 3 + volume).cast("long").alias("state"))


@query("sig_08_price_volume_state", BARS + _STATE + "SELECT * FROM sv")
def sig_08(s, d):
    return _states(s, d).drop("d")


@query("sig_09_markov_row", BARS + _STATE + ", k AS (SELECT symbol, t, state, lag(state) OVER w AS p1, lead(state) OVER w AS nx FROM sv WINDOW w AS (PARTITION BY symbol ORDER BY t)), c AS (SELECT symbol, t, state, p1, count(*) FILTER (nx >= 6) OVER g AS up, count(nx) OVER g AS n FROM k WINDOW g AS (PARTITION BY symbol, state, p1 ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT symbol, t, n, round(CASE WHEN n >= 5 THEN up * 1.0 / n END, 6) + 0.0 AS p_up, (CASE WHEN n < 5 THEN 0 WHEN 2 * up > n THEN 1 WHEN 2 * up < n THEN -1 ELSE 0 END)::BIGINT AS side FROM c")
def sig_09(s, d):
    x = _states(s, d).withColumns({"p1": F.lag("state").over(over()), "nx": F.lead("state").over(over())})
    g = over(["symbol", "state", "p1"]).rowsBetween(Window.unboundedPreceding, -1)  # outcomes of earlier rows are known by now
    x = x.withColumns({"n": F.count("nx").over(g), "up": F.coalesce(F.sum((C("nx") >= 6).cast("int")).over(g), F.lit(0))})
    side = F.when(C("n") < 5, 0).when(2 * C("up") > C("n"), 1).when(2 * C("up") < C("n"), -1).otherwise(0)
    return tidy(x.withColumn("side", side.cast("long")), "symbol", "t", "n", "side", p_up=F.when(C("n") >= 5, C("up") / C("n")))


@query("sig_10_transition_matrix", BARS + _STATE + ", k AS (SELECT symbol, state AS a, lead(state) OVER (PARTITION BY symbol ORDER BY t) AS b FROM sv) SELECT a, b, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY a), 6) + 0.0 AS p FROM k WHERE b IS NOT NULL GROUP BY 1, 2")
def sig_10(s, d):
    x = _states(s, d).select(C("state").alias("a"), F.lead("state").over(over()).alias("b")).where("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    return tidy(x, "a", "b", "n", p=C("n") / F.sum("n").over(Window.partitionBy("a")))


@query("sig_11_exposure_band", BARS + ", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM bars), p AS (SELECT a.symbol, a.t, CASE WHEN a.i >= 24 THEN count(*) FILTER (b.close <= a.close) / 24.0 END AS pct FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 23 AND a.i GROUP BY a.symbol, a.t, a.i) SELECT symbol, t, CASE WHEN pct IS NULL THEN NULL WHEN pct < 0.1 THEN 0.0 WHEN pct < 0.3 THEN 0.3 WHEN pct < 0.6 THEN 0.6 WHEN pct < 0.9 THEN 0.9 ELSE 1.2 END::DOUBLE AS exposure FROM p")
def sig_11(s, d):
    x = R.bars_1h(s, d).withColumn("p", W.rank_in_rows(C("close"), 24))
    return x.select("symbol", "t", F.when(C("p") < 0.1, 0.0).when(C("p") < 0.3, 0.3).when(C("p") < 0.6, 0.6).when(C("p") < 0.9, 0.9).when(C("p").isNotNull(), 1.2).alias("exposure"))


_LAGS = ("", "1", "2")


@query("sig_12_peer_distance", BARS + ", l AS (SELECT symbol, t, close AS c, lag(close) OVER w AS c1, lag(close, 2) OVER w AS c2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)), z AS (SELECT symbol, t, " + ", ".join(f"(c{k} - avg(c{k}) OVER a) / nullif(stddev_pop(c{k}) OVER a, 0) AS z{k}" for k in _LAGS) + " FROM l WHERE c2 IS NOT NULL WINDOW a AS (PARTITION BY t)), p AS (SELECT a.symbol, a.t, a.z, a.z1, a.z2, b.z AS b, b.z1 AS b1, b.z2 AS b2, round(sqrt((a.z - b.z) * (a.z - b.z) + (a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2)), 9) AS dist FROM z a JOIN z b ON a.t = b.t AND a.symbol <> b.symbol), m AS (SELECT *, dist <= 1.25 * quantile_cont(dist, 0.5) OVER (PARTITION BY symbol, t) OR dist = min(dist) OVER (PARTITION BY symbol, t) AS near FROM p WHERE dist IS NOT NULL), g AS (SELECT symbol, t, count(*) FILTER (near) AS peers, max(z) AS z, max(z1) AS z1, max(z2) AS z2, avg(b) FILTER (near) AS b, avg(b1) FILTER (near) AS b1, avg(b2) FILTER (near) AS b2 FROM m GROUP BY 1, 2) SELECT symbol, t, peers, round(sign(round(z - b, 9)) * sqrt((z - b) * (z - b) + (z1 - b1) * (z1 - b1) + (z2 - b2) * (z2 - b2)), 6) + 0.0 AS score FROM g")
def sig_12(s, d):
    """Signed distance of a symbol's standardised last three closes to the mean of its peers: those within 1.25 times the median distance, else the nearest."""
    zs = [f"z{k}" for k in _LAGS]
    x = R.bars_1h(s, d).select("symbol", "t", *[F.lag("close", n).over(over()).alias(f"c{k}") for n, k in enumerate(_LAGS)]).where("c2 is not null")
    w = same_time()
    z = x.select("symbol", "t", *[((C(f"c{k}") - F.avg(f"c{k}").over(w)) / F.nullif(F.stddev_pop(f"c{k}").over(w), F.lit(0.0))).alias(f"z{k}") for k in _LAGS])
    b = z.select(C("symbol").alias("s2"), "t", *[C(c).alias(f"b{c}") for c in zs])
    apart = lambda a, b: F.sqrt(sum(((C(f"{a}{c}") - C(f"{b}{c}")) ** 2 for c in zs), F.lit(0.0)))
    p = z.join(b, "t").where("symbol <> s2").withColumn("dist", F.round(apart("", "b"), 9)).where("dist is not null")
    each = Window.partitionBy("symbol", "t")
    p = p.withColumn("near", (C("dist") <= 1.25 * F.percentile("dist", 0.5).over(each)) | (C("dist") == F.min("dist").over(each)))
    g = p.groupBy("symbol", "t").agg(F.count_if("near").alias("peers"), *[F.max(c).alias(c) for c in zs], *[F.avg(F.when(C("near"), C(f"b{c}"))).alias(f"m{c}") for c in zs])
    return tidy(g, "symbol", "t", "peers", score=F.signum(F.round(C("z") - C("mz"), 9)) * apart("", "m"))


@query("sig_13_residual_anomaly", BARS + ", y AS (SELECT symbol, t, close AS y, avg(close) OVER (PARTITION BY t) AS x FROM bars), b AS (SELECT *, CASE WHEN count(x) OVER f >= 20 AND avg(x*x) OVER f - (avg(x) OVER f) * (avg(x) OVER f) > 1e-14 THEN (avg(x*y) OVER f - (avg(x) OVER f) * (avg(y) OVER f)) / (avg(x*x) OVER f - (avg(x) OVER f) * (avg(x) OVER f)) END AS beta FROM y WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)), e AS (SELECT symbol, t, y - beta * x AS e FROM b) SELECT symbol, t, round(CASE WHEN count(e) OVER g = 24 THEN e / nullif(stddev_pop(e) OVER g, 0) END, 5) + 0.0 AS score FROM e WINDOW g AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)")
def sig_13(s, d):
    x = R.bars_1h(s, d).withColumn("x", F.avg("close").over(same_time()))
    x = x.withColumn("beta", W.trailing_beta(C("close"), C("x"), 48, 20)).withColumn("e", C("close") - C("beta") * C("x"))
    score = F.when(F.count("e").over(over().rowsBetween(-23, 0)) == 24, C("e") / F.nullif(F.stddev_pop("e").over(over().rowsBetween(-23, 0)), F.lit(0.0)))
    return x.select("symbol", "t", (F.round(score, 5) + 0.0).alias("score"))


@query("sig_14_quantile_gate", BARS + RET + ", z AS (SELECT symbol, t, r * (1 - 0.5 * coalesce(stddev_pop(r) OVER w / nullif(max(abs(r)) OVER w, 0), 0)) AS sg FROM x WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), q AS (SELECT *, quantile_cont(abs(sg), 0.8) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS q, avg(abs(sg)) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS m FROM z) SELECT symbol, t, round(CASE WHEN abs(sg) > q AND m > 0 THEN least(greatest(sg * 0.5 / m, -1.2), 1.2) ELSE 0.0 END, 6) + 0.0 AS exposure FROM q")
def sig_14(s, d):
    """The signal r is damped by 1 - kappa p (kappa 0.5, p the dispersion of the last 20 returns over their largest move), is zero unless it passes the
    80 % point of its own history, and is scaled so that the mean exposure so far would be 0.5, capped at 1.2."""
    from ..functions.expr import clamp, frame, past
    from ..operators.orderstats import expanding_quantile

    w = frame(-19, 0)
    p = F.coalesce(F.stddev_pop("r").over(w) / F.nullif(F.max(F.abs("r")).over(w), F.lit(0.0)), F.lit(0.0))
    x = with_r(s, d).where("r is not null").withColumn("sg", C("r") * (1 - 0.5 * p)).withColumn("size", F.abs("sg"))
    x = expanding_quantile(x.withColumn("m", F.avg("size").over(past())), "size", 0.8, "q")
    return tidy(x, "symbol", "t", exposure=F.when((C("size") > C("q")) & (C("m") > 0), clamp(C("sg") * 0.5 / C("m"), -1.2, 1.2)).otherwise(0.0))


@query("sig_15_network_momentum", BARS + RET + ", v AS (SELECT symbol, t, r, lag(r) OVER w AS r1, lag(r, 2) OVER w AS r2 FROM x WINDOW w AS (PARTITION BY symbol ORDER BY t)), p AS (SELECT a.symbol, a.t, b.r, 1 / (pow((a.r - b.r) * (a.r - b.r) + (a.r1 - b.r1) * (a.r1 - b.r1) + (a.r2 - b.r2) * (a.r2 - b.r2), 2) + 1) AS w FROM v a JOIN v b ON a.t = b.t AND a.symbol <> b.symbol WHERE a.r2 IS NOT NULL AND b.r2 IS NOT NULL), s AS (SELECT symbol, t, sum(w * r) / sum(w) AS q FROM p GROUP BY 1, 2) SELECT symbol, t, round(exp(0.5) * q * exp(-q * q / 2), 6) + 0.0 AS score, sign(round(q, 9))::BIGINT AS state FROM s")
def sig_15(s, d):
    """Returns of the others, weighted by 1 / (W^2 + 1) with W the squared distance of the last three returns, rows summing to 1; the response falls off for large values."""
    v = with_r(s, d).select("symbol", "t", "r", F.lag("r").over(over()).alias("r1"), F.lag("r", 2).over(over()).alias("r2")).where("r2 is not null")
    b = v.select(C("symbol").alias("j"), "t", *[C(c).alias(f"b{c}") for c in ("r", "r1", "r2")])
    far = sum(((C(c) - C(f"b{c}")) ** 2 for c in ("r", "r1", "r2")), F.lit(0.0))
    p = v.join(b, "t").where("symbol <> j").withColumn("w", 1 / (far**2 + 1))
    q = p.groupBy("symbol", "t").agg((F.sum(C("w") * C("br")) / F.sum("w")).alias("q")).withColumn("state", F.signum(F.round("q", 9)).cast("long"))
    return tidy(q, "symbol", "t", "state", score=F.exp(F.lit(0.5)) * C("q") * F.exp(-C("q") * C("q") / 2))


@query("sig_16_health_gate", BARS + ", h AS (SELECT t, avg(close) AS m, coalesce(stddev_pop(close), 0) AS dis FROM bars GROUP BY 1), z AS (SELECT t, CASE WHEN count(*) OVER p >= 30 AND stddev_pop(m) OVER p > 0 THEN (m - avg(m) OVER p) / stddev_pop(m) OVER p END AS zm, CASE WHEN count(*) OVER p >= 30 AND stddev_pop(dis) OVER p > 0 THEN (dis - avg(dis) OVER p) / stddev_pop(dis) OVER p END AS zd FROM h WINDOW p AS (ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT t, round(1 / (1 + exp(-(zm - 0.3 * zd))), 6) + 0.0 AS gate FROM z")
def sig_16(s, d):
    h = R.bars_1h(s, d).groupBy("t").agg(F.avg("close").alias("m"), F.stddev_pop("close").alias("dis")).withColumn("market", F.lit(1))
    z = h.withColumns({"zm": W.expanding_z(C("m"), 30, "market", strict=True), "zd": W.expanding_z(C("dis"), 30, "market", strict=True)})
    return tidy(z, "t", gate=sigmoid(C("zm") - 0.3 * C("zd")))


@query("sig_17_sized_score", BARS + RET + ", v AS (SELECT symbol, t, r, CASE WHEN count(r) OVER f = 20 THEN stddev_samp(r) OVER f END AS vol FROM x WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)), c AS (SELECT *, quantile_cont(vol, 0.85) OVER (PARTITION BY t) AS cap FROM v WHERE vol > 0) SELECT symbol, t, round(r * least(1, 0.05 / sqrt(vol)) * CASE WHEN vol > cap THEN 0.5 ELSE 1 END, 6) + 0.0 AS score FROM c")
def sig_17(s, d):
    x = with_r(s, d).withColumn("vol", rolling(C("r"), 20, F.stddev_samp)).where("vol > 0").withColumn("cap", F.percentile("vol", 0.85).over(same_time()))
    return tidy(x, "symbol", "t", score=C("r") * F.least(F.lit(1.0), 0.05 / F.sqrt("vol")) * F.when(C("vol") > C("cap"), 0.5).otherwise(1.0))


@query("sig_18_state_events", BARS + RET + ", g AS (SELECT symbol, t, sign(r)::BIGINT AS state, coalesce(lag(sign(r)::BIGINT) OVER (PARTITION BY symbol ORDER BY t), 0) AS before FROM x WHERE r IS NOT NULL) SELECT symbol, t, 'exit' AS event, before AS side FROM g WHERE state <> before AND before <> 0 UNION ALL SELECT symbol, t, 'entry', state FROM g WHERE state <> before AND state <> 0")
def sig_18(s, d):
    x = with_r(s, d).where("r is not null").withColumn("state", F.signum("r").cast("long"))
    x = x.withColumn("before", F.coalesce(F.lag("state").over(over()), F.lit(0).cast("long"))).where("state <> before")
    events = F.array_compact(F.array(F.when(C("before") != 0, F.struct(F.lit("exit").alias("event"), C("before").alias("side"))), F.when(C("state") != 0, F.struct(F.lit("entry").alias("event"), C("state").alias("side")))))
    return x.select("symbol", "t", F.inline(events))


@query("xs_01_standardise", BARS + ", z AS (SELECT symbol, t, close, avg(close) OVER a AS m, stddev_pop(close) OVER a AS sd, count(*) OVER a AS n FROM bars WINDOW a AS (PARTITION BY t)) SELECT symbol, t, round((close - m) / sd, 6) + 0.0 AS z FROM z WHERE n = 5 AND sd > 0")
def xs_01(s, d):
    x = R.bars_1h(s, d).withColumns({"m": F.avg("close").over(same_time()), "sd": F.stddev_pop("close").over(same_time()), "n": F.count("*").over(same_time())}).where("n = 5 and sd > 0")
    return tidy(x, "symbol", "t", z=(C("close") - C("m")) / C("sd"))


_RANK = ", k AS (SELECT symbol, t, close, volume, rank() OVER (PARTITION BY t ORDER BY volume) + (count(*) OVER (PARTITION BY t, volume) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY t) AS n FROM bars) "


@query("xs_02_average_rank", BARS + _RANK + "SELECT symbol, t, round((rk - 1) / (n - 1), 6) + 0.0 AS pct FROM k WHERE n > 1")
def xs_02(s, d):
    x = R.bars_1h(s, d).withColumns({"rk": average_rank(C("volume"), ["t"]), "n": F.count("*").over(same_time())}).where("n > 1")
    return tidy(x, "symbol", "t", pct=(C("rk") - 1) / (C("n") - 1))


@query("xs_03_mid_rank", BARS + _RANK + "SELECT symbol, t, round((rk - 0.5) / n, 6) + 0.0 AS pct FROM k")
def xs_03(s, d):
    x = R.bars_1h(s, d).withColumns({"rk": average_rank(C("volume"), ["t"]), "n": F.count("*").over(same_time())})
    return tidy(x, "symbol", "t", pct=(C("rk") - 0.5) / C("n"))


@query("xs_04_rank_product_legs", BARS + ", k AS (SELECT symbol, t, close, (percent_rank() OVER (PARTITION BY t ORDER BY close)) * (percent_rank() OVER (PARTITION BY t ORDER BY high)) * (percent_rank() OVER (PARTITION BY t ORDER BY low)) AS p FROM bars) SELECT symbol, t, CASE WHEN row_number() OVER (PARTITION BY t ORDER BY p DESC, close DESC, symbol) = 1 THEN 1 WHEN row_number() OVER (PARTITION BY t ORDER BY p, close, symbol) = 1 THEN -1 ELSE 0 END::BIGINT AS leg FROM k")
def xs_04(s, d):
    pr = lambda c: F.percent_rank().over(same_time().orderBy(c))
    x = R.bars_1h(s, d).withColumn("p", pr("close") * pr("high") * pr("low"))
    top, low = F.row_number().over(same_time().orderBy(C("p").desc(), C("close").desc(), "symbol")), F.row_number().over(same_time().orderBy("p", "close", "symbol"))
    return x.select("symbol", "t", F.when(top == 1, 1).when(low == 1, -1).otherwise(0).cast("long").alias("leg"))


@query("xs_06_quantile_state", BARS + ", k AS (SELECT symbol, t, row_number() OVER (PARTITION BY t ORDER BY close, symbol) AS r, count(*) OVER (PARTITION BY t) AS n FROM bars) SELECT symbol, t, (1 + floor((r - 1) * 2.0 / (n - 1) + 0.5))::BIGINT AS state FROM k WHERE n > 1")
def xs_06(s, d):
    x = R.bars_1h(s, d).withColumns({"r": F.row_number().over(same_time().orderBy("close", "symbol")), "n": F.count("*").over(same_time())}).where("n > 1")
    return x.select("symbol", "t", (1 + F.floor((C("r") - 1) * 2.0 / (C("n") - 1) + 0.5)).cast("long").alias("state"))


@query("xs_07_characteristic_payoff", BARS + RET + ", z AS (SELECT symbol, t, (close - avg(close) OVER a) / nullif(stddev_pop(close) OVER a, 0) AS z, lead(r) OVER (PARTITION BY symbol ORDER BY t) AS nx FROM x WINDOW a AS (PARTITION BY t)) SELECT t, round(avg(z * nx), 6) + 0.0 AS payoff, round(avg(nx), 6) + 0.0 AS market FROM z GROUP BY 1")
def xs_07(s, d):
    x = with_r(s, d).withColumns({"z": (C("close") - F.avg("close").over(same_time())) / F.nullif(F.stddev_pop("close").over(same_time()), F.lit(0.0)), "nx": F.lead("r").over(over())})
    return tidy(x.groupBy("t").agg(F.avg(C("z") * C("nx")).alias("payoff"), F.avg("nx").alias("market")), "t", payoff=C("payoff"), market=C("market"))


@query("xs_08_dispersion_index", BARS + RET + ", g AS (SELECT t, avg(r) AS m, stddev_pop(r) AS disp FROM x GROUP BY 1) SELECT t, round(disp, 6) + 0.0 AS disp, round(sum(m) OVER (ORDER BY t), 6) + 0.0 AS idx FROM g")
def xs_08(s, d):
    g = with_r(s, d).groupBy("t").agg(F.avg("r").alias("m"), F.stddev_pop("r").alias("disp"))
    return tidy(g, "t", disp=C("disp"), idx=F.sum("m").over(Window.orderBy("t")))


@query("xs_09_rank_ic", BARS + ", f AS (SELECT symbol, t, volume, lead(close) OVER (PARTITION BY symbol ORDER BY t) / close - 1 AS nx FROM bars), g AS (SELECT t, rank() OVER (PARTITION BY t ORDER BY volume) + (count(*) OVER (PARTITION BY t, volume) - 1) / 2.0 AS a, rank() OVER (PARTITION BY t ORDER BY nx) + (count(*) OVER (PARTITION BY t, nx) - 1) / 2.0 AS b FROM f WHERE nx IS NOT NULL) SELECT t, count(*) AS n, round(CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN covar_pop(a, b) / stddev_pop(a) / stddev_pop(b) END, 6) + 0.0 AS ic FROM g GROUP BY 1")
def xs_09(s, d):
    f = R.bars_1h(s, d).withColumn("nx", F.lead("close").over(over()) / C("close") - 1).where("nx is not null")
    g = f.withColumns({"a": average_rank(C("volume"), ["t"]), "b": average_rank(C("nx"), ["t"])}).groupBy("t").agg(F.count("*").alias("n"), F.covar_pop("a", "b").alias("cv"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    return tidy(g, "t", "n", ic=F.when((C("n") >= 3) & (C("sa") > 0) & (C("sb") > 0), C("cv") / C("sa") / C("sb")))


@query("xs_10_rank_displacement", BARS + ", k AS (SELECT symbol, t, percent_rank() OVER (PARTITION BY t ORDER BY close) AS a, percent_rank() OVER (PARTITION BY t ORDER BY volume) AS b FROM bars) SELECT symbol, t, round(abs(a - b), 6) + 0.0 AS displacement FROM k")
def xs_10(s, d):
    pr = lambda c: F.percent_rank().over(same_time().orderBy(c))
    x = R.bars_1h(s, d).withColumns({"a": pr("close"), "b": pr("volume")})
    return tidy(x, "symbol", "t", displacement=F.abs(C("a") - C("b")))


@query("xs_12_long_short_series", BARS + ", f AS (SELECT symbol, t, close, lead(close) OVER (PARTITION BY symbol ORDER BY t) / close - 1 AS nx FROM bars), l AS (SELECT t, nx, row_number() OVER (PARTITION BY t ORDER BY close DESC, symbol) AS u, row_number() OVER (PARTITION BY t ORDER BY close, symbol) AS v, count(*) OVER (PARTITION BY t) AS n FROM f) SELECT t, round(0.5 * (avg(nx) FILTER (u <= 2) - avg(nx) FILTER (v <= 2)), 6) + 0.0 AS ls FROM l WHERE n >= 4 GROUP BY 1")
def xs_12(s, d):
    f = R.bars_1h(s, d).withColumn("nx", F.lead("close").over(over()) / C("close") - 1)
    x = P.legs(f.withColumn("n", F.count("*").over(same_time())).where("n >= 4"), "close", 2).groupBy("t").agg((0.5 * (F.avg(F.when(C("side") == 1, C("nx"))) - F.avg(F.when(C("side") == -1, C("nx"))))).alias("ls"))
    return tidy(x, "t", ls=C("ls"))


@query("xs_13_regime_buckets", DAILY + ", y AS (SELECT symbol, t, close / lag(close, 252) OVER (PARTITION BY symbol ORDER BY t) - 1 AS yoy FROM daily) SELECT CASE WHEN yoy >= 0.15 THEN 'up' WHEN yoy <= -0.15 THEN 'down' ELSE 'flat' END AS regime, count(*) AS n, round(avg(yoy), 6) + 0.0 AS mean FROM y WHERE yoy IS NOT NULL GROUP BY 1")
def xs_13(s, d):
    y = R.bars_1d(s, d).withColumn("yoy", C("close") / F.lag("close", 252).over(over()) - 1).where("yoy is not null")
    g = y.groupBy(F.when(C("yoy") >= 0.15, "up").when(C("yoy") <= -0.15, "down").otherwise("flat").alias("regime")).agg(F.count("*").alias("n"), F.avg("yoy").alias("mean"))
    return tidy(g, "regime", "n", mean=C("mean"))


_PAIR = ", p AS (SELECT a.symbol AS a, b.symbol AS b, a.t, a.r AS ra, b.r AS rb FROM x a JOIN x b ON a.t = b.t AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL), m AS (SELECT a, b, corr(ra, rb) AS rho, covar_samp(ra, rb) AS cov, count(*) AS n FROM p GROUP BY 1, 2) "


def pair_matrix(s, d):
    p = symbol_pairs(with_r(s, d).where("r is not null"), "r")
    return p.groupBy("a", "b").agg(F.corr("ra", "rb").alias("rho"), F.covar_samp("ra", "rb").alias("cov"), F.count("*").alias("n"))


@query("xs_14_correlation_matrix", BARS + RET + _PAIR + "SELECT a, b, n, round(rho, 6) + 0.0 AS rho, round(cov, 6) + 0.0 AS cov, round(acos(rho) / pi(), 6) + 0.0 AS angle FROM m")
def xs_14(s, d):
    return tidy(pair_matrix(s, d), "a", "b", "n", rho=C("rho"), cov=C("cov"), angle=F.acos("rho") / F.pi())


@query("xs_15_graph_features", BARS + RET + _PAIR + ", e AS (SELECT a, b FROM m WHERE abs(rho) >= 0.02), v AS (SELECT DISTINCT symbol FROM bars), tri AS (SELECT x1.a AS x, x1.b AS y, x2.b AS z FROM e x1 JOIN e x2 ON x1.b = x2.a JOIN e x3 ON x3.a = x1.a AND x3.b = x2.b), ti AS (SELECT s, count(*) AS k FROM (SELECT unnest([x, y, z]) AS s FROM tri) GROUP BY 1), de AS (SELECT s, count(*) AS g FROM (SELECT unnest([a, b]) AS s FROM e) GROUP BY 1), cl AS (SELECT v.symbol, CASE WHEN g >= 2 THEN 2.0 * coalesce(k, 0) / (g * (g - 1)) ELSE 0.0 END AS c FROM v LEFT JOIN de ON v.symbol = de.s LEFT JOIN ti ON v.symbol = ti.s) SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM tri) AS triangles, round((SELECT count(*) FROM e) * 2.0 / (SELECT count(*) FROM v), 6) + 0.0 AS mean_degree, round((SELECT count(*) FROM e) * 2.0 / (SELECT nullif(count(*) * (count(*) - 1), 0) FROM v), 6) + 0.0 AS density, round((SELECT avg(c) FROM cl), 6) + 0.0 AS clustering")
def xs_15(s, d):
    from ..operators.xsection import graph_features

    g = graph_features(pair_matrix(s, d), R.bars_1h(s, d).select("symbol").distinct(), 0.02)
    return tidy(g, "edges", "triangles", mean_degree=C("mean_degree"), density=C("density"), clustering=C("clustering"))


@query("xs_16_effective_rank", BARS + RET + _PAIR + "SELECT round((SELECT count(DISTINCT symbol) FROM bars) ^ 2 / ((SELECT count(DISTINCT symbol) FROM bars) + 2 * sum(rho * rho)), 6) + 0.0 AS effective_rank, round(avg(abs(rho)), 6) + 0.0 AS mean_abs_rho FROM m")
def xs_16(s, d):
    n = R.bars_1h(s, d).agg(F.count_distinct("symbol").alias("k"))
    g = pair_matrix(s, d).agg(F.sum(C("rho") ** 2).alias("q"), F.avg(F.abs("rho")).alias("m")).crossJoin(F.broadcast(n))
    return tidy(g, effective_rank=C("k") ** 2 / (C("k") + 2 * C("q")), mean_abs_rho=C("m"))


@query("xs_18_shrinkage", BARS + RET + _PAIR + ", i AS (SELECT least(greatest(avg((1 - rho * rho) * (1 - rho * rho) / n) / avg(rho * rho), 0), 1) AS k FROM m) SELECT a, b, round((1 - k) * rho, 6) + 0.0 AS rho, round(k, 6) + 0.0 AS intensity FROM m, i")
def xs_18(s, d):
    """Correlations drawn towards zero, that is the matrix towards identity, by one intensity."""
    m = pair_matrix(s, d)
    g = m.agg((F.avg((1 - C("rho") ** 2) ** 2 / C("n")) / F.avg(C("rho") ** 2)).alias("i"))  # one row
    k = F.least(F.greatest("i", F.lit(0.0)), F.lit(1.0))
    return tidy(m.crossJoin(F.broadcast(g)), "a", "b", rho=(1 - k) * C("rho"), intensity=k)


@query("xs_19_top_bottom_legs", BARS + ", l AS (SELECT symbol, t, row_number() OVER (PARTITION BY t ORDER BY close DESC, symbol) AS u, row_number() OVER (PARTITION BY t ORDER BY close, symbol) AS v, greatest(1, least(2, count(*) OVER (PARTITION BY t) // 2)) AS k FROM bars) SELECT symbol, t, CASE WHEN u <= k THEN 1 WHEN v <= k THEN -1 ELSE 0 END::BIGINT AS side FROM l")
def xs_19(s, d):
    return P.legs(R.bars_1h(s, d), "close", 2).select("symbol", "t", C("side").cast("long").alias("side"))


@query("pf_01_rule_weights", BARS + RET + ", v AS (SELECT symbol, t, CASE WHEN count(r) OVER f = 12 THEN 1 / nullif(stddev_samp(r) OVER f, 0) END AS iv, sign(round(avg(r) OVER f, 12)) AS m FROM x WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT symbol, t, round(1.0 / count(*) OVER a, 6) + 0.0 AS equal, round(iv / sum(iv) OVER a, 6) + 0.0 AS inverse_vol, round(m / count(*) OVER a, 6) + 0.0 AS momentum FROM v WINDOW a AS (PARTITION BY t)")
def pf_01(s, d):
    x = P.rule_weights(with_r(s, d), 12)
    return tidy(x, "symbol", "t", equal=C("equal"), inverse_vol=C("inverse_vol"), momentum=C("momentum"))


@query("pf_02_turnover_net", BARS + RET + ", w AS (SELECT symbol, t, r, sign(r) / 5.0 AS w FROM x WHERE r IS NOT NULL), h AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY t), 0) AS hw FROM w) SELECT t, round(sum(hw * r), 6) + 0.0 AS gross, round(sum(abs(w - hw)), 6) + 0.0 AS turnover, round(sum(hw * r) - 0.001 * sum(abs(w - hw)), 6) + 0.0 AS net FROM h GROUP BY 1")
def pf_02(s, d):
    x = with_r(s, d).where("r is not null").withColumn("w", F.signum("r") / 5)
    return tidy(P.portfolio_returns(x, 0.001), "t", gross=C("gross"), turnover=C("turnover"), net=C("net"))


@query("pf_03_drift_weights", DAILY + ", x AS (SELECT symbol, t, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1, 0) / 100 AS r FROM daily), g AS (SELECT symbol, t, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY t)) AS g FROM x) SELECT symbol, t, round(g / sum(g) OVER (PARTITION BY t), 6) + 0.0 AS w FROM g")
def pf_03(s, d):
    x = R.bars_1d(s, d).withColumn("r", F.coalesce(C("close") / F.lag("close").over(over()) - 1, F.lit(0.0)) / 100)
    return tidy(P.drift_weights(x), "symbol", "t", w=C("w"))


_EPI = _CROSS + ", e AS (SELECT symbol, t, fresh, lead(t) OVER w AS entry_t, lead(open) OVER w AS entry, lead(t, 7) OVER w AS exit_t, lead(open, 7) OVER w AS exit, max(high) OVER f AS hi, min(low) OVER f AS lo FROM c WINDOW w AS (PARTITION BY symbol ORDER BY t), f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)), ep AS (SELECT symbol, t, entry_t, exit_t, exit / entry - 1 AS gross, hi / entry - 1 AS mfe, lo / entry - 1 AS mae FROM e WHERE fresh AND exit IS NOT NULL) "


def crossing_episodes(s, d):
    bars = R.bars_1h(s, d)
    return P.time_exit_episodes(bars, crossings(bars).where("fresh").select("symbol", "t", F.lit(1).alias("side")), 6)


@query("pf_04_time_exit_episodes", BARS + _EPI + "SELECT symbol, t, entry_t, exit_t, round(gross, 6) + 0.0 AS gross, round(mfe, 6) + 0.0 AS mfe, round(mae, 6) + 0.0 AS mae FROM ep")
def pf_04(s, d):
    return tidy(crossing_episodes(s, d), "symbol", "t", "entry_t", "exit_t", gross=C("gross"), mfe=C("mfe"), mae=C("mae"))


@query("pf_05_non_overlap", BARS.replace("WITH ", "WITH RECURSIVE ", 1) + _EPI + ", n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_t) AS i FROM ep), s AS (SELECT symbol, i, entry_t, exit_t AS busy, true AS kept FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, n.entry_t, CASE WHEN n.entry_t >= s.busy THEN n.exit_t ELSE s.busy END, n.entry_t >= s.busy FROM s JOIN n ON n.symbol = s.symbol AND n.i = s.i + 1) SELECT symbol, entry_t FROM s WHERE kept")
def pf_05(s, d):
    return P.non_overlapping(crossing_episodes(s, d)).select("symbol", "entry_t")


_FLAG = ", st AS (SELECT symbol, count(*) AS n, avg(gross) AS m, stddev_samp(gross) AS sd, sum(gross) AS total FROM ep GROUP BY 1) "


@query("flagship_crossing_research", BARS + _EPI + _FLAG + "SELECT symbol, n AS episodes, round(total, 6) + 0.0 AS gross, round(CASE WHEN sd > 0 THEN m / sd END, 6) + 0.0 AS sharpe, row_number() OVER (ORDER BY m / sd DESC, symbol) AS place FROM st")
def flagship(s, d):
    st = crossing_episodes(s, d).groupBy("symbol").agg(F.count("*").alias("episodes"), F.avg("gross").alias("m"), F.stddev_samp("gross").alias("sd"), F.sum("gross").alias("total"))
    place = F.row_number().over(Window.orderBy((C("m") / C("sd")).desc(), "symbol")).cast("long")
    return tidy(st.withColumn("place", place), "symbol", "episodes", "place", gross=C("total"), sharpe=F.when(C("sd") > 0, C("m") / C("sd")))


_STRESS = ", st AS (SELECT symbol, t, fresh" + "".join(f", lead(open, {1 + k}) OVER w AS a{k}, lead(open, {7 + k}) OVER w AS b{k}" for k in (0, 1)) + " FROM c WINDOW w AS (PARTITION BY symbol ORDER BY t)), g AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS scenario, symbol, (b{k} - {ticks} * 0.01) / (a{k} + {ticks} * 0.01) - 1 AS gross FROM st WHERE fresh AND b{k} IS NOT NULL" for n, k, ticks in (("base", 0, 0), ("entry_delay_1_bar", 1, 0), ("slippage_2ticks", 0, 2))
) + ") "


@query("pf_06_execution_stress", BARS + _CROSS + _STRESS + "SELECT scenario, symbol, count(*) AS n, round(sum(gross), 6) + 0.0 AS gross FROM g GROUP BY 1, 2")
def pf_06_execution(s, d):
    """Crossing episodes entered a bar later, and with two ticks of slippage on each fill."""
    bars = R.bars_1h(s, d)
    x = P.stressed_episodes(bars, crossings(bars).where("fresh").select("symbol", "t", F.lit(1).alias("side")), 6, {"base": (0, 0), "entry_delay_1_bar": (1, 0), "slippage_2ticks": (0, 2)})
    return tidy(x.groupBy("scenario", "symbol").agg(F.count("*").alias("n"), F.sum("gross").alias("g")), "scenario", "symbol", "n", gross=C("g"))


_SCEN = ", sc AS (SELECT * FROM (VALUES ('base', 1.0, 1.0, 0.0), ('fees_x2', 2.0, 1.0, 0.0), ('funding_x3', 1.0, 3.0, 0.0), ('flat_40bps', 1.0, 1.0, 40.0), ('no_funding', 1.0, 0.0, 0.0)) v(scenario, fee_x, funding_x, bps)) "


@query("pf_06_cost_scenarios", with_roles("episodes") + _SCEN + "SELECT scenario, symbol, count(*) AS n, round(sum(gross - fees * fee_x - funding * funding_x - amount * bps / 10000), 4) + 0.0 AS net FROM episodes, sc GROUP BY 1, 2")
def pf_06(s, d):
    rows = [("base", 1.0, 1.0, 0.0), ("fees_x2", 2.0, 1.0, 0.0), ("funding_x3", 1.0, 3.0, 0.0), ("flat_40bps", 1.0, 1.0, 40.0), ("no_funding", 1.0, 0.0, 0.0)]
    scenarios = s.createDataFrame(rows, "scenario string, fee_x double, funding_x double, bps double")
    return P.reprice(R.episodes(s, d), scenarios).groupBy("scenario", "symbol").agg(F.count("*").alias("n"), (F.round(F.sum("net"), 4) + 0.0).alias("net"))


@query("pf_08_equal_panel", DAILY + ", e AS (SELECT symbol, t, close / first(close) OVER (PARTITION BY symbol ORDER BY t) AS eq FROM daily) SELECT t, round(avg(eq), 6) + 0.0 AS panel, round(avg(eq) FILTER (symbol <> '1-URGENT'), 6) + 0.0 AS without_one FROM e GROUP BY 1")
def pf_08(s, d):
    e = R.bars_1d(s, d).withColumn("eq", C("close") / F.first("close").over(over()))
    return tidy(e.groupBy("t").agg(F.avg("eq").alias("p"), F.avg(F.when(C("symbol") != "1-URGENT", C("eq"))).alias("q")), "t", panel=C("p"), without_one=C("q"))


@query("pf_11_net_scenario_return", with_roles("daily", "settlements") + ", f AS (SELECT symbol, st // 86400000 AS day, sum(rate) AS funding FROM settlements WHERE status = 'official' GROUP BY 1, 2), r AS (SELECT symbol, t, t // 86400000 AS day, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM daily) SELECT r.symbol, r.t, round(r.r - coalesce(f.funding, 0), 6) + 0.0 AS net FROM r LEFT JOIN f ON f.symbol = r.symbol AND f.day = r.day WHERE r.r IS NOT NULL")
def pf_11(s, d):
    from ..functions.expr import day_of

    f = R.settlements(s, d).where("status = 'official'").groupBy("symbol", day_of(C("st")).alias("day")).agg(F.sum("rate").alias("funding"))
    r = R.bars_1d(s, d).withColumns({"day": day_of(C("t")), "r": C("close") / F.lag("close").over(over()) - 1}).where("r is not null")
    return tidy(r.join(f, ["symbol", "day"], "left"), "symbol", "t", net=C("r") - F.coalesce("funding", F.lit(0.0)))
