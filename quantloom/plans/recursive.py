"""Recursive features over hourly bars; their SQL twins are recursive common table expressions."""

from pyspark.sql import functions as F

from ..functions.expr import over, rolling, sigmoid, softplus, tidy
from ..operators import rolling as W
from ..operators import scan as S
from ..registry import query
from ..sources import roles as R
from ..sources.roles import SQL, with_roles

C = F.col


def _recursive(source: str, start: str, step: str, select: str, columns: str = "y") -> str:
    """SQL: src(symbol, t, i, ...) numbered from 1; y starts with ``start`` at i = 1 and goes on with ``step`` (p is the row before)."""
    return f"WITH RECURSIVE {SQL['ticks']}, {SQL['bars']}, {source}, s AS (SELECT c.*, {start} AS y FROM src c WHERE i = 1 UNION ALL SELECT c.*, {step} AS y FROM s p JOIN src c ON c.symbol = p.symbol AND c.i = p.i + 1) {select}"


_SRC = "src AS MATERIALIZED (SELECT symbol, t, close, high, low, volume, open, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM bars)"
_RSRC = "src AS MATERIALIZED (SELECT symbol, t, r, i FROM (SELECT symbol, t, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS r, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i FROM bars) WHERE r IS NOT NULL)"


@query("rec_01_ema", _recursive(_SRC, "c.close", "2.0/21 * c.close + (1 - 2.0/21) * p.y", "SELECT symbol, t, round(y, 6) + 0.0 AS ema FROM s"))
def rec_01(s, d):
    return tidy(S.ema(R.bars_1h(s, d), "close", 2 / 21, "ema"), "symbol", "t", ema=C("ema"))


@query("rec_02_ewma_volatility", _recursive(_RSRC, "c.r * c.r", "0.06 * c.r * c.r + 0.94 * p.y", "SELECT symbol, t, round(sqrt(y), 6) + 0.0 AS vol FROM s"))
def rec_02(s, d):
    x = W.with_log_return(R.bars_1h(s, d)).where("r is not null")
    return tidy(S.ewm_variance(x, "r", 0.06, "v"), "symbol", "t", vol=F.sqrt("v"))


_TR = "src AS MATERIALIZED (SELECT symbol, t, tr, i, avg(tr) OVER (PARTITION BY symbol ORDER BY t) AS m FROM (SELECT symbol, t, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr, row_number() OVER w AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)))"


@query("rec_03_wilder_atr", _recursive(_TR, "NULL::DOUBLE", "CASE WHEN c.i < 14 THEN NULL WHEN c.i = 14 THEN c.m ELSE (p.y * 13 + c.tr) / 14 END", "SELECT symbol, t, round(tr, 6) + 0.0 AS tr, round(y, 6) + 0.0 AS atr FROM s"))
def rec_03(s, d):
    x = S.wilder(R.bars_1h(s, d).withColumn("tr", S.true_range()), "tr", 14, "atr")
    return tidy(x, "symbol", "t", tr=C("tr"), atr=C("atr"))


_GL = "src AS MATERIALIZED (SELECT symbol, t, i, g, l, avg(g) OVER (PARTITION BY symbol ORDER BY t) AS mg, avg(l) OVER (PARTITION BY symbol ORDER BY t) AS ml FROM (SELECT symbol, t, greatest(d, 0) AS g, greatest(-d, 0) AS l, i FROM (SELECT symbol, t, close - lag(close) OVER w AS d, row_number() OVER w - 1 AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)) WHERE d IS NOT NULL))"
_RSI = f"WITH RECURSIVE {SQL['ticks']}, {SQL['bars']}, {_GL}, s AS (SELECT c.*, NULL::DOUBLE AS yg, NULL::DOUBLE AS yl FROM src c WHERE i = 1 UNION ALL SELECT c.*, CASE WHEN c.i < 14 THEN NULL WHEN c.i = 14 THEN c.mg ELSE (p.yg * 13 + c.g) / 14 END, CASE WHEN c.i < 14 THEN NULL WHEN c.i = 14 THEN c.ml ELSE (p.yl * 13 + c.l) / 14 END FROM s p JOIN src c ON c.symbol = p.symbol AND c.i = p.i + 1), q AS (SELECT b.symbol, b.t, CASE WHEN yg IS NULL THEN NULL WHEN yg = 0 AND yl = 0 THEN 50 WHEN yl = 0 THEN 100 ELSE 100 - 100 / (1 + yg / yl) END AS rsi FROM bars b LEFT JOIN s USING (symbol, t)) "


@query("rec_04_rsi", _RSI + "SELECT symbol, t, round(rsi, 6) + 0.0 AS rsi FROM q")
def rec_04(s, d):
    return tidy(S.rsi(R.bars_1h(s, d), 14, "rsi"), "symbol", "t", rsi=C("rsi"))


@query("rec_04_simple_rsi", with_roles("bars") + ", x AS (SELECT symbol, t, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS r FROM bars), g AS (SELECT symbol, t, CASE WHEN count(r) OVER w = 14 THEN avg(greatest(r, 0)) OVER w END AS up, CASE WHEN count(r) OVER w = 14 THEN avg(greatest(-r, 0)) OVER w END AS down FROM x WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) SELECT symbol, t, round(CASE WHEN up IS NULL THEN NULL WHEN up < 1e-15 AND down < 1e-15 THEN 50 WHEN down < 1e-15 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 6) + 0.0 AS rsi FROM g")
def rec_04_simple(s, d):
    """RSI by simple means of log returns."""
    x = R.bars_1h(s, d).withColumn("r", F.log(C("close") / F.lag("close").over(over())))
    x = x.withColumns({"up": rolling(F.when(C("r").isNotNull(), F.greatest("r", F.lit(0.0))), 14, F.avg), "down": rolling(F.when(C("r").isNotNull(), F.greatest(-C("r"), F.lit(0.0))), 14, F.avg)})
    none = lambda c: C(c) < 1e-15
    rsi = F.when(none("up") & none("down"), 50.0).when(none("down"), 100.0).otherwise(100 - 100 / (1 + C("up") / C("down")))
    return tidy(x, "symbol", "t", rsi=F.when(C("up").isNotNull(), rsi))


@query("rec_05_stochastic_rsi", _RSI + """, k AS (SELECT *, CASE WHEN count(rsi) OVER f = 14 THEN CASE WHEN max(rsi) OVER f = min(rsi) OVER f THEN 0.5 ELSE (rsi - min(rsi) OVER f) / (max(rsi) OVER f - min(rsi) OVER f) END END AS raw FROM q WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
 k3 AS (SELECT *, CASE WHEN count(raw) OVER g = 3 THEN avg(raw) OVER g END AS k FROM k WINDOW g AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT symbol, t, round(k, 6) + 0.0 AS k, round(CASE WHEN count(k) OVER g = 3 THEN avg(k) OVER g END, 6) + 0.0 AS d FROM k3 WINDOW g AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rec_05(s, d):
    x = S.rsi(R.bars_1h(s, d), 14, "rsi")
    lo, hi = rolling(C("rsi"), 14, F.min), rolling(C("rsi"), 14, F.max)
    x = x.withColumns({"lo": lo, "hi": hi}).withColumn("raw", F.when(C("hi") == C("lo"), 0.5).otherwise((C("rsi") - C("lo")) / (C("hi") - C("lo"))))
    x = x.withColumn("raw", F.when(C("lo").isNotNull(), C("raw"))).withColumn("k", rolling(C("raw"), 3, F.avg))
    return tidy(x, "symbol", "t", k=C("k"), d=rolling(C("k"), 3, F.avg))


_MACD = f"WITH RECURSIVE {SQL['ticks']}, {SQL['bars']}, {_SRC}, s AS (SELECT c.*, c.close AS f, c.close AS w, 0.0::DOUBLE AS macd, 0.0::DOUBLE AS sig FROM src c WHERE i = 1 UNION ALL SELECT c.*, 2.0/13*c.close + 11.0/13*p.f, 2.0/27*c.close + 25.0/27*p.w, (2.0/13*c.close + 11.0/13*p.f) - (2.0/27*c.close + 25.0/27*p.w), 0.2*((2.0/13*c.close + 11.0/13*p.f) - (2.0/27*c.close + 25.0/27*p.w)) + 0.8*p.sig FROM s p JOIN src c ON c.symbol = p.symbol AND c.i = p.i + 1) "


@query("rec_06_macd", _MACD + "SELECT symbol, t, round(macd, 6) + 0.0 AS macd, round(sig, 6) + 0.0 AS macd_signal FROM s")
def rec_06(s, d):
    return tidy(S.macd(R.bars_1h(s, d)), "symbol", "t", macd=C("macd"), macd_signal=C("macd_signal"))


@query("rec_07_feature_matrix", _recursive(_SRC, "c.close", "2.0/11 * c.close + 9.0/11 * p.y", "SELECT symbol, t, round(CASE WHEN i >= 10 THEN y END, 6) + 0.0 AS ema10, round(CASE WHEN i >= 10 THEN avg(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END, 6) + 0.0 AS sma10, round(CASE WHEN i >= 20 THEN avg(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END, 6) + 0.0 AS sma20, round(close, 6) + 0.0 AS close FROM s"))
def rec_07(s, d):
    x = S.ema(R.bars_1h(s, d), "close", 2 / 11, "ema10").withColumn("n", F.row_number().over(over()))
    return tidy(x, "symbol", "t", ema10=F.when(C("n") >= 10, C("ema10")), sma10=W.sma(C("close"), 10), sma20=W.sma(C("close"), 20), close=C("close"))


_TILT = "src AS MATERIALIZED (SELECT symbol, t, i, 0.5 + 0.5 * tanh(z / 2) AS w FROM (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i, coalesce(CASE WHEN count(*) OVER f = 30 AND stddev_pop(close) OVER f > 0 THEN (close - avg(close) OVER f) / stddev_pop(close) OVER f END, 0) AS z FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)))"


@query("rec_08_smoothed_weight", _recursive(_TILT, "c.w", "0.1 * c.w + 0.9 * p.y", "SELECT symbol, t, round(w, 6) + 0.0 AS raw, round(y, 6) + 0.0 AS weight FROM s"))
def rec_08(s, d):
    z = F.coalesce(W.trailing_z(C("close"), 30), F.lit(0.0))
    x = S.ema(R.bars_1h(s, d).withColumn("w", 0.5 + 0.5 * F.tanh(z / 2)), "w", 0.1, "weight")
    return tidy(x, "symbol", "t", raw=C("w"), weight=C("weight"))


_MAT = "src AS MATERIALIZED (SELECT symbol, t, x, i FROM (SELECT symbol, t, lag(close, 3) OVER (PARTITION BY symbol ORDER BY t) AS x, row_number() OVER (PARTITION BY symbol ORDER BY t) - 3 AS i FROM bars) WHERE x IS NOT NULL)"


@query("rec_09_matured_ewma", _recursive(_MAT, "c.x", "0.2 * c.x + 0.8 * p.y", "SELECT b.symbol, b.t, round(y, 6) + 0.0 AS matured FROM bars b LEFT JOIN s USING (symbol, t)"))
def rec_09(s, d):
    x = R.bars_1h(s, d).withColumn("m", F.lag("close", 3).over(over()))
    return tidy(S.ema(x, "m", 0.2, "matured"), "symbol", "t", matured=C("matured"))


_BAND = "src AS MATERIALIZED (SELECT symbol, t, w, i FROM (SELECT symbol, t, sin(close) AS w, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM daily))"


@query("rec_10_no_trade_band", f"WITH RECURSIVE {SQL['daily']}, wk AS (SELECT symbol, max(t) AS t, round(last(close ORDER BY t), 2) AS close FROM daily GROUP BY symbol, (t // 86400000 + 3) // 7), src AS MATERIALIZED (SELECT symbol, t, close / 500000 AS w, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM wk), s AS (SELECT c.*, CASE WHEN abs(c.w) > 0.25 THEN c.w ELSE 0.0 END AS y FROM src c WHERE i = 1 UNION ALL SELECT c.*, CASE WHEN abs(c.w - p.y) > 0.25 THEN c.w ELSE p.y END FROM s p JOIN src c ON c.symbol = p.symbol AND c.i = p.i + 1) SELECT symbol, t, round(y, 6) + 0.0 AS held FROM s")
def rec_10(s, d):
    from ..operators.portfolio import no_trade_band

    week = F.floor((F.floor(C("t") / 86_400_000) + 3) / 7)
    weekly = R.bars_1d(s, d).groupBy("symbol", week.alias("week")).agg(F.max(F.struct("t", "close")).alias("x")).select("symbol", "x.t", (F.round("x.close", 2) / 500_000).alias("w"))
    return tidy(no_trade_band(weekly, "w", 0.25), "symbol", "t", held=C("held"))


@query("rec_11_sign_carry", with_roles("bars") + ", x AS (SELECT *, close - lag(close) OVER w AS d FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)), y AS (SELECT *, arg_max(sign(d), CASE WHEN d <> 0 THEN t END) OVER (PARTITION BY symbol ORDER BY t) AS c FROM x) SELECT symbol, t, round(lag(coalesce(c, 1)::DOUBLE, 2) OVER (PARTITION BY symbol ORDER BY t), 6) + 0.0 AS direction FROM y")
def rec_11(s, d):
    x = R.bars_1h(s, d).withColumn("d", C("close") - F.lag("close").over(over()))
    x = x.withColumn("c", S.carry_sign(C("d")))
    return tidy(x, "symbol", "t", direction=F.lag("c", 2).over(over()))


@query("rec_12_oscillator_chain", f"WITH RECURSIVE {SQL['ticks']}, {SQL['bars']}, src AS MATERIALIZED (SELECT symbol, t, d, i FROM (SELECT symbol, t, close - lag(close) OVER w AS d, row_number() OVER w - 1 AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)) WHERE d IS NOT NULL), s AS (SELECT c.*, c.d * c.d AS v, sign(c.d)::DOUBLE AS p, sign(c.d)::DOUBLE AS f, sign(c.d)::DOUBLE AS w FROM src c WHERE i = 1 UNION ALL SELECT c.*, 0.05*c.d*c.d + 0.95*q.v, q.p + c.d / sqrt(0.05*c.d*c.d + 0.95*q.v), 0.2*(q.p + c.d / sqrt(0.05*c.d*c.d + 0.95*q.v)) + 0.8*q.f, 0.05*(q.p + c.d / sqrt(0.05*c.d*c.d + 0.95*q.v)) + 0.95*q.w FROM s q JOIN src c ON c.symbol = q.symbol AND c.i = q.i + 1) SELECT symbol, t, round(p, 6) + 0.0 AS scaled, round(f - w, 6) + 0.0 AS osc FROM s")
def rec_12(s, d):
    x = R.bars_1h(s, d).withColumn("d", C("close") - F.lag("close").over(over())).where("d is not null")
    x = S.ewm_variance(x, "d", 0.05, "v").withColumn("scaled", F.sum(C("d") / F.sqrt("v")).over(over()))
    x = S.ema(S.ema(x, "scaled", 0.2, "f"), "scaled", 0.05, "w")
    return tidy(x, "symbol", "t", scaled=C("scaled"), osc=C("f") - C("w"))


_HUR = "src AS MATERIALIZED (SELECT symbol, t, i, x, sign(x)::INT AS g FROM (SELECT symbol, t, close - lag(close) OVER w AS x, row_number() OVER w - 1 AS i FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)) WHERE x IS NOT NULL)"


@query("rec_13_cost_hurdle", _recursive(_HUR, "CASE WHEN abs(c.x) > 6 * abs(c.g) THEN c.g ELSE 0 END", "CASE WHEN abs(c.x) > 6 * abs(c.g - p.y) THEN c.g ELSE p.y END", "SELECT symbol, t, y::BIGINT AS position FROM s"))
def rec_13(s, d):
    x = R.bars_1h(s, d).withColumn("x", C("close") - F.lag("close").over(over())).where("x is not null")
    return S.hurdle_position(x, "x", 6.0, "position").select("symbol", "t", C("position").cast("long").alias("position"))


_BRK = "src AS MATERIALIZED (SELECT symbol, t, i, floor(x) AS lo, ceil(x) AS hi FROM (SELECT symbol, t, row_number() OVER w AS i, round(ln(close / first(close) OVER w) / ln(1.02), 9) AS x FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)))"


@query("bar_07_price_bricks", _recursive(_BRK, "least(greatest(0.0, c.lo), c.hi)", "least(greatest(p.y, c.lo), c.hi)", "SELECT symbol, t, y::BIGINT AS level, (y - coalesce(lag(y) OVER (PARTITION BY symbol ORDER BY t), 0))::BIGINT AS moved FROM s"))
def bar_07(s, d):
    return S.bricks(R.bars_1h(s, d), 0.02).select("symbol", "t", C("level").cast("long").alias("level"), C("moved").cast("long").alias("moved"))


@query("fn_02_math", with_roles("bars") + "SELECT symbol, t, round(1 / (1 + exp(-(close - 110) / 5)), 6) + 0.0 AS sig, round(ln(1 + exp((close - 110) / 5)), 6) + 0.0 AS soft, round(greatest(0, least(close - 105, 10)), 6) + 0.0 AS clamped, floor(close + 0.5)::BIGINT AS half_up FROM bars")
def fn_02(s, d):
    from ..functions.expr import clamp, half_up

    z = (C("close") - 110) / 5
    return tidy(R.bars_1h(s, d).withColumn("half_up", half_up(C("close"))), "symbol", "t", "half_up", sig=sigmoid(z), soft=softplus(z), clamped=clamp(C("close") - 105, 0.0, 10.0))
