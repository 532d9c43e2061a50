"""Window features over hourly and daily bars."""

from pyspark.sql import functions as F

from ..functions.expr import frame, over, past, rolling, tidy
from ..operators import rolling as W
from ..registry import query
from ..sources import roles as R
from ..sources.roles import with_roles

C = F.col
BARS, DAILY = with_roles("bars"), with_roles("daily")
_W = " WINDOW w AS (PARTITION BY symbol ORDER BY t)"


def _f(n, a=0):
    return f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN {n} PRECEDING AND {f'{-a} PRECEDING' if a < 0 else 'CURRENT ROW'})"


def _r(x, name):
    return f"round({x}, 6) + 0.0 AS {name}"


RET = ", x AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS r FROM bars) "
DRET = ", x AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS r FROM daily) "


@query("win_01_returns", BARS + f"SELECT symbol, t, {_r('ln(close / lag(close) OVER w)', 'log_ret')}, {_r('close / lag(close, 5) OVER w - 1', 'ret_k')} FROM bars" + _W)
def win_01(s, d):
    return tidy(W.returns(R.bars_1h(s, d), 5), "symbol", "t", log_ret=C("log_ret"), ret_k=C("ret_k"))


@query("win_02_sma", BARS + f"SELECT symbol, t, {_r(f'CASE WHEN count(*) OVER {_f(19)} = 20 THEN avg(close) OVER {_f(19)} END', 'sma')} FROM bars")
def win_02(s, d):
    return tidy(R.bars_1h(s, d), "symbol", "t", sma=W.sma(C("close"), 20))


@query("win_03_partial_moments", BARS + RET + f"SELECT symbol, t, {_r(f'avg(r) OVER {_f(9)}', 'm')}, {_r(f'CASE WHEN count(r) OVER {_f(9)} >= 2 THEN stddev_pop(r) OVER {_f(9)} END', 'sd')} FROM x")
def win_03(s, d):
    x = W.with_log_return(R.bars_1h(s, d))
    return tidy(x, "symbol", "t", m=rolling(C("r"), 10, F.avg, min_count=1), sd=rolling(C("r"), 10, F.stddev_pop, min_count=2))


@query("win_04_sample_moments", BARS + RET + f"SELECT symbol, t, {_r(f'CASE WHEN count(r) OVER {_f(19)} = 20 THEN stddev_samp(r) OVER {_f(19)} END', 'sd')}, {_r(f'CASE WHEN count(r) OVER {_f(19)} = 20 THEN var_pop(r) OVER {_f(19)} END', 'v')} FROM x")
def win_04(s, d):
    x = W.with_log_return(R.bars_1h(s, d))
    return tidy(x, "symbol", "t", sd=rolling(C("r"), 20, F.stddev_samp), v=rolling(C("r"), 20, F.var_pop))


@query("win_05_extremes", BARS + f"SELECT symbol, t, {_r(f'CASE WHEN count(*) OVER {_f(11)} = 12 THEN max(high) OVER {_f(11)} END', 'hi')}, {_r(f'CASE WHEN count(*) OVER {_f(11)} = 12 THEN min(low) OVER {_f(11)} END', 'lo')}, CASE WHEN count(*) OVER {_f(11)} = 12 THEN (count(*) FILTER (close > open) OVER {_f(11)}) END AS n_up FROM bars")
def win_05(s, d):
    b = R.bars_1h(s, d).withColumn("n_up", rolling((C("close") > C("open")).cast("long"), 12, F.sum))
    return tidy(b, "symbol", "t", "n_up", hi=rolling(C("high"), 12, F.max), lo=rolling(C("low"), 12, F.min))


_MOM = ", m AS (SELECT symbol, t, count(r) OVER f AS n, avg(r) OVER f AS a, avg(r*r) OVER f AS b, avg(r*r*r) OVER f AS c, avg(r*r*r*r) OVER f AS e FROM x WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) "


@query("win_06_skew_kurtosis", BARS + RET + _MOM + f"SELECT symbol, t, {_r('CASE WHEN n = 30 THEN (c - 3*a*b + 2*a*a*a) / pow(greatest(sqrt(greatest(b - a*a, 0)), 1e-12), 3) END', 'skew')}, {_r('CASE WHEN n = 30 THEN (e - 4*a*c + 6*a*a*b - 3*a*a*a*a) / pow(greatest(sqrt(greatest(b - a*a, 0)), 1e-12), 4) - 3 END', 'kurt')} FROM m")
def win_06(s, d):
    x = W.with_log_return(R.bars_1h(s, d))
    return tidy(x, "symbol", "t", skew=W.skewness(C("r"), 30), kurt=W.excess_kurtosis(C("r"), 30))


@query("win_07_rolling_corr", BARS + ", x AS (SELECT symbol, t, close AS a, volume AS b FROM bars), m AS (SELECT symbol, t, count(a) OVER f AS n, avg(a*b) OVER f - (avg(a) OVER f) * (avg(b) OVER f) AS cov, (stddev_pop(a) OVER f) * (stddev_pop(b) OVER f) AS sd FROM x WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) " + f"SELECT symbol, t, {_r('CASE WHEN n >= 12 AND sd > 1e-12 THEN cov / sd END', 'corr')} FROM m")
def win_07(s, d):
    return tidy(R.bars_1h(s, d), "symbol", "t", corr=W.rolling_corr(C("close"), C("volume"), 24))


@query("win_08_trailing_beta", BARS + ", x AS (SELECT symbol, t, close AS y, open AS x FROM bars), m AS (SELECT symbol, t, x, y, count(x) OVER f AS n, avg(x*y) OVER f - (avg(x) OVER f) * (avg(y) OVER f) AS cov, avg(x*x) OVER f - (avg(x) OVER f) * (avg(x) OVER f) AS v FROM x WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)) " + f"SELECT symbol, t, {_r('CASE WHEN n >= 8 AND v > 1e-14 THEN cov / v END', 'beta')}, {_r('CASE WHEN n >= 8 AND v > 1e-14 THEN y - cov / v * x END', 'residual')} FROM m")
def win_08(s, d):
    b = R.bars_1h(s, d).withColumn("beta", W.trailing_beta(C("close"), C("open"), 24, 8))
    return tidy(b, "symbol", "t", beta=C("beta"), residual=C("close") - C("beta") * C("open"))


@query("win_09_expanding_z", BARS + f", m AS (SELECT symbol, t, close, count(*) OVER p AS n, avg(close) OVER p AS a, stddev_samp(close) OVER p AS sd, count(*) OVER q AS n2, avg(close) OVER q AS a2, stddev_pop(close) OVER q AS sd2 FROM bars WINDOW p AS (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING), q AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT symbol, t, {_r('CASE WHEN n >= 60 AND sd > 0 THEN (close - a) / sd END', 'z')}, {_r('CASE WHEN n2 >= 60 AND sd2 > 0 THEN (close - a2) / sd2 END', 'z_strict')} FROM m")
def win_09(s, d):
    return tidy(R.bars_1h(s, d), "symbol", "t", z=W.expanding_z(C("close"), 60), z_strict=W.expanding_z(C("close"), 60, strict=True))


@query("win_10_trailing_z", BARS + f", m AS (SELECT symbol, t, volume, count(*) OVER f AS n, avg(volume) OVER f AS a, stddev_pop(volume) OVER f AS sd FROM bars WINDOW f AS {_f(29)}) SELECT symbol, t, {_r('CASE WHEN n = 30 AND sd > 0 THEN (volume - a) / sd END', 'z')} FROM m")
def win_10(s, d):
    return tidy(R.bars_1h(s, d), "symbol", "t", z=W.trailing_z(C("volume"), 30))


@query("win_11_range_mid_rank", BARS + ", c AS (SELECT symbol, min(t) AS t0 FROM bars GROUP BY 1) SELECT a.symbol, a.t, round(CASE WHEN max(c.t0) <= a.t - 259200000 THEN (count(*) FILTER (b.close < a.close) + 0.5 * count(*) FILTER (b.close = a.close)) / count(*) END, 6) + 0.0 AS pct FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.t BETWEEN a.t - 259200000 AND a.t JOIN c ON c.symbol = a.symbol GROUP BY a.symbol, a.t, a.close")
def win_11(s, d):
    return tidy(R.bars_1h(s, d), "symbol", "t", pct=W.mid_rank_in_range(C("close"), 259_200_000))


@query("win_12_rolling_rank", BARS + ", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM bars) SELECT a.symbol, a.t, round(CASE WHEN a.i >= 24 THEN count(*) FILTER (b.close <= a.close) / 24.0 END, 6) + 0.0 AS pct FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 23 AND a.i GROUP BY a.symbol, a.t, a.i")
def win_12(s, d):
    return tidy(R.bars_1h(s, d), "symbol", "t", pct=W.rank_in_rows(C("close"), 24))


@query("win_13_expanding_rank", BARS + "SELECT a.symbol, a.t, round(count(*) FILTER (b.close <= a.close) * 1.0 / count(*), 6) + 0.0 AS pct, round((count(*) FILTER (b.close < a.close) + count(*) FILTER (b.close = a.close) / 2.0) / count(*), 6) + 0.0 AS mid FROM bars a JOIN bars b ON a.symbol = b.symbol AND b.t <= a.t GROUP BY a.symbol, a.t")
def win_13(s, d):
    from ..operators.orderstats import expanding_rank

    return tidy(expanding_rank(R.bars_1h(s, d), "close"), "symbol", "t", pct=C("expanding_rank"), mid=C("expanding_mid_rank"))


@query("win_14_rolling_quantile", BARS + RET + f"SELECT symbol, t, {_r(f'CASE WHEN count(abs(r)) OVER {_f(20, -1)} = 20 THEN quantile_cont(abs(r), 0.75) OVER {_f(20, -1)} END', 'half_width')} FROM x")
def win_14(s, d):
    return tidy(W.with_log_return(R.bars_1h(s, d)), "symbol", "t", half_width=W.rolling_quantile(F.abs("r"), 20, 0.75, shift=1))


@query("win_15_rolling_median", BARS + f"SELECT symbol, t, {_r(f'CASE WHEN count(volume) OVER {_f(15, -1)} = 15 THEN quantile_cont(volume, 0.5) OVER {_f(15, -1)} END', 'med')} FROM bars")
def win_15(s, d):
    return tidy(R.bars_1h(s, d), "symbol", "t", med=W.rolling_quantile(C("volume"), 15, 0.5, shift=1))


@query("win_16_drawdown", BARS + f", m AS (SELECT symbol, t, close / max(close) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bars) SELECT symbol, t, {_r('dd', 'dd')}, {_r('min(dd) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)', 'max_dd')} FROM m")
def win_16(s, d):
    b = R.bars_1h(s, d).withColumn("dd", W.drawdown(C("close")))
    return tidy(b, "symbol", "t", dd=C("dd"), max_dd=F.min("dd").over(past()))


_FWD = """, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS r FROM bars),
 p AS (SELECT a.symbol, a.t, b.i, b.close, max(b.close) OVER (PARTITION BY a.symbol, a.t ORDER BY b.i ROWS UNBOUNDED PRECEDING) AS peak FROM n a JOIN n b ON a.symbol = b.symbol AND b.i BETWEEN a.i AND a.i + 6),
 q AS (SELECT symbol, t, count(*) AS k, min(close / peak - 1) AS dd, last(close ORDER BY i) / first(close ORDER BY i) - 1 AS ret FROM p GROUP BY 1, 2) """


@query("win_17_forward_labels", BARS + _FWD + f"SELECT q.symbol, q.t, {_r('CASE WHEN k = 7 THEN ret END', 'fwd_ret')}, {_r('CASE WHEN k = 7 THEN dd END', 'fwd_dd')}, {_r('CASE WHEN k = 7 THEN (SELECT sum(r) FROM n z WHERE z.symbol = q.symbol AND z.i BETWEEN m.i + 1 AND m.i + 6) END', 'fwd_sum')} FROM q JOIN n m ON m.symbol = q.symbol AND m.t = q.t")
def win_17(s, d):
    end, fall = W.forward_path(6)
    return tidy(W.with_log_return(R.bars_1h(s, d)), "symbol", "t", fwd_ret=end, fwd_dd=fall, fwd_sum=W.forward_sum(C("r"), 6))


_RV = """, y AS (SELECT symbol, t, t // 86400000 AS day, ln(close / lag(close) OVER (PARTITION BY symbol, t // 86400000 ORDER BY t)) AS r FROM bars), z AS (SELECT *, abs(r) * abs(lag(r) OVER (PARTITION BY symbol, day ORDER BY t)) AS pair FROM y),
 g AS (SELECT symbol, day, sum(r*r) AS rv, count(r) / 3.0 * sum(r*r*r*r) AS rq, pi() / 2 * sum(pair) AS bpv, sum(r) AS ret FROM z GROUP BY 1, 2) """


@query("win_18_realised_measures", BARS + _RV + f"SELECT symbol, day, {_r('rv', 'rv')}, {_r('rq', 'rq')}, {_r('bpv', 'bpv')}, {_r('CASE WHEN bpv IS NULL THEN greatest(0.0) * sign(ret) ELSE greatest(rv - bpv, 0) * sign(ret) END', 'jump')} FROM g")
def win_18(s, d):
    return tidy(W.realised(R.bars_1h(s, d)), "symbol", "day", rv=C("rv"), rq=C("rq"), bpv=C("bpv"), jump=C("jump"))


@query("win_19_har_features", BARS + _RV + ", h AS (SELECT *, count(rv) OVER f AS n, min(rv) OVER f AS lo, avg(rv) OVER f AS m22, avg(rv) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m5 FROM g WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)) " + f"SELECT symbol, day, {_r('CASE WHEN n = 22 AND lo > 0 THEN ln(rv) END', 'log_rv')}, {_r('CASE WHEN n = 22 AND lo > 0 THEN m5 END', 'rv5')}, {_r('CASE WHEN n = 22 AND lo > 0 THEN m22 END', 'rv22')}, {_r('CASE WHEN n = 22 AND lo > 0 THEN sqrt(rq) * rv END', 'rq_term')} FROM h")
def win_19(s, d):
    h = W.har_features(W.realised(R.bars_1h(s, d)))
    return tidy(h, "symbol", "day", log_rv=C("log_rv"), rv5=C("rv5"), rv22=C("rv22"), rq_term=C("rq_term"))


_EST = """, a AS (SELECT *, ln(high / low) * ln(high / low) AS hl2, 0.5 * ln(high / low) * ln(high / low) - (2 * ln(2) - 1) * ln(close / open) * ln(close / open) AS gk, close - lag(close) OVER w AS dd, ln(greatest(high, lag(high) OVER w) / least(low, lag(low) OVER w)) AS g FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY t)),
 b AS (SELECT *, lag(dd) OVER w AS d1, hl2 + lag(hl2) OVER w AS beta, lag(t) OVER w AS lt FROM a WINDOW w AS (PARTITION BY symbol ORDER BY t)),
 c AS (SELECT *, count(d1) OVER f AS n, avg(hl2) OVER f AS mh, avg(gk) OVER f AS mg, avg(dd * d1) OVER f - (avg(CASE WHEN d1 IS NOT NULL THEN dd END) OVER f) * (avg(d1) OVER f) AS cov, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2)) - sqrt(g * g / (3 - 2 * sqrt(2))) AS alpha FROM b WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) """


@query("win_20_range_estimators", DAILY + _EST + f"SELECT symbol, t, {_r('CASE WHEN n = 20 THEN sqrt(mh / (4 * ln(2))) END', 'parkinson')}, {_r('CASE WHEN n = 20 THEN sqrt(greatest(mg, 0)) END', 'garman_klass')}, round(CASE WHEN n = 20 THEN 2 * sqrt(greatest(-cov, 0)) END, 3) + 0.0 AS roll, {_r('CASE WHEN lt IS NOT NULL THEN greatest(2 * (exp(alpha) - 1) / (1 + exp(alpha)), 0) END', 'corwin_schultz')}, {_r('(high - low) / ((high + low) / 2)', 'hl_mid')} FROM c")
def win_20(s, d):
    x = W.range_estimators(R.bars_1d(s, d), 20).withColumn("roll", F.round("roll", 3))
    return tidy(x, "symbol", "t", **{c: C(c) for c in ("parkinson", "garman_klass", "roll", "corwin_schultz", "hl_mid")})


@query("win_21_liquidity", BARS + f", x AS (SELECT *, close * volume AS dv, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS r FROM bars) SELECT symbol, t, {_r(f'CASE WHEN count(dv) OVER {_f(20, -1)} = 20 THEN avg(dv) OVER {_f(20, -1)} END', 'adv')}, {_r(f'CASE WHEN count(r) OVER {_f(19)} = 20 THEN avg(abs(r) / dv) OVER {_f(19)} * 1e6 END', 'amihud')}, {_r(f'CASE WHEN count(r) OVER {_f(19)} = 20 AND var_pop(dv) OVER {_f(19)} <> 0 THEN avg(dv) OVER {_f(19)} / var_pop(dv) OVER {_f(19)} END', 'dv_ratio')}, (count(*) FILTER (volume = 0) OVER {_f(19)}) AS zero_volume FROM x")
def win_21(s, d):
    x = W.liquidity(R.bars_1h(s, d), 20)
    return tidy(x, "symbol", "t", "zero_volume", adv=C("adv"), amihud=C("amihud"), dv_ratio=C("dv_ratio"))


@query("win_22_momentum_set", DAILY + DRET + f"SELECT symbol, t, {_r('ln(close / lag(close, 21) OVER w)', 'mom21')}, {_r('ln(close / lag(close, 63) OVER w)', 'mom63')}, {_r('ln(close / lag(close, 252) OVER w)', 'mom252')}, {_r('ln(lag(close, 21) OVER w / lag(close, 252) OVER w)', 'mom12_1')}, {_r('-ln(close / lag(close, 5) OVER w)', 'reversal')}, {_r(f'CASE WHEN count(r) OVER {_f(19)} = 20 THEN stddev_samp(r) OVER {_f(19)} * sqrt(365) END', 'vol20')}, {_r(f'CASE WHEN count(r) OVER {_f(59)} = 60 THEN stddev_samp(r) OVER {_f(59)} * sqrt(365) END', 'vol60')} FROM x" + _W)
def win_22(s, d):
    x = W.momentum_set(R.bars_1d(s, d))
    return tidy(x, "symbol", "t", **{c: C(c) for c in ("mom21", "mom63", "mom252", "mom12_1", "reversal", "vol20", "vol60")})


@query("win_23_panel_features", DAILY + DRET + f"SELECT symbol, t, {_r('ln(close / lag(close, 20) OVER w)', 'ret20')}, {_r(f'CASE WHEN count(r) OVER {_f(4)} = 5 THEN stddev_pop(r) OVER {_f(4)} END', 'vol5')}, {_r(f'CASE WHEN count(r) OVER {_f(19)} = 20 THEN stddev_pop(CASE WHEN r < 0 THEN r END) OVER {_f(19)} END', 'downside20')}, {_r(f'close / max(close) OVER {_f(59)} - 1', 'dd60')} FROM x" + _W)
def win_23(s, d):
    x = W.with_log_return(R.bars_1d(s, d))
    down = F.when(F.count("r").over(frame(-19, 0)) == 20, F.stddev_pop(F.when(C("r") < 0, C("r"))).over(frame(-19, 0)))
    return tidy(x, "symbol", "t", ret20=F.log(C("close") / F.lag("close", 20).over(over())), vol5=rolling(C("r"), 5, F.stddev_pop), downside20=down, dd60=C("close") / F.max("close").over(frame(-59, 0)) - 1)


@query("win_24_lagged_vector", BARS + RET + "SELECT symbol, t, " + ", ".join(_r(f"lag(r, {k}) OVER w", f"r{k}") for k in range(24)) + " FROM x" + _W)
def win_24(s, d):
    return tidy(W.with_log_return(R.bars_1h(s, d)), "symbol", "t", **{f"r{k}": F.lag("r", k).over(over()) for k in range(24)})


@query("win_25_moment_bundle", BARS + RET + f", p AS (SELECT a.symbol AS a, b.symbol AS b, a.t, a.r AS ra, b.r AS rb FROM x a JOIN x b ON a.t = b.t AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL) SELECT a, b, t, count(*) OVER f AS n, {_r('sum(ra) OVER f', 'sa')}, {_r('sum(rb) OVER f', 'sb')}, {_r('sum(ra*ra) OVER f', 'saa')}, {_r('sum(ra*rb) OVER f', 'sab')} FROM p WINDOW f AS (PARTITION BY a, b ORDER BY t ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)")
def win_25(s, d):
    from ..operators.joins import symbol_pairs

    p = symbol_pairs(W.with_log_return(R.bars_1h(s, d)).where("r is not null"), "r")
    f = frame(-47, 0, ["a", "b"])
    total = lambda c: F.sum(c).over(f)
    return tidy(p.withColumn("n", F.count("*").over(f)), "a", "b", "t", "n", sa=total(C("ra")), sb=total(C("rb")), saa=total(C("ra") ** 2), sab=total(C("ra") * C("rb")))


@query("win_26_autocorrelation", BARS + RET + ", m AS (SELECT symbol, avg(r) AS mu, var_pop(r) AS v, count(r) AS n FROM x GROUP BY 1), k AS (SELECT unnest([1, 2, 3]) AS k), o AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM x WHERE r IS NOT NULL) SELECT a.symbol, k.k::BIGINT AS k, round(sum((a.r - mu) * (b.r - mu)) / (max(n) - k.k) / max(v), 6) + 0.0 AS rho FROM o a JOIN k ON true JOIN o b ON a.symbol = b.symbol AND b.i = a.i - k.k JOIN m ON m.symbol = a.symbol GROUP BY 1, k.k")
def win_26(s, d):
    from ..operators.statistics import autocorrelation

    return tidy(autocorrelation(W.with_log_return(R.bars_1h(s, d)).where("r is not null"), "r", [1, 2, 3]), "symbol", "k", rho=C("rho"))


@query("win_27_path_signature", BARS + f", p AS (SELECT *, lead(volume) OVER w - volume AS dy FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)), q AS (SELECT *, count(*) OVER f AS n, first(close) OVER f AS x0, first(volume) OVER f AS y0, sum(close * dy) OVER g AS sp, sum(dy) OVER g AS sd FROM p WINDOW f AS {_f(12)}, g AS {_f(12, -1)}) SELECT symbol, t, {_r('CASE WHEN n = 13 THEN close - x0 END', 's_x')}, {_r('CASE WHEN n = 13 THEN volume - y0 END', 's_y')}, {_r('CASE WHEN n = 13 THEN sp - x0 * sd END', 's_xy')} FROM q")
def win_27(s, d):
    return tidy(W.signature2(R.bars_1h(s, d), "close", "volume", 12), "symbol", "t", s_x=C("s_x"), s_y=C("s_y"), s_xy=C("s_xy"))


@query("win_28_levy_area", BARS + f", p AS (SELECT a.symbol AS a, b.symbol AS b, a.t, a.close AS xa, b.close AS xb FROM bars a JOIN bars b ON a.t = b.t AND a.symbol < b.symbol), l AS (SELECT *, lag(xa) OVER w AS pa, lag(xb) OVER w AS pb FROM p WINDOW w AS (PARTITION BY a, b ORDER BY t)), q AS (SELECT *, (xa - pa) * (pb + xb) - (xb - pb) * (pa + xa) AS area FROM l) SELECT a, b, t, {_r('CASE WHEN count(area) OVER f = 20 THEN sum(area) OVER f END', 'score')} FROM q WINDOW f AS (PARTITION BY a, b ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)")
def win_28(s, d):
    from ..operators.joins import symbol_pairs

    p, w = symbol_pairs(R.bars_1h(s, d), "close"), over(["a", "b"])
    pa, pb = F.lag("ra").over(w), F.lag("rb").over(w)
    p = p.withColumn("area", (C("ra") - pa) * (pb + C("rb")) - (C("rb") - pb) * (pa + C("ra")))
    return tidy(p, "a", "b", "t", score=rolling(C("area"), 20, F.sum, key=["a", "b"]))


@query("win_29_saturating_window", BARS + RET + "SELECT symbol, t, " + _r(" + ".join(f"1.0 / {k} * tanh({10.0 * k} * lag(r, {k - 1}) OVER w)" for k in (1, 2, 3, 4)), "score") + " FROM x" + _W)
def win_29(s, d):
    x = W.with_log_return(R.bars_1h(s, d))
    return tidy(x, "symbol", "t", score=sum((1.0 / k * F.tanh(10.0 * k * F.lag("r", k - 1).over(over())) for k in (2, 3, 4)), F.tanh(10.0 * C("r"))))


@query("win_30_frozen_cdf", BARS + ", m AS (SELECT symbol, t, t // 259200000 AS cycle, close FROM bars) SELECT a.symbol, a.t, round(count(*) FILTER (b.close <= a.close) * 1.0 / count(*), 6) + 0.0 AS u FROM m a JOIN m b ON a.symbol = b.symbol AND b.cycle = a.cycle - 1 GROUP BY a.symbol, a.t")
def win_30(s, d):
    m = R.bars_1h(s, d).select("symbol", "t", F.floor(C("t") / 259_200_000).alias("cycle"), "close")
    formed = m.groupBy("symbol", (C("cycle") + 1).alias("cycle")).agg(F.array_sort(F.collect_list("close")).alias("formed"))
    share = F.size(F.filter("formed", lambda v: v <= C("close"))) / F.size("formed")
    return tidy(m.join(formed, ["symbol", "cycle"]), "symbol", "t", u=share)


@query("win_31_smoothed_derivative", BARS + f"SELECT symbol, t, {_r('((close - lag(close, 2) OVER w) + (lead(close) OVER w - lag(close) OVER w) / 2) / 2', 'deriv')} FROM bars" + _W)
def win_31(s, d):
    w = over()
    return tidy(R.bars_1h(s, d), "symbol", "t", deriv=((C("close") - F.lag("close", 2).over(w)) + (F.lead("close").over(w) - F.lag("close").over(w)) / 2) / 2)
