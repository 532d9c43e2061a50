"""Weighted MACD with its ablations, price-volume states in units of true range, residuals to market and dispersion, a second spread estimator."""

import math

from pyspark.sql import functions as F

from ..functions.expr import over, same_time, tidy
from ..operators import rolling as W
from ..operators import scan as S
from ..registry import query
from ..sources import roles as R
from ..sources.roles import SQL, with_roles

C = F.col

_WEIGHTED = (
    f"WITH RECURSIVE {SQL['ticks']}, {SQL['bars']}, "
    "b AS (SELECT *, CASE WHEN count(*) OVER f = 10 THEN stddev_pop(high - low) OVER f END / close AS sd, CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0.0 END AS body FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), "
    "a AS (SELECT *, CASE WHEN count(close * volume * sd * body) OVER g = 10 THEN sum(close * volume * sd * body) OVER g / sum(volume) OVER g END AS whole FROM b WINDOW g AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)), "
    "p AS (SELECT symbol, t, 'standard' AS variant, close AS price FROM a UNION ALL SELECT symbol, t, 'volume', close * volume FROM a UNION ALL SELECT symbol, t, 'volatility', close * sd FROM a UNION ALL SELECT symbol, t, 'body', close * body FROM a UNION ALL SELECT symbol, t, 'full', whole FROM a), "
    "src AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol, variant ORDER BY t) AS i FROM p WHERE price IS NOT NULL), "
    "s AS (SELECT c.*, c.price AS f, c.price AS w, 0.0::DOUBLE AS macd, 0.0::DOUBLE AS sig FROM src c WHERE i = 1 UNION ALL SELECT c.*, 2.0/13*c.price + 11.0/13*q.f, 2.0/27*c.price + 25.0/27*q.w, (2.0/13*c.price + 11.0/13*q.f) - (2.0/27*c.price + 25.0/27*q.w), 0.2*((2.0/13*c.price + 11.0/13*q.f) - (2.0/27*c.price + 25.0/27*q.w)) + 0.8*q.sig FROM s q JOIN src c ON c.symbol = q.symbol AND c.variant = q.variant AND c.i = q.i + 1), "
    "x AS (SELECT *, round(macd - 0.9 * sig, 9) AS a, round(macd - sig, 9) AS b, lag(round(macd - 0.9 * sig, 9)) OVER v AS a0, lag(round(macd - sig, 9)) OVER v AS b0 FROM s WINDOW v AS (PARTITION BY symbol, variant ORDER BY t)) "
)


@query("rec_06_weighted_macd", _WEIGHTED + "SELECT p.symbol, p.t, p.variant, round(p.price, 6) + 0.0 AS price, round(macd, 6) + 0.0 AS macd, round(sig, 6) + 0.0 AS macd_signal, coalesce(a0 <= 0 AND a > 0, false) AS enter, coalesce(b0 >= 0 AND b < 0, false) AS leave FROM p LEFT JOIN x ON x.symbol = p.symbol AND x.variant = p.variant AND x.t = p.t")
def rec_06_weighted(s, d):
    """MACD of the close weighted with volume, deviation of ranges and body, with the four ablations, and its crossings at 0.9 times the signal."""
    x = S.weighted_macd(R.bars_1h(s, d), crossing=0.9)
    return tidy(x, "symbol", "t", "variant", "enter", "leave", price=C("price"), macd=C("macd"), macd_signal=C("macd_signal"))


#: fixed values of the states: price steps in true ranges, bars of the mean range and of the mean volume, low and high volume
STEPS, RANGE_BARS, VOLUME_BARS, LOW, HIGH = (1.0, 1.5, 2.0), 14, 24, 0.5, 1.5


def range_states(bars, key="symbol"):
    """(key, t, step, price_state, volume_state, state) for each of ``STEPS``; -1 where the ranges or volumes aren't complete or the mean range is zero."""
    w = over(key)
    x = S.wilder(bars.withColumn("_tr", S.true_range(key, first=False)), "_tr", RANGE_BARS, "_range", key=key)
    x = x.withColumns({"_mean": W.sma(C("volume"), VOLUME_BARS), "_move": (C("close") - F.lag("close").over(w)) / F.when(C("_range") > 0, C("_range"))})
    x = x.withColumn("step", F.explode(F.array(*[F.lit(v) for v in STEPS])))
    m, ok = C("_move"), C("_move").isNotNull() & (C("_mean") > 0)
    price = F.when(m >= C("step"), 0).when(m >= 0, 1).when(m > -C("step"), 2).otherwise(3)
    volume = F.when(C("volume") < LOW * C("_mean"), 0).when(C("volume") > HIGH * C("_mean"), 2).otherwise(1)
    of = lambda c: F.when(ok, c).otherwise(-1).cast("long")
    return x.select(key, "t", "step", of(price).alias("price_state"), of(volume).alias("volume_state"), of(price * 3 + volume).alias("state"))


_RANGES = (
    f"WITH RECURSIVE {SQL['ticks']}, {SQL['bars']}, "
    "b AS (SELECT *, lag(close) OVER w AS pc, row_number() OVER w - 1 AS k, CASE WHEN count(*) OVER v = 24 THEN avg(volume) OVER v END AS vm FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t), v AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)), "
    "r AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM b WHERE pc IS NOT NULL), "
    "src AS MATERIALIZED (SELECT symbol, t, k - 13 AS i, CASE WHEN k = 14 THEN (SELECT avg(tr) FROM r q WHERE q.symbol = r.symbol AND q.k <= 14) ELSE tr END AS x FROM r WHERE k >= 14), "
    "s AS (SELECT c.*, c.x AS y FROM src c WHERE i = 1 UNION ALL SELECT c.*, (13 * p.y + c.x) / 14 FROM s p JOIN src c ON c.symbol = p.symbol AND c.i = p.i + 1), "
    "m AS (SELECT b.symbol, b.t, volume, vm, step, CASE WHEN y > 0 AND vm > 0 THEN (close - pc) / y END AS m FROM b LEFT JOIN s ON s.symbol = b.symbol AND s.t = b.t, (VALUES (1.0::DOUBLE), (1.5), (2.0)) v(step)), "
    "z AS (SELECT symbol, t, step, CASE WHEN m IS NULL THEN -1 WHEN m >= step THEN 0 WHEN m >= 0 THEN 1 WHEN m > -step THEN 2 ELSE 3 END AS ps, CASE WHEN m IS NULL THEN -1 WHEN volume < 0.5 * vm THEN 0 WHEN volume > 1.5 * vm THEN 2 ELSE 1 END AS vs FROM m) "
)


@query("sig_08_range_states", _RANGES + "SELECT symbol, t, step, ps::BIGINT AS price_state, vs::BIGINT AS volume_state, (CASE WHEN ps < 0 THEN -1 ELSE ps * 3 + vs END)::BIGINT AS state FROM z")
def sig_08_ranges(s, d):
    """Price steps of 1, 1.5 and 2 true ranges against volume in halves of its 24-bar mean: twelve states a step."""
    return range_states(R.bars_1h(s, d))


_SLOPE = "CASE WHEN count({x}) OVER f >= 8 THEN CASE WHEN avg({x} * {x}) OVER f - (avg({x}) OVER f) * (avg({x}) OVER f) > 1e-14 THEN (avg({x} * y) OVER f - (avg({x}) OVER f) * (avg(y) OVER f)) / (avg({x} * {x}) OVER f - (avg({x}) OVER f) * (avg({x}) OVER f)) ELSE 0 END END"
_SPREAD = with_roles("bars") + ", x AS (SELECT symbol, t, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS y FROM bars), c AS (SELECT *, avg(y) OVER (PARTITION BY t) AS m, stddev_pop(y) OVER (PARTITION BY t) AS v FROM x), k AS (SELECT symbol, t, y, m AS m0, v AS v0, CASE WHEN y IS NOT NULL THEN m END AS m, CASE WHEN y IS NOT NULL THEN v END AS v FROM c), b AS (SELECT *, " + _SLOPE.format(x="m") + " AS bm, " + _SLOPE.format(x="v") + " AS bv FROM k WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 128 PRECEDING AND 1 PRECEDING)), e AS (SELECT symbol, t, y - bm * m0 - bv * v0 AS e FROM b), g AS (SELECT symbol, t, e, count(e) OVER h AS n, stddev_pop(e) OVER h AS sd FROM e WINDOW h AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 31 PRECEDING AND CURRENT ROW)) "


@query("sig_13_dispersion_residual", _SPREAD + "SELECT symbol, t, round(CASE WHEN n = 32 AND sd > 1e-10 THEN e / sd END, 6) + 0.0 AS score FROM g")
def sig_13_dispersion(s, d):
    """What market and dispersion of a time leave of a return, each by its slope over the 128 rows before, over the deviation of the last 32 such rests.

    A slope needs eight rows, and is zero where the factor doesn't vary.
    """
    x = R.bars_1h(s, d).withColumn("y", C("close") / F.lag("close").over(over()) - 1)
    x = x.withColumns({"m": F.avg("y").over(same_time()), "v": F.stddev_pop("y").over(same_time())})

    def slope(f):
        both, w = F.when(C("y").isNotNull(), C(f)), over().rowsBetween(-128, -1)
        return F.when(F.count(both).over(w) >= 8, F.coalesce(W.trailing_beta(C("y"), C(f), 128, 8), F.lit(0.0)))

    x = x.withColumns({"bm": slope("m"), "bv": slope("v")}).withColumn("e", C("y") - C("bm") * C("m") - C("bv") * C("v"))
    w = over().rowsBetween(-31, 0)
    sd = F.stddev_pop("e").over(w)
    return tidy(x, "symbol", "t", score=F.when((F.count("e").over(w) == 32) & (sd > 1e-10), C("e") / sd))


_C = 3 - 2 * math.sqrt(2)


@query("win_20_wide_range_spread", with_roles("daily") + f", n AS (SELECT *, lead(high) OVER w AS h2, lead(low) OVER w AS l2 FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY t)), g AS (SELECT *, pow(ln(high / low), 2) + pow(ln(h2 / l2), 2) AS g, pow(ln(greatest(high, h2) / least(low, l2)), 2) AS b FROM n), a AS (SELECT *, (sqrt(2 * b) - sqrt(b)) / {_C} - sqrt(g / {_C}) AS a FROM g) SELECT symbol, t, round(CASE WHEN h2 IS NOT NULL THEN CASE WHEN b > g AND a > 0 THEN 2 * (exp(a) - 1) / (1 + exp(a)) ELSE 0 END END, 6) + 0.0 AS spread FROM a")
def win_20_wide(s, d):
    return tidy(R.bars_1d(s, d), "symbol", "t", spread=W.wide_range_spread())


#: fixed values: spans of the exponential means whose pairs are the rules, numbered in this order
SPANS = (5, 10, 20, 40)
_PAIRS = [(f, w) for f in SPANS for w in SPANS if f < w]
_STEP = ", ".join(f"{2 / (k + 1)!r}::DOUBLE * c.close + {1 - 2 / (k + 1)!r}::DOUBLE * p.e{k}" for k in SPANS)
_RULES = (
    f"WITH RECURSIVE {SQL['daily']}, src AS MATERIALIZED (SELECT symbol, t, close, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM daily), "
    f"s AS (SELECT c.*, {', '.join(f'c.close AS e{k}' for k in SPANS)} FROM src c WHERE i = 1 UNION ALL SELECT c.*, {_STEP} FROM s p JOIN src c ON c.symbol = p.symbol AND c.i = p.i + 1), "
    "v AS (SELECT *, ln(close / lag(close) OVER w) AS y, (t - min(t) OVER (PARTITION BY symbol)) // 86400000 AS day, " + ", ".join(f"lag(e{k}) OVER w AS p{k}" for k in SPANS) + " FROM s WINDOW w AS (PARTITION BY symbol ORDER BY t)), "
    "q AS (" + " UNION ALL ".join(f"SELECT symbol, day // 30 AS blk, {i}::BIGINT AS rule, y * sign(p{f} - p{w}) AS r FROM v WHERE y IS NOT NULL" for i, (f, w) in enumerate(_PAIRS)) + "), "
    "f AS (SELECT *, unnest(range(greatest(blk - 4, 0), blk + 1)) AS step FROM q), "
    "g AS (SELECT symbol, step, rule, avg(r) FILTER (blk <> step + 4) AS m, stddev_samp(r) FILTER (blk <> step + 4) AS sd, sum(r) FILTER (blk <> step + 4) AS train_pnl, sum(r) FILTER (blk = step + 4) AS test_pnl FROM f GROUP BY 1, 2, 3), "
    "h AS (SELECT *, CASE WHEN sd > 1e-12 THEN round(m / sd, 9) END AS sharpe FROM g WHERE train_pnl IS NOT NULL) "
)


@query("pf_07_rule_reselection", _RULES + "SELECT symbol, step, rule, round(sharpe, 6) + 0.0 AS sharpe, round(train_pnl, 6) + 0.0 AS train_pnl, round(test_pnl, 6) + 0.0 AS test_pnl FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY symbol, step ORDER BY coalesce(-sharpe, 1e18), round(train_pnl, 9) DESC, rule) = 1) WHERE test_pnl IS NOT NULL")
def pf_07_rules(s, d):
    """Six crossings of exponential means, chosen anew every 30 days by the 120 days before; positions are those known at the close before."""
    from ..operators.portfolio import reselect

    w = over()
    x = S.emas(R.bars_1d(s, d), {f"e{k}": ("close", 2 / (k + 1)) for k in SPANS})
    x = x.withColumns({"y": F.log(C("close") / F.lag("close").over(w)), "day": F.floor(C("t") / 86_400_000)} | {f"p{k}": F.lag(f"e{k}").over(w) for k in SPANS})
    rules = [F.struct(F.lit(i).cast("long").alias("rule"), (C("y") * F.signum(C(f"p{f}") - C(f"p{g}"))).alias("r")) for i, (f, g) in enumerate(_PAIRS)]
    long = x.select("symbol", "day", F.explode(F.array(*rules)).alias("_r")).select("symbol", "day", "_r.*")
    return tidy(reselect(long, 120, 30), "symbol", "step", "rule", sharpe=C("sharpe"), train_pnl=C("train_pnl"), test_pnl=C("test_pnl"))


_EW = with_roles("daily") + ", x AS (SELECT symbol, t, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS r FROM daily), p AS (SELECT a.symbol AS a, b.symbol AS b, a.t, a.r AS x, b.r AS y FROM x a JOIN x b ON a.t = b.t AND a.symbol < b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL), k AS (SELECT *, pow(0.5, (row_number() OVER (PARTITION BY a, b ORDER BY t DESC) - 1) / 30.0::DOUBLE) AS w FROM p QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY t DESC) <= 30), m AS (SELECT *, sum(w * x) OVER g / sum(w) OVER g AS mx, sum(w * y) OVER g / sum(w) OVER g AS my FROM k WINDOW g AS (PARTITION BY a, b)), c AS (SELECT a, b, count(*) AS n, sum(w * (x - mx) * (y - my)) AS xy, sum(w * (x - mx) * (x - mx)) AS xx, sum(w * (y - my) * (y - my)) AS yy FROM m GROUP BY 1, 2)"


@query("xs_14_ew_matrix", _EW + " SELECT a, b, n, round(CASE WHEN xx > 0 AND yy > 0 THEN greatest(-1, least(1, xy / sqrt(xx * yy))) ELSE 0 END, 6) + 0.0 AS rho FROM c")
def xs_14_ew(s, d):
    """Correlation of the last 30 daily returns that two symbols share, each weighing half of one 30 later; zero where one doesn't vary."""
    from ..operators.joins import symbol_pairs
    from ..operators.xsection import ew_correlation

    x = W.with_log_return(R.bars_1d(s, d)).where("r is not null")
    return tidy(ew_correlation(symbol_pairs(x, "r"), 30, 30.0), "a", "b", "n", rho=C("rho"))
