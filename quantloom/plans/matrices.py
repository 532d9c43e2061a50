"""Whole feature matrices over daily bars: many recursions at once, and the network of a panel; their SQL twins are recursive."""

from pyspark.sql import functions as F

from ..functions.expr import tidy
from ..operators import scan as S
from ..operators.xsection import network_momentum
from ..registry import query
from ..sources import roles as R
from ..sources.roles import SQL

C = F.col


def _rounded(x, name):
    return f"round({x}, 6) + 0.0 AS {name}"


_SPANS = sorted({*S.FEATURE_WINDOWS, *[2 * k for k in S.FEATURE_WINDOWS]})
_MEANS = [(c, k) for c in ("up", "down", "tr") for k in S.FEATURE_WINDOWS]
_MATRIX_SRC = """p AS (SELECT *, lag(close) OVER w AS pc, row_number() OVER w AS i FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY t)),
 q AS (SELECT *, greatest(coalesce(close - pc, 0), 0) AS up, greatest(coalesce(pc - close, 0), 0) AS down, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM p),
 src AS MATERIALIZED (SELECT *, avg(up) OVER w AS m_up, avg(down) OVER w AS m_down, avg(tr) OVER w AS m_tr FROM q WINDOW w AS (PARTITION BY symbol ORDER BY t))"""


def _matrix_sql() -> str:
    first = [f"c.close AS e{k}" for k in _SPANS] + [f"NULL::DOUBLE AS {c}{k}" for c, k in _MEANS]
    step = [f"2.0 / {k + 1} * c.close + (1 - 2.0 / {k + 1}) * p.e{k}" for k in _SPANS]
    step += [f"CASE WHEN c.i < {k} THEN NULL WHEN c.i = {k} THEN c.m_{c} ELSE (p.{c}{k} * {k - 1} + c.{c}) / {k} END" for c, k in _MEANS]
    mean = lambda c, k: f"avg({c}) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    out = [_rounded("ln(close / pc)", "ret1"), _rounded("ln(high / low)", "range_hl"), _rounded("ln(close / open)", "close_open"), _rounded("ln(open / pc)", "gap")]
    out.append(_rounded(f"CASE WHEN i >= 24 THEN ln(volume / {mean('volume', 24)}) END", "vol_ratio"))
    for k in S.FEATURE_WINDOWS:
        rsi = f"(CASE WHEN down{k} > 0 THEN 100 - 100 / (1 + up{k} / down{k}) WHEN up{k} > 0 THEN 100 ELSE 50 END - 50) / 50"
        family = {"sma": f"ln(close / {mean('close', k)})", "ema": f"ln(close / e{k})", "rsi": rsi, "atr": f"tr{k} / close", "macd": f"(e{k} - e{2 * k}) / close"}
        out += [_rounded(f"CASE WHEN i > {S.WARM_UP[f] * k} THEN {v} END", f"{f}_{k}") for f, v in family.items()]
    return (
        f"WITH RECURSIVE {SQL['daily']}, {_MATRIX_SRC}, s AS (SELECT c.*, {', '.join(first)} FROM src c WHERE i = 1 UNION ALL "
        f"SELECT c.*, {', '.join(step)} FROM s p JOIN src c ON c.symbol = p.symbol AND c.i = p.i + 1) SELECT symbol, t, {', '.join(out)} FROM s"
    )


@query("rec_07_whole_matrix", _matrix_sql())
def rec_07_whole(s, d):
    """All 45 columns from one scan of 35 recursions."""
    x = S.feature_matrix(R.bars_1d(s, d))
    return tidy(x, "symbol", "t", **{c: C(c) for c in x.columns if c not in ("symbol", "t", "open", "high", "low", "close", "volume")})


def _chain_sql(source: str, where: str = "") -> str:
    """Common table expressions up to osc(symbol, t, i, scaled, osc_1, ...) of the closes of ``source``."""
    a, fast = f"(2.0 / {S.OSCILLATOR_SPAN + 1})", {k: f"(1 / ({k} * sqrt(2)))" for k in S.SPEEDS}
    slow = {k: f"(1 / ({S.SLOWNESS} * {k} * sqrt(2)))" for k in S.SPEEDS}
    mu = f"({a} * c.d + (1 - {a}) * p.mu)"
    f = {k: f"({fast[k]} * c.scaled + (1 - {fast[k]}) * p.f{k})" for k in S.SPEEDS}
    return f"""d0 AS MATERIALIZED (SELECT symbol, t, coalesce(close - lag(close) OVER w, 0) AS d, row_number() OVER w AS i FROM {source} {where} WINDOW w AS (PARTITION BY symbol ORDER BY t)),
 s0 AS (SELECT c.*, c.d AS mu, 0.0::DOUBLE AS var FROM d0 c WHERE i = 1 UNION ALL SELECT c.*, {mu}, {a} * pow(c.d - {mu}, 2) + (1 - {a}) * p.var FROM s0 p JOIN d0 c ON c.symbol = p.symbol AND c.i = p.i + 1),
 d1 AS MATERIALIZED (SELECT symbol, t, i, sum(CASE WHEN var > 0 THEN d / sqrt(var) ELSE 0 END) OVER (PARTITION BY symbol ORDER BY t) AS scaled FROM s0),
 s1 AS (SELECT c.*, {", ".join(f"c.scaled AS f{k}, c.scaled AS w{k}, 0.0::DOUBLE AS v{k}" for k in S.SPEEDS)} FROM d1 c WHERE i = 1
  UNION ALL SELECT c.*, {", ".join(f"{f[k]}, {slow[k]} * c.scaled + (1 - {slow[k]}) * p.w{k}, {fast[k]} * pow(c.scaled - {f[k]}, 2) + (1 - {fast[k]}) * p.v{k}" for k in S.SPEEDS)} FROM s1 p JOIN d1 c ON c.symbol = p.symbol AND c.i = p.i + 1),
 osc AS MATERIALIZED (SELECT symbol, t, i, scaled, {", ".join(f"CASE WHEN v{k} > 0 THEN (f{k} - w{k}) / sqrt(v{k}) END AS osc_{k}" for k in S.SPEEDS)} FROM s1)"""


@query("rec_12_six_speeds", f"WITH RECURSIVE {SQL['daily']}, {_chain_sql('daily')} SELECT symbol, t, {_rounded('scaled', 'scaled')}, {', '.join(_rounded(f'osc_{k}', f'osc_{k}') for k in S.SPEEDS)} FROM osc")
def rec_12_whole(s, d):
    """Oscillators of six speeds over their own exponential deviations."""
    x = S.oscillators(R.bars_1d(s, d))
    return tidy(x, "symbol", "t", scaled=C("scaled"), **{f"osc_{k}": C(f"osc_{k}") for k in S.SPEEDS})


_NETWORK = f"""WITH RECURSIVE {SQL['daily']}, joint AS (SELECT t FROM daily GROUP BY t HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM daily)), {_chain_sql('daily', 'WHERE t IN (SELECT t FROM joint)')},
 pr AS (SELECT a.symbol AS a, b.symbol AS b, a.t, a.scaled AS xa, b.scaled AS xb, lag(a.scaled) OVER w AS pa, lag(b.scaled) OVER w AS pb FROM osc a JOIN osc b ON a.t = b.t WINDOW w AS (PARTITION BY a.symbol, b.symbol ORDER BY a.t)),
 ar AS (SELECT *, (xa - pa) * (pb + xb) - (xb - pb) * (pa + xa) AS area FROM pr),
 v0 AS (SELECT a, b, t, CASE WHEN a = b THEN 0 WHEN count(area) OVER f = 22 THEN sum(area) OVER f END AS v FROM ar WINDOW f AS (PARTITION BY a, b ORDER BY t ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)),
 v1 AS (SELECT a, b, t, v / coalesce(nullif(max(abs(v)) OVER (PARTITION BY t), 0), 1) AS v FROM v0 WHERE t IN (SELECT t FROM v0 GROUP BY t HAVING count(v) = count(*))),
 nr AS (SELECT x.t, x.a, y.a AS b, 1 / (pow(sum((x.v - y.v) * (x.v - y.v)), 2) + 0.01) AS w FROM v1 x JOIN v1 y ON x.t = y.t AND x.b = y.b AND x.a <> y.a GROUP BY 1, 2, 3),
 nx AS (SELECT nr.t, nr.a AS symbol, {", ".join(f"CASE WHEN count(osc_{k}) = count(*) THEN sum(w * osc_{k}) / sum(w) END AS x{k}" for k in S.SPEEDS)} FROM nr JOIN osc ON osc.t = nr.t AND osc.symbol = nr.b GROUP BY 1, 2),
 sc AS (SELECT o.symbol, o.t, ({" + ".join(f"x{k} * exp(-x{k} * x{k} / 4)" for k in S.SPEEDS)}) / 6 AS score FROM osc o LEFT JOIN nx USING (symbol, t) WHERE o.i > 188),
 st AS (SELECT *, coalesce(sign(round(score, 9)), 0)::BIGINT AS state FROM sc)
 SELECT symbol, t, {_rounded("score", "score")}, state, CASE WHEN state <> coalesce(lag(state) OVER (PARTITION BY symbol ORDER BY t), 0) AND state <> 0 THEN state ELSE 0 END::BIGINT AS event FROM st"""


@query("sig_15_panel_network", _NETWORK)
def sig_15_panel(s, d):
    """Neighbours by the rows of the lead-lag matrix of 22 bars, and their oscillators of six speeds."""
    x = network_momentum(R.bars_1d(s, d)).withColumn("event", C("event").cast("long"))
    return tidy(x, "symbol", "t", "state", "event", score=C("score"))
