"""Drift of features and scores of a daily panel, and the gate that follows from it."""

from pyspark.sql import functions as F

from ..functions.expr import over, rolling, tidy
from ..operators import drift as D
from ..operators.xsection import at_joint_times
from ..registry import query
from ..sources import roles as R
from ..sources.roles import with_roles

C = F.col
FEATURES = ["mom21", "mom63", "vol20", "vol60", "adv20"]
HORIZON = 20

_PANEL = with_roles("daily").rstrip() + """, j AS (SELECT * FROM daily WHERE t IN (SELECT t FROM daily GROUP BY t HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM daily))),
 r AS (SELECT *, ln(close / lag(close) OVER w) AS r FROM j WINDOW w AS (PARTITION BY symbol ORDER BY t)),
 pn AS MATERIALIZED (SELECT symbol, t, ln(close / lag(close, 21) OVER w) AS mom21, ln(close / lag(close, 63) OVER w) AS mom63, CASE WHEN count(r) OVER f20 = 20 THEN stddev_samp(r) OVER f20 END AS vol20, CASE WHEN count(r) OVER f60 = 60 THEN stddev_samp(r) OVER f60 END AS vol60,
  CASE WHEN count(volume) OVER f20 = 20 THEN avg(volume) OVER f20 END AS adv20, round(-ln(close / lag(close, 5) OVER w), 9) AS score, round(lead(close, 20) OVER w / close - 1, 9) AS ahead FROM r
  WINDOW w AS (PARTITION BY symbol ORDER BY t), f20 AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), f60 AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""


def panel(s, d):
    """Features, the score (five days of reversal) and the return of the next 20 days, at times that all symbols have."""
    x = at_joint_times(R.bars_1d(s, d)).withColumn("r", F.log(C("close") / F.lag("close").over(over())))
    moved = lambda k: F.log(C("close") / F.lag("close", k).over(over()))
    return x.select(
        "symbol", "t", moved(21).alias("mom21"), moved(63).alias("mom63"), rolling(C("r"), 20, F.stddev_samp).alias("vol20"), rolling(C("r"), 60, F.stddev_samp).alias("vol60"), rolling(C("volume"), 20, F.avg).alias("adv20"),
        F.round(-moved(5), 9).alias("score"), F.round(F.lead("close", HORIZON).over(over()) / C("close") - 1, 9).alias("ahead"),
    )


_Z = ", ".join(f"CASE WHEN count({c}) OVER h >= 60 AND stddev_pop({c}) OVER h > 0 THEN abs(({c} - avg({c}) OVER h) / stddev_pop({c}) OVER h) END AS z{i}" for i, c in enumerate(FEATURES))
_N = " + ".join(f"count(z{i})" for i in range(len(FEATURES)))
_DRIFT = f", zs AS (SELECT t, {_Z} FROM pn WINDOW h AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)), fd AS (SELECT t, CASE WHEN {_N} > 0 THEN ({' + '.join(f'coalesce(sum(z{i}), 0)' for i in range(len(FEATURES)))}) / ({_N}) END AS drift FROM zs GROUP BY 1)"


@query("xs_17_feature_drift", _PANEL + _DRIFT + " SELECT t, round(drift, 6) + 0.0 AS drift FROM fd")
def xs_17_feature(s, d):
    return tidy(D.feature_drift(panel(s, d), FEATURES), "t", drift=C("drift"))


@query("xs_17_score_drift", _PANEL + """, g AS (SELECT t, row_number() OVER (ORDER BY t) AS m FROM (SELECT DISTINCT t FROM pn)), sc AS (SELECT g.m, score AS v FROM pn JOIN g USING (t) WHERE score IS NOT NULL),
 u AS (SELECT g.m, sc.v, 1 AS p, 0 AS q FROM g JOIN sc ON sc.m BETWEEN g.m - 60 AND g.m - 1 UNION ALL SELECT m, v, 0, 1 FROM sc), e AS (SELECT m, sum(p) OVER w AS a, sum(p) OVER (PARTITION BY m) AS na, sum(q) OVER w AS b, sum(q) OVER (PARTITION BY m) AS nb FROM u WINDOW w AS (PARTITION BY m ORDER BY v)),
 k AS (SELECT m, max(abs(a / na - b / nb)) AS ks FROM e WHERE na >= 20 AND nb > 0 GROUP BY 1) SELECT t, round(ks, 6) + 0.0 AS ks FROM g LEFT JOIN k USING (m)""")
def xs_17_score(s, d):
    return tidy(D.score_drift(panel(s, d), "score"), "t", ks=C("ks"))


def _ranks(c, by="t"):
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0)"


def _spearman(name, table, a, b):
    return f", {name}0 AS (SELECT t, {_ranks(a)} AS a, {_ranks(b)} AS b FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL), {name} AS (SELECT t, CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN covar_pop(a, b) / stddev_pop(a) / stddev_pop(b) END AS rho FROM {name}0 GROUP BY 1)"


_SHARES = " + ".join(f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER (PARTITION BY t) >= 2 THEN (rank() OVER (PARTITION BY t, {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY t, {c}) - 1) / 2.0 - 0.5) / count({c}) OVER (PARTITION BY t) END" for c in FEATURES)
_ALPHA = 1 - 0.5 ** (1 / 30)
_STRICT = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("sig_16_trust_gate", _PANEL.replace("WITH ", "WITH RECURSIVE ", 1) + _DRIFT + f", sd AS (SELECT *, round(({_SHARES}) / {len(FEATURES)}, 9) AS second FROM pn)" + _spearman("ic", "pn", "score", "ahead") + _spearman("dg", "sd", "score", "second") + f""",
 g AS (SELECT t, ic.rho AS ic, fd.drift, dg.rho AS dis, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM pn) LEFT JOIN ic USING (t) LEFT JOIN fd USING (t) LEFT JOIN dg USING (t)),
 k AS MATERIALIZED (SELECT *, lag(ic, 20) OVER (ORDER BY i) AS known FROM g), s AS (SELECT k.*, known AS y, (known IS NOT NULL)::INT AS n FROM k WHERE i = 1
  UNION ALL SELECT c.*, CASE WHEN c.known IS NULL THEN p.y WHEN p.y IS NULL THEN c.known ELSE {_ALPHA!r}::DOUBLE * c.known + (1 - {_ALPHA!r}::DOUBLE) * p.y END, p.n + (c.known IS NOT NULL)::INT FROM s p JOIN k c ON c.i = p.i + 1),
 h AS (SELECT t, CASE WHEN n >= 20 THEN y END AS health, drift, dis FROM s),
 z AS (SELECT *, {", ".join(f"CASE WHEN count({c}) OVER w >= 60 AND stddev_pop({c}) OVER w > 0 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END AS z_{c}" for c in ("health", "drift", "dis"))} FROM h WINDOW w AS (ORDER BY t {_STRICT})),
 q AS (SELECT *, z_health - 0.3 * z_drift - 0.3 * z_dis AS x FROM z)
 SELECT t, round(health, 6) + 0.0 AS health, round(drift, 6) + 0.0 AS drift, round(dis, 6) + 0.0 AS disagreement, round(CASE WHEN x IS NOT NULL THEN greatest(0, least((1 / (1 + exp(-x)) - 0.3) / 0.4, 1)) END, 6) + 0.0 AS gate FROM q""")
def sig_16_gate(s, d):
    """How far the five-day reversal score may be trusted, from its matured rank correlations, the drift of the features and its disagreement with them."""
    x = D.score_trust(panel(s, d), "score", "ahead", FEATURES, HORIZON)
    return tidy(x, "t", health=C("health"), drift=C("drift"), disagreement=C("disagreement"), gate=C("gate"))
