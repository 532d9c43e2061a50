"""Statistical tests, resampling and models."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import month_ordinal, over, tidy
from ..operators import models as M
from ..operators import rolling as W
from ..operators import statistics as T
from ..registry import query
from ..sources import roles as R
from ..sources.roles import with_roles

C = F.col
BARS, DAILY = with_roles("bars"), with_roles("daily")
RET = ", x AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS r FROM bars) "


def with_r(s, d):
    return W.with_log_return(R.bars_1h(s, d)).where("r is not null")


_SIGN = ", g AS (SELECT symbol, t, r, lag(r) OVER w AS p1, lag(r, 24) OVER w AS p24 FROM x WINDOW w AS (PARTITION BY symbol ORDER BY t)) "


@query("stat_01_directional_accuracy", BARS + RET + ", g AS (SELECT symbol, r, lag(r) OVER w AS p1, lag(r, 2) OVER w AS p2 FROM x WINDOW w AS (PARTITION BY symbol ORDER BY t)) SELECT symbol, count(*) AS n, round(avg(CASE WHEN sign(r) = sign(p1) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy, round(avg(CASE WHEN p2 IS NULL THEN NULL WHEN sign(r) = sign(p2) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS delayed FROM g WHERE r <> 0 AND p1 IS NOT NULL GROUP BY 1")
def stat_01(s, d):
    """Share of right signs of the last return as a forecast, entered at once and one bar later."""
    x = with_r(s, d).withColumns({"p1": F.lag("r").over(over()), "p2": F.lag("r", 2).over(over())}).where("r <> 0 and p1 is not null")
    right = lambda p: F.avg(F.when(C(p).isNotNull(), (F.signum("r") == F.signum(p)).cast("double")))
    return tidy(x.groupBy("symbol").agg(F.count("*").alias("n"), right("p1").alias("a"), right("p2").alias("b")), "symbol", "n", accuracy=C("a"), delayed=C("b"))


_ERFC = "(CASE WHEN {x} IS NULL THEN NULL ELSE ((((1.061405429 / (1 + 0.3275911 * {x}) - 1.453152027) / (1 + 0.3275911 * {x}) + 1.421413741) / (1 + 0.3275911 * {x}) - 0.284496736) / (1 + 0.3275911 * {x}) + 0.254829592) / (1 + 0.3275911 * {x}) * exp(-{x} * {x}) END)"


@query("stat_02_mcnemar", BARS + RET + _SIGN + ", h AS (SELECT sign(r) = -sign(p1) AS a, sign(r) = sign(p24) AS b FROM g WHERE p24 IS NOT NULL), k AS (SELECT count(*) FILTER (NOT a AND b) AS n01, count(*) FILTER (a AND NOT b) AS n10 FROM h), c AS (SELECT n01, n10, (abs(n01 - n10) - 1) * (abs(n01 - n10) - 1) * 1.0::DOUBLE / (n01 + n10) AS chi FROM k) SELECT n01, n10, round(chi, 6) + 0.0 AS chi2, chi > 3.841459 AS reject, round(" + _ERFC.format(x="sqrt(chi / 2)") + ", 6) + 0.0 AS p FROM c")
def stat_02(s, d):
    x = with_r(s, d).withColumns({"p1": F.lag("r").over(over()), "p24": F.lag("r", 24).over(over())}).where("p24 is not null")
    m = T.mcnemar(x.select((F.signum("r") == -F.signum("p1")).alias("a"), (F.signum("r") == F.signum("p24")).alias("b")), "a", "b")
    return tidy(m, "n01", "n10", "reject", chi2=C("chi2"), p=C("p"))


@query("stat_03_auroc", "WITH x AS (SELECT l.quality AS y, d.n_chars AS s FROM labels l JOIN documents d USING (doc_id) WHERE l.quality IS NOT NULL), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM x) SELECT sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) + 0.0 AS auroc FROM k")
def stat_03(s, d):
    x = R.read(s, d, "labels").join(R.read(s, d, "documents"), "doc_id").where("quality is not null")
    return tidy(T.auroc(x, "quality", "n_chars"), "n_pos", "n_neg", auroc=C("auroc"))


@query("stat_04_ks_distance", "WITH x AS (SELECT l.quality AS y, d.n_chars AS s FROM labels l JOIN documents d USING (doc_id)), k AS (SELECT s, (count(*) FILTER (y = 1)) AS p, (count(*) FILTER (y = 0)) AS q FROM x GROUP BY 1), c AS (SELECT sum(p) OVER (ORDER BY s) AS cp, sum(q) OVER (ORDER BY s) AS cq, sum(p) OVER () AS np, sum(q) OVER () AS nq FROM k) SELECT max(np)::BIGINT AS np, max(nq)::BIGINT AS nq, round(max(abs(cp / np - cq / nq)), 6) + 0.0 AS ks FROM c")
def stat_04(s, d):
    x = R.read(s, d, "labels").join(R.read(s, d, "documents"), "doc_id")
    return tidy(T.ks_distance(x, "quality", "n_chars"), "np", "nq", ks=C("ks"))


_U = "(('0x' || substr(md5({x}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496"
_POISSON = "(CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 WHEN u < 0.9999167588507119 THEN 6 WHEN u < 0.9999897508033253 THEN 7 ELSE 8 END)"
_PAIRED = ", y AS (SELECT symbol, t, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM daily), z AS (SELECT symbol, t, r - avg(r) OVER (PARTITION BY t) AS diff FROM y WHERE r IS NOT NULL) "


def paired_with_market(s, d):
    """(symbol, t, diff): daily returns less the mean return of all symbols on the day."""
    x = R.bars_1d(s, d).withColumn("r", C("close") / F.lag("close").over(over()) - 1).where("r is not null")
    return x.select("symbol", "t", (C("r") - F.avg("r").over(Window.partitionBy("t"))).alias("diff"))


@query("stat_05_bootstrap", with_roles("daily") + _PAIRED + ", k AS (SELECT symbol, draw, diff, " + _U.format(x="'42:' || symbol || ':' || t || ':' || draw") + " AS u FROM z, (SELECT unnest(range(0, 200)) AS draw)), m AS (SELECT symbol, draw, sum(" + _POISSON + " * diff) / nullif(sum(" + _POISSON + "), 0) AS mean FROM k GROUP BY 1, 2) SELECT symbol, count(*) AS draws, round(avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS p_value, round(quantile_cont(mean, 0.05), 6) + 0.0 AS low, round(quantile_cont(mean, 0.95), 6) + 0.0 AS high FROM m GROUP BY 1")
def stat_05(s, d):
    """Resampled mean differences between each symbol and the market: the share of draws at or below zero, and their bounds."""
    b = T.bootstrap_means(paired_with_market(s, d), "symbol", "t", "diff", 200)
    g = b.groupBy("symbol").agg(F.count("*").alias("draws"), F.avg((C("mean") <= 0).cast("double")).alias("p"), F.percentile("mean", 0.05).alias("low"), F.percentile("mean", 0.95).alias("high"))
    return tidy(g, "symbol", "draws", p_value=C("p"), low=C("low"), high=C("high"))


@query("stat_06_block_bootstrap", with_roles("daily") + _PAIRED + """, n AS (SELECT symbol, diff, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM z), p AS (SELECT symbol, i + 1 AS at, sum(diff) OVER (PARTITION BY symbol ORDER BY i) AS s FROM n UNION ALL SELECT DISTINCT symbol, 0, 0.0 FROM n), c AS (SELECT DISTINCT symbol, n FROM n),
h AS (SELECT symbol, n, draw, j, 2 * ceil(n / 21.0)::BIGINT + 64 AS most, md5('42:' || symbol || ':' || draw || ':' || j) AS h FROM (SELECT symbol, n, draw, unnest(range(0, 2 * ceil(n / 21.0)::BIGINT + 64)) AS j FROM c, (SELECT unnest(range(0, 10000)) AS draw))),
l AS (SELECT symbol, n, draw, j, most, 1 + floor(ln((('0x' || substr(h, 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496) / ln(1 - 1 / 21.0::DOUBLE))::BIGINT AS len, floor((('0x' || substr(h, 17, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 * n)::BIGINT AS st FROM h),
e AS (SELECT *, sum(len) OVER (PARTITION BY symbol, draw ORDER BY j)::BIGINT AS fin FROM l), g AS (SELECT symbol, n, draw, st, least(CASE WHEN j = most - 1 THEN greatest(fin, n) ELSE fin END, n) - least(fin - len, n) AS len FROM e),
q AS (SELECT symbol, n, draw, unnest([least(st + len, n), st, greatest(st + len - n, 0)]) AS at, unnest([1, -1, 1]) AS sg FROM g WHERE len > 0), m AS (SELECT q.symbol, draw, sum(sg * s) / any_value(n) AS mean FROM q JOIN p ON p.symbol = q.symbol AND p.at = q.at GROUP BY 1, 2)
SELECT symbol, count(*) AS draws, round(avg(CASE WHEN mean <= 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS p_value, round(quantile_cont(mean, 0.05), 6) + 0.0 AS low, round(quantile_cont(mean, 0.95), 6) + 0.0 AS high FROM m GROUP BY 1""")
def stat_06(s, d):
    """The same by geometric blocks of 21 days on average that run on circularly; 10,000 draws a symbol."""
    b = T.block_bootstrap_means(paired_with_market(s, d), "symbol", "t", "diff", 10_000)
    g = b.groupBy("symbol").agg(F.count("*").alias("draws"), F.avg((C("mean") <= 0).cast("double")).alias("p"), F.percentile("mean", 0.05).alias("low"), F.percentile("mean", 0.95).alias("high"))
    return tidy(g, "symbol", "draws", p_value=C("p"), low=C("low"), high=C("high"))


@query("stat_07_circular_shift", BARS + ", n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT a.symbol, a.t, round(b.close, 6) + 0.0 AS placebo FROM n a JOIN n b ON a.symbol = b.symbol AND a.i = (b.i + 37) % b.n")
def stat_07(s, d):
    return tidy(T.circular_shift(R.bars_1h(s, d), "close", 37), "symbol", "t", placebo=C("placebo"))


@query("stat_08_sign_continuation", BARS + RET + ", k AS (SELECT symbol, sign(r) = sign(lag(r, 2) OVER (PARTITION BY symbol ORDER BY t)) AS same FROM x WHERE r IS NOT NULL) SELECT symbol, count(same) AS m, round(2 * avg(same::INT) - 1, 6) + 0.0 AS rho, round((2 * avg(same::INT) - 1) * sqrt(count(same)), 6) + 0.0 AS z FROM k GROUP BY 1")
def stat_08(s, d):
    x = with_r(s, d).withColumn("same", (F.signum("r") == F.signum(F.lag("r", 2).over(over()))).cast("int"))
    g = x.groupBy("symbol").agg(F.count("same").alias("m"), (2 * F.avg("same") - 1).alias("rho"))
    return tidy(g, "symbol", "m", rho=C("rho"), z=C("rho") * F.sqrt("m"))


_FR = ", md AS (SELECT symbol, quantile_cont(abs(r), 0.5) AS med FROM x GROUP BY 1), st AS (SELECT x.symbol, t, CASE WHEN r > 0 THEN 1 ELSE 0 END * 2 + CASE WHEN abs(r) > med THEN 1 ELSE 0 END AS state, CASE WHEN abs(r) > med THEN 1 ELSE 0 END::BIGINT AS bucket FROM x JOIN md USING (symbol) WHERE r IS NOT NULL), an AS (SELECT symbol, bucket, 2 * pi() * (((state - lead(state, 3) OVER (PARTITION BY symbol ORDER BY t)) % 4 + 4) % 4) / 4 AS a FROM st) "


@query("stat_09_fourier_residues", BARS + RET + _FR + "SELECT symbol, bucket, count(a) AS n, round(avg(cos(a)), 6) + 0.0 AS c, round(avg(sin(a)), 6) + 0.0 AS s FROM an GROUP BY 1, 2")
def stat_09(s, d):
    x = with_r(s, d).withColumn("big", (F.abs("r") > F.percentile(F.abs("r"), 0.5).over(Window.partitionBy("symbol"))).cast("long"))
    x = x.withColumns({"bucket": C("big"), "state": (C("r") > 0).cast("long") * 2 + C("big")})
    return tidy(T.fourier_residues(x, 4, 3), "symbol", "bucket", "n", c=C("c"), s=C("s"))


@query("stat_10_variance_ratio", BARS + RET + ", w AS (SELECT symbol, r, CASE WHEN count(r) OVER f = 5 THEN sum(r) OVER f END AS s FROM x WHERE r IS NOT NULL WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT symbol, round(var_pop(s) / (5 * var_pop(r)), 6) + 0.0 AS ratio FROM w GROUP BY 1")
def stat_10(s, d):
    return tidy(T.variance_ratio(with_r(s, d), "r", 5), "symbol", ratio=C("ratio"))


@query("stat_11_stability_selection")
def stat_11(s, d):
    """How often each lag is among the two most correlated with the next return over bootstrap draws of rows."""
    x = with_r(s, d).withColumns({"y": F.lead("r").over(over()), **{f"f{k}": F.lag("r", k).over(over()) for k in range(4)}}).dropna()
    draws = x.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(19)))).withColumn("w", F.pmod(F.xxhash64("symbol", "t", "draw"), F.lit(3)))  # weights 0, 1, 2
    long = draws.where("w > 0").select("draw", "w", "y", F.explode(F.array(*[F.struct(F.lit(f"f{k}").alias("name"), C(f"f{k}").alias("v")) for k in range(4)])).alias("z")).select("draw", "y", "z.*", F.explode(F.sequence(F.lit(1), C("w").cast("int"))))
    c = long.groupBy("draw", "name").agg(F.abs(F.corr("v", "y")).alias("c"))
    top = c.withColumn("n", F.row_number().over(Window.partitionBy("draw").orderBy(C("c").desc(), "name"))).where("n <= 2")
    return top.groupBy("name").agg((F.count("*") / 20).alias("frequency"))


@query("stat_13_interval_coverage", BARS + RET + ", q AS (SELECT *, CASE WHEN count(abs(r)) OVER f = 20 THEN quantile_cont(abs(r), 0.75) OVER f END AS q FROM x WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT symbol, count(*) AS n, round(avg(CASE WHEN abs(r) <= q THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS covered, round(avg(CASE WHEN r < -q THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS below FROM q WHERE q IS NOT NULL AND r IS NOT NULL GROUP BY 1")
def stat_13(s, d):
    x = W.with_log_return(R.bars_1h(s, d)).withColumn("q", W.rolling_quantile(F.abs("r"), 20, 0.75, shift=1)).where("q is not null and r is not null")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return tidy(x.groupBy("symbol").agg(F.count("*").alias("n"), share(F.abs("r") <= C("q")).alias("a"), share(C("r") < -C("q")).alias("b")), "symbol", "n", covered=C("a"), below=C("b"))


@query("stat_14_cost_ladder", with_roles("episodes") + "SELECT symbol, bps, round(sum(gross - fees - amount * bps / 10000), 4) + 0.0 AS net FROM episodes, (SELECT unnest([0, 5, 10, 20, 40]) AS bps) GROUP BY 1, 2")
def stat_14(s, d):
    ladder = s.createDataFrame([(b,) for b in (0, 5, 10, 20, 40)], "bps int")
    return R.episodes(s, d).crossJoin(F.broadcast(ladder)).groupBy("symbol", "bps").agg((F.round(F.sum(C("gross") - C("fees") - C("amount") * C("bps") / 10000), 4) + 0.0).alias("net"))


@query("stat_15_area_test", BARS + ", p AS (SELECT a.symbol AS a, b.symbol AS b, a.t, a.t // 172800000 AS win, a.close AS x, b.close AS y FROM bars a JOIN bars b ON a.t = b.t AND a.symbol < b.symbol), l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM p WINDOW w AS (PARTITION BY a, b, win ORDER BY t)), s AS (SELECT a, b, win, sum(px * (y - py) - py * (x - px)) AS area FROM l GROUP BY 1, 2, 3) SELECT a, b, count(area) AS n, round(avg(area) / (stddev_samp(area) / sqrt(count(area))), 6) + 0.0 AS t_value FROM s GROUP BY 1, 2")
def stat_15(s, d):
    from ..operators.joins import symbol_pairs

    p = symbol_pairs(R.bars_1h(s, d), "close").withColumn("win", F.floor(C("t") / 172_800_000))
    w = over(["a", "b", "win"])
    p = p.withColumns({"px": F.lag("ra").over(w), "py": F.lag("rb").over(w)})
    areas = p.groupBy("a", "b", "win").agg(F.sum(C("px") * (C("rb") - C("py")) - C("py") * (C("ra") - C("px"))).alias("area"))
    g = areas.groupBy("a", "b").agg(F.count("area").alias("n"), (F.avg("area") / (F.stddev_samp("area") / F.sqrt(F.count("area")))).alias("tv"))
    return tidy(g, "a", "b", "n", t_value=C("tv"))


@query("stat_16_sign_flip", with_roles("episodes") + "SELECT symbol, sign(sum(gross - fees)) <> sign(sum(gross - fees - amount * 0.004)) AS flips FROM episodes GROUP BY 1")
def stat_16(s, d):
    return R.episodes(s, d).groupBy("symbol").agg((F.signum(F.sum(C("gross") - C("fees"))) != F.signum(F.sum(C("gross") - C("fees") - C("amount") * 0.004))).alias("flips"))


@query("stat_17_naive_benchmark", BARS + RET + _SIGN + "SELECT symbol, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS always_long, round(avg(CASE WHEN sign(r) = sign(p1) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS last_sign FROM g WHERE p1 IS NOT NULL AND r <> 0 GROUP BY 1")
def stat_17(s, d):
    x = with_r(s, d).withColumn("p1", F.lag("r").over(over())).where("p1 is not null and r <> 0")
    g = x.groupBy("symbol").agg(F.avg(F.when(C("r") > 0, 1.0).otherwise(0.0)).alias("a"), F.avg(F.when(F.signum("r") == F.signum("p1"), 1.0).otherwise(0.0)).alias("b"))
    return tidy(g, "symbol", always_long=C("a"), last_sign=C("b"))


@query("ml_01_train_only_standardise", DAILY + ", c AS (SELECT symbol, quantile_cont(close, 0.01) AS lo, quantile_cont(close, 0.99) AS hi FROM daily WHERE t < 852076800000 GROUP BY 1), m AS (SELECT symbol, avg(least(greatest(close, lo), hi)) AS m, stddev_pop(least(greatest(close, lo), hi)) AS sd FROM daily JOIN c USING (symbol) WHERE t < 852076800000 GROUP BY 1) SELECT symbol, t, round(least(greatest((least(greatest(close, lo), hi) - m) / sd, -8), 8), 6) + 0.0 AS z FROM daily JOIN c USING (symbol) JOIN m USING (symbol)")
def ml_01(s, d):
    x = R.bars_1d(s, d)
    train = x.where(C("t") < 852_076_800_000)
    cuts = train.groupBy("symbol").agg(F.percentile("close", 0.01).alias("lo"), F.percentile("close", 0.99).alias("hi"))
    held = F.least(F.greatest("close", "lo"), "hi")
    m = train.join(cuts, "symbol").groupBy("symbol").agg(F.avg(held).alias("m"), F.stddev_pop(held).alias("sd"))
    return tidy(x.join(cuts, "symbol").join(m, "symbol"), "symbol", "t", z=F.least(F.greatest((held - C("m")) / C("sd"), F.lit(-8.0)), F.lit(8.0)))


def _features(s, d):
    """Daily features; the label looks one bar ahead and is known at that bar's time (null for the last bar of a symbol)."""
    x = R.bars_1d(s, d).withColumn("r", F.log(C("close") / F.lag("close").over(over())))
    x = x.withColumns({"f0": C("r"), "f1": F.lag("r").over(over()), "f2": F.lag("r", 2).over(over()), "up": (F.lead("r").over(over()) > 0).cast("int"), "next_r": F.lead("r").over(over()), "known_t": F.lead("t").over(over()), "month": month_ordinal(C("t")), "year": F.floor(month_ordinal(C("t")) / 12).cast("int")})
    return x.select("symbol", "t", "month", "year", "f0", "f1", "f2", "up", "next_r", "known_t")


def _folds(x, train=48, step=12, expanding=False):
    a, b = x.agg(F.min("month"), F.max("month")).first()
    return [] if a is None else M.folds_to_end(a, b, train, step, expanding=expanding)


_MEMBER = f"""{DAILY}, x AS (SELECT symbol, t, lead(t) OVER (PARTITION BY symbol ORDER BY t) AS known, year(make_timestamp(t * 1000)) * 12 + month(make_timestamp(t * 1000)) - 1 AS month FROM daily), s AS (SELECT min(month) AS a, max(month) AS b FROM x),
f AS (SELECT i AS fold, a, a + 24 + 3 * i AS test_from, least(a + 27 + 3 * i, b + 1) AS test_to FROM s, (SELECT unnest(range(0, 400)) AS i) WHERE a + 24 + 3 * i <= b), g AS (SELECT *, epoch_ms(make_date((test_from // 12)::INT, (test_from % 12 + 1)::INT, 1)) AS start FROM f)
SELECT fold, count(*) FILTER (known + 86400000 < start) AS n_train, max(known) FILTER (known + 86400000 < start) AS last_known, count(*) FILTER (month >= test_from AND month < test_to AND t >= start + 172800000) AS n_test FROM g, x GROUP BY fold"""


@query("ml_02_fold_membership", _MEMBER)
def ml_02_membership(s, d):
    """Which rows the quarterly folds of the pooled logit learn from (labels known a day before the quarter) and score (from its third day on)."""
    from ..operators.pointintime import trained, with_folds

    x = _features(s, d)
    folds = _folds(x, 24, 3, True)
    m = with_folds(x, folds, purge_ms=86_400_000, embargo_ms=172_800_000)
    learn = m.where(trained()).select(F.explode(F.sequence("_first", F.least("_last", F.lit(len(folds) - 1)))).alias("fold"), "known_t", F.lit(1).alias("a"), F.lit(0).alias("b"))
    score = m.where("_test is not null").select(C("_test").alias("fold"), F.lit(None).cast("long").alias("known_t"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    return learn.unionByName(score).groupBy(C("fold").cast("long").alias("fold")).agg(F.sum("a").alias("n_train"), F.max("known_t").alias("last_known"), F.sum("b").alias("n_test"))


@query("ml_02_walk_forward_logit")
def ml_02(s, d):
    """Pooled logit with year effects: learns from all labels known a day before a quarter, scores the quarter from its third day on."""
    from ..operators.pointintime import fold_logit, scored_by_logit, with_folds

    x = _features(s, d)
    folds = _folds(x, 24, 3, True)
    m = with_folds(x, folds, purge_ms=86_400_000, embargo_ms=172_800_000)
    fits = fold_logit(m, ["f0", "f1", "f2"], "up", len(folds), year="year")
    got = scored_by_logit(m, fits, ["f0", "f1", "f2"], year="year").dropna(subset=["up", "p"])
    return got.groupBy("fold", "n_train").agg(F.count("*").alias("n"), F.avg(((C("p") > 0.5).cast("int") == C("up")).cast("double")).alias("accuracy"), F.avg("p").alias("mean_p"))


@query("ml_03_walk_forward_forest")
def ml_03(s, d):
    x = _features(s, d)
    got = M.walk_forward(x, ["f0", "f1", "f2"], "up", _folds(x, 24, 6, True), "forest", purge_ms=86_400_000).dropna(subset=["label"])
    return got.groupBy("fold").agg(F.count("*").alias("n"), F.avg((C("prediction") == C("label")).cast("double")).alias("accuracy"))


@query("ml_04_walk_forward_boosted")
def ml_04(s, d):
    """Boosted trees on folds of 12 and 3 months with two days purged; forecasts are divided by the spread of the model's own in-sample forecasts."""
    x = _features(s, d)
    got = M.walk_forward(x, ["f0", "f1", "f2"], "next_r", _folds(x, 12, 3), "boosted", purge_ms=2 * 86_400_000, spread=True).dropna(subset=["label"])
    z = C("prediction") / F.nullif(C("spread"), F.lit(0.0))
    return got.groupBy("fold").agg(F.count("*").alias("n"), F.corr("prediction", "label").alias("ic"), F.avg((F.abs(z) >= 1).cast("double")).alias("share_strong"))


_H, _REFIT, _FIRST, _LAMBDA = 5, 21, 60, 1.0


@query("ml_05_expanding_ridge", DAILY + f""", x AS (SELECT symbol, t, close, row_number() OVER w - 1 AS i, ln(close / lag(close) OVER w) AS f, ln(close / lag(close, {_H}) OVER w) AS y FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY t)), p AS (SELECT *, lag(f, {_H}) OVER (PARTITION BY symbol ORDER BY t) AS u FROM x),
g AS (SELECT *, count(u) OVER q AS n, sum(u) OVER q AS sx, sum(y) FILTER (u IS NOT NULL) OVER q AS sy, sum(u * u) OVER q AS sxx, sum(u * y) OVER q AS sxy FROM p WINDOW q AS (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN i >= {_FIRST} AND (i - {_FIRST}) % {_REFIT} = 0 AND n >= 8 THEN (sxy - sx * sy / n) / (sxx - sx * sx / n + {_LAMBDA}) END AS slope FROM g), c AS (SELECT *, last_value(slope IGNORE NULLS) OVER q AS b1, last_value(CASE WHEN slope IS NOT NULL THEN (sy - slope * sx) / n END IGNORE NULLS) OVER q AS b0 FROM b WINDOW q AS (PARTITION BY symbol ORDER BY t))
SELECT symbol, t, round(b0 + b1 * f, 6) + 0.0 AS forecast FROM c""")
def ml_05(s, d):
    """Ridge of the return over the next 5 bars on the last return: refitted every 21 bars from bar 60 on with the labels that have landed (u + 5 <= t), in between the last fit is used."""
    w, q = over(), over().rowsBetween(Window.unboundedPreceding, 0)
    x = R.bars_1d(s, d).withColumns({"i": F.row_number().over(w) - 1, "f": F.log(C("close") / F.lag("close").over(w)), "y": F.log(C("close") / F.lag("close", _H).over(w))})
    x = x.withColumn("u", F.lag("f", _H).over(w)).withColumn("y", F.when(C("u").isNotNull(), C("y")))
    x = x.withColumns({"n": F.count("u").over(q), "sx": F.sum("u").over(q), "sy": F.sum("y").over(q), "sxx": F.sum(C("u") ** 2).over(q), "sxy": F.sum(C("u") * C("y")).over(q)})
    anchor = (C("i") >= _FIRST) & ((C("i") - _FIRST) % _REFIT == 0) & (C("n") >= 8)
    x = x.withColumn("slope", F.when(anchor, (C("sxy") - C("sx") * C("sy") / C("n")) / (C("sxx") - C("sx") ** 2 / C("n") + _LAMBDA)))
    held = lambda v: F.last(F.when(C("slope").isNotNull(), v), ignorenulls=True).over(q)
    return tidy(x, "symbol", "t", forecast=held((C("sy") - C("slope") * C("sx")) / C("n")) + held(C("slope")) * C("f"))


@query("udf_02_rolling_function", BARS + "SELECT symbol, t, round(CASE WHEN count(*) OVER f = 10 THEN max(close) OVER f - min(close) OVER f END, 6) + 0.0 AS spread FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def udf_02(s, d):
    from ..functions.expr import rolling

    return tidy(R.bars_1h(s, d), "symbol", "t", spread=rolling(C("close"), 10, F.max) - rolling(C("close"), 10, F.min))


@query("udf_04_generated_calendar", BARS + ", g AS (SELECT min(t) AS a, max(t) AS b FROM bars), c AS (SELECT unnest(range(a, b + 1, 86400000)) AS t FROM g) SELECT c.t, count(bars.t) AS n FROM c LEFT JOIN bars ON bars.t = c.t GROUP BY 1")
def udf_04(s, d):
    b = R.bars_1h(s, d)
    days = b.agg(F.min("t").alias("a"), F.max("t").alias("b")).select(F.explode(F.sequence("a", "b", F.lit(86_400_000).cast("long"))).alias("t"))
    return days.join(b.select("t", F.lit(1).alias("one")), "t", "left").groupBy("t").agg(F.count("one").alias("n"))
