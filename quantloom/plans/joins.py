"""Time joins, cell joins, ranking and set queries."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import over, tidy
from ..operators import joins as J
from ..registry import query
from ..sources import roles as R
from ..sources.roles import DAY_MS, HOUR_MS, with_roles

C = F.col
BARS, DS = with_roles("bars"), with_roles("daily", "settlements")


def _official(s, d):
    return R.settlements(s, d).where("status = 'official'")


@query("join_01_asof_last_bar", DS + "SELECT b.symbol, b.t, count(*) AS n, round(sum(rate), 6) + 0.0 AS charged FROM settlements s ASOF JOIN daily b ON s.symbol = b.symbol AND s.st > b.t WHERE status = 'official' GROUP BY 1, 2")
def join_01(s, d):
    bars = R.bars_1d(s, d).select("symbol", "t")
    times = _official(s, d).groupBy("symbol", "st").agg(F.count("*").alias("n"), F.sum("rate").alias("rate"))  # settlements of one time go to one bar
    got = J.asof(times, bars, key="symbol", left_time="st", right_time="t", values=[], strict=True)
    return tidy(got.where("matched_at is not null").groupBy("symbol", C("matched_at").alias("t")).agg(F.sum("n").alias("n"), F.sum("rate").alias("c")), "symbol", "t", "n", charged=C("c"))


@query("join_02_containing_interval", DS + "SELECT b.symbol, b.t, count(*) AS n, round(sum(rate), 6) + 0.0 AS charged FROM settlements s JOIN daily b ON s.symbol = b.symbol AND s.st >= b.t AND s.st < b.t + 86400000 WHERE status = 'official' GROUP BY 1, 2")
def join_02(s, d):
    e = _official(s, d).withColumn("t", J.contain(None, "st", DAY_MS))
    got = e.join(R.bars_1d(s, d).select("symbol", "t"), ["symbol", "t"]).groupBy("symbol", "t").agg(F.count("*").alias("n"), F.sum("rate").alias("c"))
    return tidy(got, "symbol", "t", "n", charged=C("c"))


_LAST = ", u AS (SELECT symbol, st, max(rate) AS rate FROM settlements WHERE status = 'official' GROUP BY 1, 2) "


def _rates(s, d):
    return _official(s, d).groupBy("symbol", "st").agg(F.max("rate").alias("rate"))


@query("join_03_asof_max_age", DS + _LAST + "SELECT b.symbol, b.t, round(CASE WHEN b.t - u.st <= 86400000 THEN rate ELSE 0.0 END, 6) + 0.0 AS rate, coalesce(b.t - u.st > 86400000, true) AS missing FROM daily b ASOF LEFT JOIN u ON b.symbol = u.symbol AND b.t >= u.st")
def join_03(s, d):
    got = J.asof(R.bars_1d(s, d).select("symbol", "t"), _rates(s, d), key="symbol", left_time="t", right_time="st", values=["rate"], max_age=DAY_MS)
    return tidy(got.withColumn("missing", C("rate").isNull()), "symbol", "t", "missing", rate=F.coalesce("rate", F.lit(0.0)))


@query("join_04_bounded_seed", DS + _LAST + "SELECT b.symbol, b.t, round(CASE WHEN b.t - u.st <= 864000000 THEN rate END, 6) + 0.0 AS held FROM daily b ASOF LEFT JOIN u ON b.symbol = u.symbol AND b.t >= u.st")
def join_04(s, d):
    got = J.asof(R.bars_1d(s, d).select("symbol", "t"), _rates(s, d), key="symbol", left_time="t", right_time="st", values=["rate"], max_age=10 * DAY_MS)
    return tidy(got, "symbol", "t", held=C("rate"))


@query("join_05_next_executable_bar", DS + _LAST + "SELECT u.symbol, u.st, b.t AS next_at, round(b.open, 6) + 0.0 AS entry FROM u ASOF LEFT JOIN daily b ON b.symbol = u.symbol AND u.st < b.t")
def join_05(s, d):
    got = J.next_row(_rates(s, d).select("symbol", "st"), R.bars_1d(s, d).select("symbol", "t", "open"), key="symbol", left_time="st", right_time="t", values=["open"])
    return tidy(got, "symbol", "st", "next_at", entry=C("open"))


@query("join_06_two_legs", BARS + "SELECT a.t, round(a.close / b.close, 6) + 0.0 AS ratio FROM bars a JOIN bars b ON a.t = b.t WHERE a.symbol = 'click' AND b.symbol = 'view'")
def join_06(s, d):
    b = R.bars_1h(s, d)
    x = b.where("symbol = 'click'").select("t", C("close").alias("a")).join(b.where("symbol = 'view'").select("t", C("close").alias("b")), "t")
    return tidy(x, "t", ratio=C("a") / C("b"))


@query("join_07_lookup", with_roles("daily") + ", m AS (SELECT symbol, t // 2592000000 AS period, sign(last(close ORDER BY t) - first(close ORDER BY t))::BIGINT AS dir FROM daily GROUP BY 1, 2) SELECT d.symbol, d.t, coalesce(m.dir, 0) AS direction FROM daily d LEFT JOIN m ON m.symbol = d.symbol AND m.period = d.t // 2592000000 - 1")
def join_07(s, d):
    x = R.bars_1d(s, d).withColumn("period", F.floor(C("t") / 2_592_000_000))
    by = F.struct("t", "close")
    m = x.groupBy("symbol", (C("period") + 1).alias("period")).agg(F.signum(F.max(by)["close"] - F.min(by)["close"]).cast("long").alias("dir"))
    return x.join(m, ["symbol", "period"], "left").select("symbol", "t", F.coalesce("dir", F.lit(0).cast("long")).alias("direction"))


@query("join_08_exactly_one_cell", with_roles("grid") + ", w AS (SELECT cohort, size, kind FROM grid WHERE grid = 'A' QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY net_pnl DESC, size, kind) = 1) SELECT w.cohort, w.size, w.kind, count(g.grid) AS hits FROM w LEFT JOIN grid g ON g.cohort = w.cohort AND g.size = w.size AND g.kind = w.kind AND g.grid = 'N' GROUP BY ALL")
def join_08(s, d):
    g = R.grid(s, d)
    best = F.row_number().over(Window.partitionBy("cohort").orderBy(C("net_pnl").desc(), "size", "kind"))
    w = g.where("grid = 'A'").withColumn("n", best).where("n = 1").select("cohort", "size", "kind")
    return J.exactly_one(w, g.where("grid = 'N'"), ["cohort", "size", "kind"])


_NB = ", p AS (SELECT *, dense_rank() OVER (ORDER BY size) AS ps, dense_rank() OVER (ORDER BY kind) AS pk FROM grid) "


@query("join_09_face_neighbours", with_roles("grid") + _NB + "SELECT a.cohort, a.grid, a.size, a.kind, count(*) AS neighbours, count(*) FILTER (sign(a.net_pnl) = sign(b.net_pnl)) AS same_sign FROM p a JOIN p b ON a.cohort = b.cohort AND a.grid = b.grid AND abs(a.ps - b.ps) + abs(a.pk - b.pk) = 1 GROUP BY ALL")
def join_09(s, d):
    n = J.face_neighbours(R.grid(s, d).select("cohort", "grid", "size", "kind", "net_pnl"), ["size", "kind"], ["cohort", "grid"])
    return n.groupBy("cohort", "grid", "size", "kind").agg(F.count("*").alias("neighbours"), F.count_if(F.signum("net_pnl") == F.signum("n_net_pnl")).alias("same_sign"))


@query("join_10_symbol_pairs", BARS + "SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(avg(a.close - b.close), 9) + 0.0 AS gap FROM bars a JOIN bars b ON a.t = b.t AND a.symbol < b.symbol GROUP BY 1, 2")
def join_10(s, d):
    p = J.symbol_pairs(R.bars_1h(s, d), "close")
    return p.groupBy("a", "b").agg(F.count("*").alias("n"), (F.round(F.avg(C("ra") - C("rb")), 9) + 0.0).alias("gap"))


@query("join_11_semi_anti", "SELECT c_mktsegment AS segment, count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS used, count(*) FILTER (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS queued FROM customer GROUP BY 1")
def join_11(s, d):
    c, o = R.read(s, d, "customer"), R.read(s, d, "orders")
    on = C("c_custkey") == C("o_custkey")
    used = c.join(o, on, "left_semi").select(C("c_mktsegment").alias("segment"), F.lit(1).alias("u"))
    both = used.unionByName(c.join(o, on, "left_anti").select(C("c_mktsegment").alias("segment"), F.lit(0).alias("u")))
    return both.groupBy("segment").agg(F.count_if(C("u") == 1).alias("used"), F.count_if(C("u") == 0).alias("queued"))


@query("join_12_parameter_grid", with_roles("episodes") + "SELECT symbol, bps, floor_usd, count(*) AS n, round(sum(gross - fees - amount * bps / 10000), 4) + 0.0 AS net FROM episodes, (SELECT unnest([0, 10, 40]) AS bps), (SELECT unnest([0, 100000]) AS floor_usd) WHERE amount >= floor_usd GROUP BY ALL")
def join_12(s, d):
    axes = s.createDataFrame([(b,) for b in (0, 10, 40)], "bps int").crossJoin(s.createDataFrame([(0,), (100000,)], "floor_usd int"))
    x = R.episodes(s, d).crossJoin(F.broadcast(axes)).where("amount >= floor_usd")  # six parameter cells
    return x.groupBy("symbol", "bps", "floor_usd").agg(F.count("*").alias("n"), (F.round(F.sum(C("gross") - C("fees") - C("amount") * C("bps") / 10000), 4) + 0.0).alias("net"))


@query("join_13_regime_gate", BARS + ", g AS (SELECT t, avg(close) > 110 AS gate FROM bars GROUP BY 1) SELECT symbol, count(*) FILTER (gate) AS open_bars, count(*) AS n FROM bars JOIN g USING (t) GROUP BY 1")
def join_13(s, d):
    b = R.bars_1h(s, d)
    gate = b.groupBy("t").agg((F.avg("close") > 110).alias("gate"))
    return b.join(gate, "t").groupBy("symbol").agg(F.count_if("gate").alias("open_bars"), F.count("*").alias("n"))


_WIN = "row_number() OVER (PARTITION BY cohort ORDER BY sharpe DESC, net_pnl DESC, size, kind)"


def winners(g):
    """Best historical cell of each cohort with the reason where it doesn't pass."""
    order = Window.partitionBy("cohort").orderBy(C("sharpe").desc(), C("net_pnl").desc(), "size", "kind")
    w = g.where("grid = 'A'").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    reason = F.when(C("episodes") < 3, "insufficient_trades").when((C("net_pnl") <= 0) | (C("sharpe") <= 0), "not_profitable").otherwise("passed")
    return w.withColumn("reason", reason)


@query("top_01_cohort_winner", with_roles("grid") + f"SELECT cohort, size, kind, episodes, CASE WHEN episodes < 3 THEN 'insufficient_trades' WHEN net_pnl <= 0 OR sharpe <= 0 THEN 'not_profitable' ELSE 'passed' END AS reason, round(net_pnl, 4) + 0.0 AS net_pnl FROM grid WHERE grid = 'A' QUALIFY {_WIN} = 1")
def top_01(s, d):
    w = winners(R.grid(s, d))
    return w.select("cohort", "size", "kind", "episodes", "reason", (F.round("net_pnl", 4) + 0.0).alias("net_pnl"))


@query("top_02_cohort_verdict", with_roles("grid") + _NB + f", w AS (SELECT * FROM p WHERE grid = 'A' QUALIFY {_WIN} = 1), n AS (SELECT w.cohort, count(b.net_pnl) AS k, count(*) FILTER (sign(b.net_pnl) = sign(w.net_pnl)) AS same FROM w LEFT JOIN p b ON b.cohort = w.cohort AND b.grid = 'A' AND abs(b.ps - w.ps) + abs(b.pk - w.pk) = 1 GROUP BY 1), o AS (SELECT w.cohort, sum(g.net_pnl) AS oos FROM w LEFT JOIN grid g ON g.cohort = w.cohort AND g.size = w.size AND g.kind = w.kind AND g.grid = 'N' GROUP BY 1) SELECT w.cohort, concat_ws(',', CASE WHEN w.episodes < 3 THEN 'trades' END, CASE WHEN coalesce(oos, 0) <= 0 THEN 'oos' END, CASE WHEN coalesce(same, 0) < 0.6 * coalesce(k, 0) THEN 'neighbours' END) AS reasons FROM w JOIN n USING (cohort) JOIN o USING (cohort)")
def top_02(s, d):
    g = R.grid(s, d)
    w = winners(g).drop("reason", "sharpe")
    near = J.face_neighbours(g.where("grid = 'A'").select("cohort", "size", "kind", "net_pnl"), ["size", "kind"], ["cohort"])
    near = near.groupBy("cohort", "size", "kind").agg(F.count("*").alias("k"), F.count_if(F.signum("net_pnl") == F.signum("n_net_pnl")).alias("same"))
    oos = g.where("grid = 'N'").select("cohort", "size", "kind", C("net_pnl").alias("oos"))
    x = w.join(near, ["cohort", "size", "kind"], "left").join(oos, ["cohort", "size", "kind"], "left").fillna(0, ["k", "same"]).fillna(0.0, ["oos"])
    faults = F.array_compact(F.array(F.when(C("episodes") < 3, "trades"), F.when(C("oos") <= 0, "oos"), F.when(C("same") < 0.6 * C("k"), "neighbours")))
    return x.select("cohort", F.concat_ws(",", faults).alias("reasons"))


@query("top_03_leaderboard", with_roles("slices") + ", a AS (SELECT survivor, count(*) AS slices, sum(pnl) AS pnl, min(sharpe) AS worst, sum(n_episodes)::BIGINT AS episodes, sum(sharpe * n_episodes) / nullif(sum(n_episodes), 0) AS sharpe, max(sharpe) - min(sharpe) AS spread FROM slices GROUP BY 1), j AS (SELECT c_custkey AS survivor, slices, pnl, worst, episodes, sharpe, spread FROM customer LEFT JOIN a ON c_custkey = survivor) SELECT survivor, row_number() OVER (ORDER BY (slices IS NOT NULL) DESC, round(pnl, 4) DESC NULLS LAST, round(sharpe, 6) DESC NULLS LAST, worst DESC NULLS LAST, episodes DESC NULLS LAST, slices DESC NULLS LAST, abs(spread) ASC NULLS LAST, survivor) AS place, place = 1 AND slices IS NOT NULL AS champion FROM j QUALIFY place <= 10")
def top_03(s, d):
    """Those with forward slices first, then six keys, nulls last, then the id; the best ten, the first of them the champion."""
    a = R.slices(s, d).groupBy("survivor").agg(F.count("*").alias("slices"), F.sum("pnl").alias("pnl"), F.min("sharpe").alias("worst"), F.sum("n_episodes").alias("episodes"), (F.sum(C("sharpe") * C("n_episodes")) / F.nullif(F.sum("n_episodes"), F.lit(0))).alias("sharpe"), (F.max("sharpe") - F.min("sharpe")).alias("spread"))
    j = R.read(s, d, "customer").select(C("c_custkey").alias("survivor")).join(a, "survivor", "left")
    keys = [F.round("pnl", 4), F.round("sharpe", 6), C("worst"), C("episodes"), C("slices")]
    order = [C("slices").isNotNull().desc(), *[k.desc_nulls_last() for k in keys], F.abs("spread").asc_nulls_last(), C("survivor")]
    top = j.orderBy(*order).limit(10).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # a top-k report
    return top.select("survivor", "place", ((C("place") == 1) & C("slices").isNotNull()).alias("champion"))


@query("top_04_newest_attempt", with_roles("runs") + ", k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY t DESC, ordinal DESC, state DESC) AS n, count(*) OVER (PARTITION BY run, t, ordinal) AS same FROM runs) SELECT run, CASE WHEN same = 1 THEN state END AS state, ordinal, t, same > 1 AS refused FROM k WHERE n = 1")
def top_04(s, d):
    """The newest attempt by time, then ordinal; where several share both it is refused and has no state."""
    x = R.run_events(s, d).groupBy("run", "t", "ordinal").agg(F.count("*").alias("same"), F.max("state").alias("state"))
    x = x.groupBy("run").agg(F.max(F.struct("t", "ordinal", "state", "same")).alias("x"))
    return x.select("run", F.when(C("x.same") == 1, C("x.state")).alias("state"), "x.ordinal", "x.t", (C("x.same") > 1).alias("refused"))


@query("top_05_first_per_family", with_roles("runs") + ", f AS (SELECT run, t, ordinal FROM runs WHERE state = 'done' QUALIFY row_number() OVER (PARTITION BY run ORDER BY t, ordinal) = 1) SELECT run, t, ordinal, row_number() OVER (ORDER BY t DESC, ordinal DESC) = 1 AS newest FROM f")
def top_05(s, d):
    f = R.run_events(s, d).where("state = 'done'").groupBy("run").agg(F.min(F.struct("t", "ordinal")).alias("x")).select("run", "x.*")
    last = f.agg(F.max(F.struct("t", "ordinal")).alias("m"))
    return f.crossJoin(F.broadcast(last)).select("run", "t", "ordinal", (F.struct("t", "ordinal") == C("m")).alias("newest"))


@query("top_06_projection", with_roles("episodes") + "SELECT episode, symbol, printf('%.2f', gross) AS gross_text FROM episodes ORDER BY gross DESC, episode LIMIT 20")
def top_06(s, d):
    return R.episodes(s, d).orderBy(C("gross").desc(), "episode").limit(20).select("episode", "symbol", F.format_string("%.2f", "gross").alias("gross_text"))


@query("set_01_union_of_grids", with_roles("grid") + "SELECT grid, count(*) AS n, round(sum(net_pnl), 4) + 0.0 AS net FROM (SELECT * FROM grid WHERE grid = 'A' UNION ALL SELECT * FROM grid WHERE grid = 'N' UNION ALL SELECT * FROM grid WHERE grid = 'R') GROUP BY 1")
def set_01(s, d):
    g = R.grid(s, d)
    u = g.where("grid = 'A'").unionByName(g.where("grid = 'N'")).unionByName(g.where("grid = 'R'"))
    return u.groupBy("grid").agg(F.count("*").alias("n"), (F.round(F.sum("net_pnl"), 4) + 0.0).alias("net"))


@query("set_02_common_dates", BARS + "SELECT (SELECT count(DISTINCT t) FROM bars WHERE symbol IN ('click', 'view')) AS in_either, (SELECT count(*) FROM (SELECT t FROM bars WHERE symbol = 'click' INTERSECT SELECT t FROM bars WHERE symbol = 'view')) AS in_both")
def set_02(s, d):
    b = R.bars_1h(s, d)
    x, y = b.where("symbol = 'click'").select("t"), b.where("symbol = 'view'").select("t")
    return x.union(y).distinct().agg(F.count("*").alias("in_either")).crossJoin(x.intersect(y).agg(F.count("*").alias("in_both")))


@query("set_03_difference", BARS + "SELECT t FROM bars WHERE symbol = 'click' EXCEPT SELECT t FROM bars WHERE symbol = 'view'")
def set_03(s, d):
    b = R.bars_1h(s, d)
    return b.where("symbol = 'click'").select("t").exceptAll(b.where("symbol = 'view'").select("t"))


@query("set_04_distinct", with_roles("settlements") + "SELECT symbol, count(*) AS n, count(DISTINCT st) AS times, count(*) - count(DISTINCT st) AS repeated FROM settlements GROUP BY 1")
def set_04(s, d):
    return R.settlements(s, d).groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct("st").alias("times"), (F.count("*") - F.count_distinct("st")).alias("repeated"))
