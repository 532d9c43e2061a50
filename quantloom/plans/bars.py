"""Bars, calendars and data quality over the bar roles."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import date_of, day_of, month_ordinal, over, quarter_ordinal, tidy
from ..operators import bars as B
from ..operators import quality as Q
from ..registry import query
from ..sources import roles as R
from ..sources.roles import DAY_MS, HOUR_MS, with_roles

_OHLCV = "round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume"


def _ohlcv(df, *keys):
    return tidy(df, *keys, **{c: F.col(c) for c in ("open", "high", "low", "close", "volume")})


@query("bar_01_tick_bars", with_roles("bars") + f"SELECT symbol, t, {_OHLCV} FROM bars")
def bar_01(s, d):
    return _ohlcv(R.bars_1h(s, d), "symbol", "t")


@query("bar_01_user_bars", with_roles("ticks") + f"SELECT symbol, t, {_OHLCV} FROM (SELECT user_id AS symbol, (us // 86400000000) * 86400000 AS t, first(price ORDER BY us, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY us, seq) AS close, sum(qty) AS volume FROM ticks GROUP BY ALL)")
def bar_01u(s, d):
    return _ohlcv(B.bars_from_ticks(R.ticks(s, d).withColumn("symbol", F.col("user_id")), DAY_MS), "symbol", "t")


_BIG = "big AS (SELECT symbol, (t // 14400000) * 14400000 AS bin, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(volume) AS volume, count(*) AS n FROM bars GROUP BY ALL)"


@query("bar_02_larger_bars", with_roles("bars") + f", {_BIG} SELECT symbol, bin, bin + 14400000 AS available_at, n, {_OHLCV} FROM big WHERE n = 4")
def bar_02(s, d):
    return _ohlcv(B.larger_bars(R.bars_1h(s, d), 4 * HOUR_MS, HOUR_MS, full_only=True), "symbol", "bin", "available_at", "n")


@query("bar_03_day_end", with_roles("bars") + "SELECT symbol, t, t // 86400000 AS day, row_number() OVER (PARTITION BY symbol, t // 86400000 ORDER BY t DESC) = 1 AS is_day_end FROM bars")
def bar_03(s, d):
    return B.day_marks(R.bars_1h(s, d)).select("symbol", "t", "day", "is_day_end")


_SLOTS = """, got AS (SELECT symbol, t // 86400000 AS day, (t // 7200000) % 12 AS slot, sum(volume) AS volume FROM bars GROUP BY ALL),
span AS (SELECT symbol, min(day) AS a, max(day) AS b FROM got GROUP BY 1), days AS (SELECT symbol, unnest(range(a, b + 1)) AS day FROM span),
dense AS (SELECT symbol, day, slot, coalesce(volume, 0.0) AS volume FROM (SELECT symbol, day, unnest(range(0, 12)) AS slot FROM days) LEFT JOIN got USING (symbol, day, slot)),
prof AS (SELECT symbol, day, slot, volume, CASE WHEN count(*) OVER w = 7 THEN avg(volume) OVER w END AS profile FROM dense WINDOW w AS (PARTITION BY symbol, slot ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING)) """


@query("bar_04_slot_profile", with_roles("bars") + _SLOTS + "SELECT symbol, day, slot, round(volume, 6) + 0.0 AS volume, round(profile, 6) + 0.0 AS profile FROM prof")
def bar_04(s, d):
    return tidy(B.slot_profile(R.bars_1h(s, d), 2 * HOUR_MS, 7), "symbol", "day", "slot", volume=F.col("volume"), profile=F.col("profile"))


@query("bar_04_peak_slot", with_roles("bars") + _SLOTS + "SELECT symbol, day, slot AS peak_slot FROM (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY profile DESC, slot) AS n FROM prof WHERE profile IS NOT NULL) WHERE n = 1")
def bar_04p(s, d):
    return B.peak_slot(B.slot_profile(R.bars_1h(s, d), 2 * HOUR_MS, 7))


_MONTH = "(year(make_timestamp(t * 1000)) * 12 + month(make_timestamp(t * 1000)) - 1)::BIGINT"
_QUARTER = "(year(make_timestamp(t * 1000)) * 4 + quarter(make_timestamp(t * 1000)) - 1)::BIGINT"


@query("bar_05_month_end", with_roles("daily") + f"SELECT symbol, {_MONTH} AS month, max(t) AS t, round(last(close ORDER BY t), 6) + 0.0 AS close FROM daily GROUP BY 1, 2")
def bar_05(s, d):
    return tidy(B.month_end_rows(R.bars_1d(s, d)), "symbol", "month", "t", close=F.col("close"))


@query(
    "bar_06_quarter_panel",
    with_roles("daily")
    + f""", x AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS r, close / max(close) OVER (PARTITION BY symbol ORDER BY t // 86400000 RANGE BETWEEN 364 PRECEDING AND CURRENT ROW) - 1 AS dd, {_QUARTER} AS quarter FROM daily),
    g AS (SELECT symbol, quarter, count(*) AS days, stddev_samp(r) AS vol, ln(avg(close * volume)) AS log_dollar, last(close ORDER BY t) / first(close ORDER BY t) - 1 AS ret, last(dd ORDER BY t) AS dd_end, min(dd) <= -0.9 AS touched FROM x GROUP BY 1, 2)
    SELECT symbol, quarter, days, touched, touched AND coalesce(max(touched::INT) OVER (PARTITION BY symbol ORDER BY quarter ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS onset,
    round(vol, 6) + 0.0 AS vol, round(log_dollar, 6) + 0.0 AS log_dollar, round(ret, 6) + 0.0 AS ret, round(dd_end, 6) + 0.0 AS dd_end FROM g""",
)
def bar_06(s, d):
    p = B.quarter_panel(R.bars_1d(s, d), touch=-0.9)
    return tidy(p, "symbol", "quarter", "days", "touched", "onset", vol=F.col("vol"), log_dollar=F.col("log_dollar"), ret=F.col("ret"), dd_end=F.col("dd_end"))


@query("bar_08_clock_windows", with_roles("bars") + "SELECT a.symbol, a.t, round(a.open, 6) + 0.0 AS entry, round(b.open, 6) + 0.0 AS exit, b.open IS NULL AS cut FROM bars a LEFT JOIN bars b ON a.symbol = b.symbol AND b.t = a.t + 18000000 WHERE (a.t // 3600000) % 24 = 20 AND isodow(make_timestamp(a.t * 1000)) = 5")
def bar_08(s, d):
    return tidy(B.clock_windows(R.bars_1h(s, d), 20, 5, weekday=5), "symbol", "t", "cut", entry=F.col("entry"), exit=F.col("exit"))


@query("bar_10_cycles", with_roles("bars") + """, x AS (SELECT symbol, t, (t - min(t) OVER (PARTITION BY symbol)) // 3600000 AS n FROM bars), c AS (SELECT unnest(range(0, 60)) AS cycle)
    SELECT symbol, cycle, CASE WHEN n - cycle * 48 < 120 THEN 'formation' ELSE 'trading' END AS part, count(*) AS n_bars, min(t) AS first_t, max(t) AS last_t FROM x JOIN c ON n >= cycle * 48 AND n < cycle * 48 + 168 GROUP BY ALL""")
def bar_10(s, d):
    return B.cycles(R.bars_1h(s, d), 120, 48, HOUR_MS).groupBy("symbol", "cycle", "part").agg(F.count("*").alias("n_bars"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("bar_11_walk_forward_folds", with_roles("daily") + f""", m AS (SELECT symbol, t, {_MONTH} AS month, lead(t, 2) OVER (PARTITION BY symbol ORDER BY t) AS known FROM daily), s AS (SELECT symbol, min(month) AS a, max(month) AS b FROM m GROUP BY 1),
    f AS (SELECT symbol, i AS fold, a + 3 * i AS train_from, a + 3 * i + 12 AS test_from, a + 3 * i + 15 AS test_to FROM s, (SELECT unnest(range(0, 100)) AS i) WHERE a + 3 * i + 15 <= b + 1)
    SELECT f.symbol, fold, train_from, test_from, test_to, count(*) FILTER (month < test_from) AS n_train, count(*) FILTER (month >= test_from) AS n_test, count(*) FILTER (month < test_from AND known < epoch_ms(make_date(test_from // 12, test_from % 12 + 1, 1))) AS n_train_purged, count(*) FILTER (month >= test_from AND t >= epoch_ms(make_date(test_from // 12, test_from % 12 + 1, 1)) + 5 * 86400000) AS n_test_embargoed FROM f JOIN m ON f.symbol = m.symbol AND month >= train_from AND month < test_to GROUP BY ALL""")
def bar_11(s, d):
    m = R.bars_1d(s, d).select("symbol", "t", month_ordinal(F.col("t")).alias("month"), F.lead("t", 2).over(over()).alias("known"))
    span = m.groupBy("symbol").agg(F.min("month").alias("a"), F.max("month").alias("b"))
    table = span.select("symbol", F.inline(B.folds(F.col("a"), F.col("b"), 12, 3, 3)))
    by_month = table.withColumn("month", F.explode(F.sequence("train_from", F.col("test_to") - 1)))  # an equi-join in place of a range join
    got = by_month.join(m, ["symbol", "month"])
    train, test = F.col("month") < F.col("test_from"), F.col("month") >= F.col("test_from")
    opens = F.unix_date(F.make_date(F.floor(F.col("test_from") / 12).cast("int"), (F.col("test_from") % 12 + 1).cast("int"), F.lit(1))) * F.lit(86_400_000).cast("long")
    # rows whose label, two bars ahead, isn't known before the test months are purged; the first five days of the test months are under embargo
    return got.groupBy("symbol", "fold", "train_from", "test_from", "test_to").agg(
        F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"), F.count_if(train & (F.col("known") < opens)).alias("n_train_purged"),
        F.count_if(test & (F.col("t") >= opens + 5 * 86_400_000)).alias("n_test_embargoed"),
    )


@query("bar_12_iso_week_rebalance", with_roles("daily") + "SELECT symbol, t, coalesce((t // 86400000 + 3) // 7 <> lag((t // 86400000 + 3) // 7) OVER (PARTITION BY symbol ORDER BY t), true) AS rebalance FROM daily")
def bar_12(s, d):
    return B.week_marks(R.bars_1d(s, d)).select("symbol", "t", "rebalance")


@query("bar_13_joint_panel", with_roles("bars") + """, d AS (SELECT DISTINCT t FROM bars), k AS (SELECT DISTINCT symbol FROM bars), f AS (SELECT k.symbol, d.t, b.close, CASE WHEN b.close IS NOT NULL THEN d.t END AS kt FROM d CROSS JOIN k LEFT JOIN bars b ON b.symbol = k.symbol AND b.t = d.t),
    c AS (SELECT *, arg_max(close, kt) OVER w AS known, max(kt) OVER w AS known_t FROM f WINDOW w AS (PARTITION BY symbol ORDER BY t)), g AS (SELECT symbol, t, close, CASE WHEN t - known_t <= 86400000 THEN known END AS filled FROM c)
    SELECT symbol, t, round(filled, 6) + 0.0 AS close, close IS NULL AS carried FROM g QUALIFY count(filled) OVER (PARTITION BY t) = count(*) OVER (PARTITION BY t)""")
def bar_13(s, d):
    return tidy(B.joint_panel(R.bars_1h(s, d), 1), "symbol", "t", "carried", close=F.col("close"))


@query("bar_14_market_bundle", with_roles("daily", "settlements") + """, a AS (SELECT t // 86400000 AS day, avg(close) AS spot FROM daily WHERE symbol = '1-URGENT' GROUP BY 1), b AS (SELECT t // 86400000 AS day, avg(close) AS basket FROM daily WHERE symbol <> '1-URGENT' GROUP BY 1), f AS (SELECT st // 86400000 AS day, sum(rate) * 365 AS funding FROM settlements WHERE status = 'official' GROUP BY 1),
    j AS (SELECT day, spot, basket, funding FROM a FULL JOIN b USING (day) FULL JOIN f USING (day)), c AS (SELECT first(basket ORDER BY day) AS base FROM j WHERE spot IS NOT NULL AND basket IS NOT NULL AND funding IS NOT NULL)
    SELECT day, round(spot, 6) + 0.0 AS spot, round(basket / base, 6) + 0.0 AS basket, round(funding, 6) + 0.0 AS funding FROM j, c""")
def bar_14(s, d):
    daily, day = R.bars_1d(s, d), day_of(F.col("t")).alias("day")
    spot = daily.where("symbol = '1-URGENT'").groupBy(day).agg(F.avg("close").alias("spot"))
    basket = daily.where("symbol <> '1-URGENT'").groupBy(day).agg(F.avg("close").alias("basket"))
    funding = R.settlements(s, d).where("status = 'official'").groupBy(day_of(F.col("st")).alias("day")).agg((F.sum("rate") * 365).alias("funding"))
    joined = spot.join(basket, "day", "full").join(funding, "day", "full")
    base = joined.dropna().agg(F.min(F.struct("day", "basket"))["basket"].alias("base"))
    return tidy(joined.crossJoin(F.broadcast(base)), "day", spot=F.col("spot"), basket=F.col("basket") / F.col("base"), funding=F.col("funding"))


@query("bar_15_rebalance_instants", with_roles("bars") + "SELECT symbol, t, n FROM (SELECT symbol, t, row_number() OVER w AS n, lead(t) OVER w AS nx FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)) WHERE n > 24 AND (n - 25) % 6 = 0 AND nx IS NOT NULL")
def bar_15(s, d):
    return B.every_kth(R.bars_1h(s, d), 6, 24).select("symbol", "t", F.col("n").cast("long").alias("n"))


@query("bar_16_month_bounds", with_roles("daily") + f"SELECT symbol, t, min(t) OVER (PARTITION BY symbol, {_MONTH}) AS month_first, max(t) OVER (PARTITION BY symbol, {_MONTH}) AS month_last FROM daily")
def bar_16(s, d):
    return B.month_bounds(R.bars_1d(s, d)).select("symbol", "t", "month_first", "month_last")


@query("fn_01_time", with_roles("daily") + f"SELECT DISTINCT t, t // 86400000 AS day, strftime(make_timestamp(t * 1000), '%Y-%m-%d') AS iso, {_MONTH} AS month, {_QUARTER} AS quarter, year(make_timestamp(t * 1000)) || 'Q' || quarter(make_timestamp(t * 1000)) AS quarter_label, weekofyear(make_timestamp(t * 1000))::BIGINT AS week, isodow(make_timestamp(t * 1000))::BIGINT AS weekday FROM daily")
def fn_01(s, d):
    t = F.col("t")
    return R.bars_1d(s, d).select("t").distinct().select(
        "t", day_of(t).alias("day"), F.date_format(date_of(t), "yyyy-MM-dd").alias("iso"), month_ordinal(t).alias("month"), quarter_ordinal(t).alias("quarter"),
        F.concat(F.year(date_of(t)).cast("string"), F.lit("Q"), F.quarter(date_of(t)).cast("string")).alias("quarter_label"), F.weekofyear(date_of(t)).cast("long").alias("week"), (F.weekday(date_of(t)) + 1).cast("long").alias("weekday"),
    )


_LAG = "lag(t) OVER (PARTITION BY symbol ORDER BY t)"


@query("dq_01_gap_report", with_roles("bars") + f""", x AS (SELECT *, t - {_LAG} AS step FROM bars)
    SELECT symbol, count(*) AS n, count(*) FILTER (step <> 3600000) AS gaps, coalesce(sum(step // 3600000 - 1) FILTER (step > 3600000), 0)::BIGINT AS missing, count(*) FILTER (step % 3600000 <> 0) AS off_grid, count(*) FILTER (volume = 0) AS zero_volume, (max(t) - min(t)) // 3600000 + 1 AS expected FROM x GROUP BY 1""")
def dq_01(s, d):
    return Q.gap_report(R.bars_1h(s, d), HOUR_MS)


@query("dq_01_first_gaps", with_roles("bars") + f"SELECT symbol, n, t, missing FROM (SELECT symbol, t, step // 3600000 - 1 AS missing, row_number() OVER (PARTITION BY symbol ORDER BY t) AS n FROM (SELECT *, t - {_LAG} AS step FROM bars) WHERE step > 3600000) WHERE n <= 5")
def dq_01g(s, d):
    return Q.first_gaps(R.bars_1h(s, d), HOUR_MS, 5)


@query("dq_02_complete_days", with_roles("bars") + f"SELECT symbol, t // 86400000 AS day, count(*) AS n, count(*) = 24 AND count(*) FILTER (step <> 3600000) = 0 AS complete FROM (SELECT *, t - lag(t) OVER (PARTITION BY symbol, t // 86400000 ORDER BY t) AS step FROM bars) GROUP BY 1, 2")
def dq_02(s, d):
    return Q.complete_days(R.bars_1h(s, d), HOUR_MS)


@query("dq_03_contiguous_runs", with_roles("bars") + f"SELECT symbol, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM (SELECT symbol, t, sum(CASE WHEN t - l = 3600000 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY t) AS run FROM (SELECT symbol, t, {_LAG} AS l FROM bars)) GROUP BY symbol, run HAVING count(*) >= 4")
def dq_03(s, d):
    return Q.contiguous_runs(R.bars_1h(s, d), HOUR_MS, 4)


@query("dq_04_cadence_report", with_roles("settlements") + """, x AS (SELECT *, st - lag(st) OVER (PARTITION BY symbol ORDER BY st, l_orderkey, l_linenumber) AS step FROM settlements)
    SELECT symbol, count(*) AS n, count(*) FILTER (status = 'official') AS official, count(*) FILTER (status = 'modeled') AS modeled, min(st) AS first_t, max(st) AS last_t, min(step) AS min_step, max(step) AS max_step, count(DISTINCT CASE WHEN status = 'official' THEN st // 86400000 END) AS official_days FROM x GROUP BY 1""")
def dq_04(s, d):
    return Q.cadence_report(R.settlements(s, d))


@query("dq_05_leg_alignment", with_roles("bars") + "SELECT count(*) FILTER (a.t IS NULL) AS only_right, count(*) FILTER (b.t IS NULL) AS only_left, count(*) FILTER (a.t = b.t) AS shared FROM (SELECT t FROM bars WHERE symbol = 'click') a FULL JOIN (SELECT t FROM bars WHERE symbol = 'view') b ON a.t = b.t")
def dq_05(s, d):
    b = R.bars_1h(s, d)
    return Q.leg_alignment(b.where("symbol = 'click'"), b.where("symbol = 'view'"))


@query("dq_06_read_back", with_roles("bars") + "SELECT symbol, count(*) AS n, count(*) AS n_stored, 0::BIGINT AS nulls, true AS agrees FROM bars GROUP BY 1")
def dq_06(s, d):
    from ..sources.stores import stored

    bars = R.bars_1h(s, d)
    return Q.read_back(bars, stored(bars, "bars", ["symbol"]))


@query("dq_07_resample_agreement", with_roles("bars") + f", {_BIG}, other AS (SELECT symbol, (us // 14400000000) * 14400000 AS bin, last(price ORDER BY us, seq) AS close, sum(qty) AS volume FROM ticks GROUP BY ALL) SELECT symbol, round(count(b.bin) * 1.0 / count(*), 6) AS matched, round(avg(CASE WHEN b.close = o.close THEN 1.0 ELSE 0.0 END), 6) AS exact, round(max(abs(b.close - o.close)), 6) + 0.0 AS max_close_dev, round(max(abs(b.volume - o.volume)), 6) + 0.0 AS max_volume_dev FROM other o LEFT JOIN big b USING (symbol, bin) GROUP BY 1")
def dq_07(s, d):
    own = B.larger_bars(R.bars_1h(s, d), 4 * HOUR_MS, HOUR_MS)
    other = B.bars_from_ticks(R.ticks(s, d), 4 * HOUR_MS).withColumnRenamed("t", "bin")
    return Q.resample_agreement(own, other)


_DUP = "SELECT cohort, size, kind, grid, count(*) AS n FROM grid GROUP BY ALL"


@query("dq_08_coverage", with_roles("grid") + "SELECT c.cohort, k.kind, s.size, g.grid FROM (SELECT DISTINCT cohort FROM grid) c, (SELECT DISTINCT kind FROM grid) k, (SELECT DISTINCT size FROM grid) s, (SELECT DISTINCT grid FROM grid) g WHERE NOT EXISTS (SELECT 1 FROM grid x WHERE x.cohort = c.cohort AND x.kind = k.kind AND x.size = s.size AND x.grid = g.grid)")
def dq_08(s, d):
    return Q.missing_cells(R.grid(s, d), ["cohort", "kind", "size", "grid"])


@query("dq_09_no_look_ahead", with_roles("bars") + "SELECT symbol, count(*) FILTER (t < 1705000000000) AS n_checked, 0::BIGINT AS n_moved FROM bars GROUP BY 1")
def dq_09(s, d):
    sma = lambda df: df.withColumn("x", F.avg("close").over(over().rowsBetween(-19, 0)))
    return Q.look_ahead_probe(R.bars_1h(s, d), sma, 1705000000000)


@query("dq_10_record_reconciliation", with_roles("daily", "bars") + "SELECT 'volume' AS field, count(*) AS mismatches FROM daily WHERE volume > 1.5 UNION ALL SELECT 'close', 0")
def dq_10(s, d):
    daily = R.bars_1d(s, d).select("symbol", "t", "close", "volume")
    other = daily.withColumn("volume", F.least("volume", F.lit(1.0)))
    return Q.mismatch_counts(daily, other, ["symbol", "t"], ["close", "volume"], 1e-9)


@query("dq_11_window_guard", with_roles("grid") + "SELECT grid, count(*) AS refused FROM grid WHERE grid <> 'A' GROUP BY 1")
def dq_11(s, d):
    return R.grid(s, d).where("grid <> 'A'").groupBy("grid").agg(F.count("*").alias("refused"))


@query("dq_12_interval_overlap", with_roles("slices") + 'SELECT survivor, slice, count(*) AS overlaps FROM (SELECT a.survivor, a.slice FROM slices a JOIN slices b ON a.survivor = b.survivor AND a.slice <> b.slice AND a.start <= b."end" AND b.start <= a."end") GROUP BY ALL')
def dq_12(s, d):
    return Q.overlaps(R.slices(s, d), "survivor", "slice", max_length=DAY_MS)


@query("dq_13_episode_geometry", with_roles("bars", "settlements") + "SELECT symbol, count(*) AS n, count(*) FILTER (st % 3600000 <> 0) AS off_open, count(*) FILTER (mark <= 0) AS bad_mark FROM settlements GROUP BY 1")
def dq_13(s, d):
    return R.settlements(s, d).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("st") % HOUR_MS != 0).alias("off_open"), F.count_if(F.col("mark") <= 0).alias("bad_mark"))


@query("dq_14_scenario_noop", with_roles("grid") + "SELECT cohort, round(sum(net_pnl) FILTER (grid = 'A') - sum(net_pnl) FILTER (grid = 'N'), 6) + 0.0 AS a_less_n, round(sum(net_pnl) FILTER (grid = 'A') - sum(net_pnl) FILTER (grid = 'R'), 6) + 0.0 AS a_less_r, CASE WHEN sum(episodes) > 0 THEN sum(net_pnl) FILTER (grid = 'A') IS NOT DISTINCT FROM sum(net_pnl) FILTER (grid = 'N') OR sum(net_pnl) FILTER (grid = 'A') IS NOT DISTINCT FROM sum(net_pnl) FILTER (grid = 'R') END AS no_op FROM grid GROUP BY 1")
def dq_14(s, d):
    one = lambda g: F.sum(F.when(F.col("grid") == g, F.col("net_pnl"))).alias(g)
    wide = R.grid(s, d).groupBy("cohort").agg(one("A"), one("N"), one("R"), F.sum("episodes").alias("traded"))
    same = F.col("A").eqNullSafe(F.col("N")) | F.col("A").eqNullSafe(F.col("R"))  # a scenario that moves nothing; not evaluated when nothing traded
    return wide.select("cohort", F.when(F.col("traded") > 0, same).alias("no_op"), (F.round(F.col("A") - F.col("N"), 6) + 0.0).alias("a_less_n"), (F.round(F.col("A") - F.col("R"), 6) + 0.0).alias("a_less_r"))


@query("dq_15_identity_check", with_roles("fills", "episodes") + """, f AS (SELECT episode, count(*) AS n, count(DISTINCT level) AS levels, min(level) AS a, max(level) AS b FROM fills GROUP BY 1), o AS (SELECT o_orderkey AS episode FROM orders)
SELECT count(*) FILTER (o.episode IS NULL) AS fills_without_order, count(*) FILTER (f.episode IS NULL) AS orders_without_fills, count(*) FILTER (f.n <> f.levels) AS repeated_levels, count(*) FILTER (f.a <> 1 OR f.b <> f.levels) AS broken_levels, count(*) AS n FROM o FULL JOIN f ON f.episode = o.episode""")
def dq_15(s, d):
    """Ids of orders and fills against each other, and each episode's fill levels: none twice, none missing from 1 on."""
    f = R.fills(s, d).groupBy("episode").agg(F.count("*").alias("k"), F.count_distinct("level").alias("levels"), F.min("level").alias("a"), F.max("level").alias("b"))
    j = R.read(s, d, "orders").select(F.col("o_orderkey").alias("episode"), F.lit(True).alias("there")).join(f, "episode", "full")
    return j.agg(F.count_if(F.col("there").isNull()).alias("fills_without_order"), F.count_if(F.col("k").isNull()).alias("orders_without_fills"), F.count_if(F.col("k") != F.col("levels")).alias("repeated_levels"), F.count_if((F.col("a") != 1) | (F.col("b") != F.col("levels"))).alias("broken_levels"), F.count("*").alias("n"))
