"""Positions, episodes and portfolio returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import over
from .jumps import chain, first_at_or_after, held_through, numbered
from .orderstats import saved

C = F.col


def no_trade_band(targets: DataFrame, target: str, band: float, *, key: str = "symbol", start: float = 0.0) -> DataFrame:
    """(key, t, held): the held weight moves to the target only when they are more than ``band`` apart.

    The next move after a move to w is the first later target outside w - band to w + band, so the moves are a chain of jumps.
    A null target keeps the weight; targets of the same time are taken in the order of their values.
    """
    return held_through(targets.select(key, "t", target), target, band, start, "held", key=key, order=["t", target]).select(key, "t", "held")


def time_exit_episodes(bars: DataFrame, entries: DataFrame, hold: int, *, key: str = "symbol") -> DataFrame:
    """Entry at the next bar's open after an event, exit at the open ``hold`` bars later; side-signed return, best and worst price inside.

    Everything an episode needs lies within hold + 1 rows of its event, so it is read through frames of the same sort.
    """
    w, inside = over(key), over(key).rowsBetween(1, hold)
    marked = bars.join(entries.select(key, "t", "side"), [key, "t"], "left")
    out = marked.withColumns({
        "entry_t": F.lead("t").over(w), "entry": F.lead("open").over(w), "exit_t": F.lead("t", hold + 1).over(w), "exit": F.lead("open", hold + 1).over(w),
        "best": F.when(C("side") > 0, F.max("high").over(inside)).otherwise(F.min("low").over(inside)), "worst": F.when(C("side") > 0, F.min("low").over(inside)).otherwise(F.max("high").over(inside)),
    }).where(C("side").isNotNull() & C("exit").isNotNull())
    return out.select(
        key, "t", "side", "entry_t", "exit_t", "entry", "exit", (C("side") * (C("exit") / C("entry") - 1)).alias("gross"),
        (C("side") * (C("best") / C("entry") - 1)).alias("mfe"), (C("side") * (C("worst") / C("entry") - 1)).alias("mae"),
    )


def stressed_episodes(bars: DataFrame, entries: DataFrame, hold: int, scenarios: dict[str, tuple[int, float]], *, tick_size: float = 0.01, key: str = "symbol") -> DataFrame:
    """Episodes of ``hold`` bars under execution scenarios {name: (bars of delay, ticks of slippage)}: entry and exit both come later by the delay, and
    every fill is moved against its side by the ticks. An episode whose late exit is past the last bar has no row in that scenario.

    All scenarios are read from one sort of the bars, as an event's fills lie within hold + delay + 1 rows of it.
    """
    w = over(key)
    marked = bars.join(entries.select(key, "t", "side"), [key, "t"], "left")
    at = lambda c, k: F.lead(c, k).over(w)
    fills = {d: F.struct(at("t", 1 + d).alias("entry_t"), at("open", 1 + d).alias("entry"), at("t", 1 + d + hold).alias("exit_t"), at("open", 1 + d + hold).alias("exit")) for d in sorted({d for d, _ in scenarios.values()})}
    marked = marked.withColumns({f"_f{d}": f for d, f in fills.items()}).where("side is not null")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(ticks)).alias("ticks"), C(f"_f{d}").alias("f")) for n, (d, ticks) in scenarios.items()]))
    x = marked.select(key, "t", "side", each.alias("_s")).select(key, "t", "side", "_s.scenario", "_s.ticks", "_s.f.*").where("exit is not null")
    paid, got = [price + sign * C("side") * C("ticks") * tick_size for price, sign in ((C("entry"), 1), (C("exit"), -1))]
    return x.select(key, "t", "side", "scenario", "entry_t", "exit_t", paid.alias("entry"), got.alias("exit"), (C("side") * (got / paid - 1)).alias("gross"))


def non_overlapping(episodes: DataFrame, *, key: str = "symbol", exit_at_open: str | None = None) -> DataFrame:
    """Drops entries made before the open episode ends; an entry at the very time of the exit counts.

    Where a boolean column ``exit_at_open`` is named, an entry at the time of the exit only counts if that exit was made at the open, as
    after a flip of the sign on one bar. Of equal rows one stays, unless they end where they begin. An episode without exit bars all later ones;
    rows without entry_t are dropped.
    """
    x = numbered(episodes.where("entry_t is not null"), ["entry_t", "exit_t"], key=key)
    equal = F.lit(True) if exit_at_open is None else F.coalesce(C(exit_at_open), F.lit(False))
    x = saved(first_at_or_after(x, "entry_t", "exit_t", equal, key=key))
    return x.join(chain(x, key=key), [key, "_i"], "left_semi").select(*episodes.columns)


def reprice(ledger: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each ledger row under each cost scenario: fees and funding times factors, less flat basis points of the amount."""
    net = C("gross") - C("fees") * C("fee_x") - C("funding") * C("funding_x") - C("amount") * C("bps") / 10_000
    return ledger.crossJoin(F.broadcast(scenarios)).withColumn("net", net)


def portfolio_returns(weights: DataFrame, cost: float, *, key: str = "symbol") -> DataFrame:
    """(t, gross, turnover, net) from rows (key, t, w, r): the weight of the row before earns the row's return."""
    held = F.coalesce(F.lag("w").over(over(key)), F.lit(0.0))
    rows = weights.withColumns({"_h": held, "_d": F.abs(C("w") - held)})
    got = rows.groupBy("t").agg(F.sum(C("_h") * C("r")).alias("gross"), F.sum("_d").alias("turnover"))
    return got.withColumn("net", C("gross") - cost * C("turnover"))


def drift_weights(returns: DataFrame, *, key: str = "symbol") -> DataFrame:
    """Buy-and-hold weights from equal starts; growth by summed log returns, normalised by time."""
    grown = F.exp(F.sum(F.log1p("r")).over(over(key)))
    x = returns.withColumn("_g", grown)
    return x.withColumn("w", C("_g") / F.sum("_g").over(Window.partitionBy("t"))).drop("_g")


def rule_weights(rows: DataFrame, w: int, *, key: str = "symbol") -> DataFrame:
    """Equal, inverse-volatility and sign-of-mean weights by time from returns r."""
    f, at = over(key).rowsBetween(-w + 1, 0), Window.partitionBy("t")
    x = rows.withColumns({"_v": F.when(F.count("r").over(f) == w, 1 / F.nullif(F.stddev_samp("r").over(f), F.lit(0.0))), "_m": F.signum(F.round(F.avg("r").over(f), 12))})
    n = F.count("*").over(at)
    return x.withColumns({"equal": 1 / n, "inverse_vol": C("_v") / F.sum("_v").over(at), "momentum": C("_m") / n}).drop("_v", "_m")


def legs(rows: DataFrame, score: str, k: int, *, key: str = "symbol") -> DataFrame:
    """side 1 for the top and -1 for the bottom max(1, min(k, n / 2)) names of each time by score, ties by key."""
    at = Window.partitionBy("t")
    n = F.count("*").over(at)
    take = F.greatest(F.lit(1), F.least(F.lit(k), F.floor(n / 2)))
    x = rows.withColumns({"_top": F.row_number().over(at.orderBy(C(score).desc(), key)), "_low": F.row_number().over(at.orderBy(C(score), key)), "_k": take})
    return x.withColumn("side", F.when(C("_top") <= C("_k"), 1).when(C("_low") <= C("_k"), -1).otherwise(0)).drop("_top", "_low", "_k")


def reselect(returns: DataFrame, train: int, test: int, *, key: str = "symbol") -> DataFrame:
    """(key, step, rule, sharpe, train_pnl, test_pnl): for each step the rule with the best training days, and what it made on the days after them.

    returns (key, day, rule, r) has one row for each rule and day; step k trains on days k * test to k * test + train from the key's first day (train is a multiple of test), and is tested on the next
    ``test`` days. Rules are ranked by Sharpe (mean over deviation, nine places; none where there is no deviation, which is last), then sum (nine places), then the smaller rule. Steps without test days are left out.
    """
    spans = train // test
    first = returns.groupBy(key).agg(F.min("day").alias("_first"))
    x = returns.where("r is not null").join(first, key).withColumn("_at", F.floor((F.col("day") - F.col("_first")) / test))
    low = F.greatest(F.col("_at") - spans, F.lit(0))
    x = x.select(key, "rule", "r", "_at", F.explode(F.sequence(low, "_at")).alias("step"))
    tested = F.col("_at") == F.col("step") + spans
    g = x.groupBy(key, "step", "rule").agg(
        F.avg(F.when(~tested, F.col("r"))).alias("_m"), F.stddev_samp(F.when(~tested, F.col("r"))).alias("_s"), F.sum(F.when(~tested, F.col("r"))).alias("train_pnl"), F.sum(F.when(tested, F.col("r"))).alias("test_pnl"))
    g = g.where("train_pnl is not null").withColumn("sharpe", F.when(F.col("_s") > 1e-12, F.round(F.col("_m") / F.col("_s"), 9)))
    order = F.struct(F.coalesce(-F.col("sharpe"), F.lit(1e18)).alias("a"), (-F.round("train_pnl", 9)).alias("b"), F.col("rule").alias("c"))
    best = g.groupBy(key, "step").agg(F.min(F.struct(order.alias("o"), F.struct("rule", "sharpe", "train_pnl", "test_pnl").alias("x"))).alias("x"))
    return best.select(key, "step", "x.x.*").where("test_pnl is not null")
