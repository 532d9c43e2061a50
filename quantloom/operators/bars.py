"""Bars, resampling and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import date_of, day_of, month_ordinal, over, past, quarter_ordinal


def bars_from_ticks(ticks: DataFrame, step_ms: int, *, key: str = "symbol", us: str = "us", seq: str = "seq", price: str = "price", qty: str = "qty") -> DataFrame:
    """First, highest, lowest, last price and summed quantity of each step; one shuffle, combined before it."""
    by = F.struct(us, seq, price)
    return ticks.groupBy(key, (F.floor(F.col(us) / (step_ms * 1000)) * step_ms).cast("long").alias("t")).agg(
        F.min(by)[price].alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(by)[price].alias("close"), F.sum(qty).alias("volume")
    )


def larger_bars(bars: DataFrame, step_ms: int, base_ms: int, *, key: str = "symbol", full_only: bool = False) -> DataFrame:
    """Bars of a larger step with the number of base bars and the time from which they may be used."""
    out = bars.groupBy(key, (F.floor(F.col("t") / step_ms) * step_ms).cast("long").alias("bin")).agg(
        F.min(F.struct("t", "open"))["open"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max(F.struct("t", "close"))["close"].alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("n"),
    )
    out = out.withColumn("available_at", F.col("bin") + step_ms)
    return out.where(F.col("n") == step_ms // base_ms) if full_only else out


def day_marks(bars: DataFrame, *, key: str = "symbol") -> DataFrame:
    """Adds day and is_day_end, true on the last bar of the UTC day."""
    last = F.row_number().over(Window.partitionBy(key, day_of(F.col("t"))).orderBy(F.col("t").desc()))
    return bars.withColumns({"day": day_of(F.col("t")), "is_day_end": last == 1})


def slot_profile(bars: DataFrame, slot_ms: int, days: int, *, key: str = "symbol") -> DataFrame:
    """Mean volume of each slot over the ``days`` days strictly before, on a dense (day, slot) frame from the first to the last day."""
    slots = 86_400_000 // slot_ms
    got = bars.groupBy(key, day_of(F.col("t")).alias("day"), (F.floor(F.col("t") / slot_ms) % slots).cast("long").alias("slot")).agg(F.sum("volume").alias("volume"))
    span = got.groupBy(key).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    dense = span.select(key, F.explode(F.sequence("a", "b")).alias("day")).select(key, "day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"))
    full = dense.join(got, [key, "day", "slot"], "left").fillna(0.0, ["volume"])
    w = Window.partitionBy(key, "slot").orderBy("day").rangeBetween(-days, -1)
    return full.withColumn("profile", F.when(F.count("*").over(w) == days, F.avg("volume").over(w)))


def peak_slot(profile: DataFrame, *, key: str = "symbol") -> DataFrame:
    """The slot with the largest profile of each day; ties go to the smallest slot."""
    return profile.where("profile is not null").groupBy(key, "day").agg(F.min(F.struct((-F.col("profile")).alias("p"), "slot"))["slot"].alias("peak_slot"))


def month_end_rows(bars: DataFrame, *, key: str = "symbol") -> DataFrame:
    """The last bar of each UTC month with its month ordinal."""
    return bars.groupBy(key, month_ordinal(F.col("t")).alias("month")).agg(F.max(F.struct("t", "close")).alias("x")).select(key, "month", "x.t", "x.close")


def quarter_panel(daily: DataFrame, *, key: str = "symbol", touch: float = -0.5) -> DataFrame:
    """Per key and quarter: days, realised volatility, log mean dollar volume, return, peak of 365 days, drawdown at the end, touched flag, first onset."""
    w = over(key)
    year = Window.partitionBy(key).orderBy(day_of(F.col("t"))).rangeBetween(-364, 0)
    rows = daily.withColumns({"r": F.log(F.col("close") / F.lag("close").over(w)), "peak": F.max("close").over(year), "quarter": quarter_ordinal(F.col("t"))})
    rows = rows.withColumn("dd", F.col("close") / F.col("peak") - 1)
    got = rows.groupBy(key, "quarter").agg(
        F.count("*").alias("days"), F.stddev_samp("r").alias("vol"), F.log(F.avg(F.col("close") * F.col("volume"))).alias("log_dollar"),
        F.max(F.struct("t", "close"))["close"].alias("last"), F.min(F.struct("t", "close"))["close"].alias("first"), F.max(F.struct("t", "dd"))["dd"].alias("dd_end"), F.min("dd").alias("dd_min"),
    )
    touched = F.col("dd_min") <= touch
    earlier = F.max(touched.cast("int")).over(Window.partitionBy(key).orderBy("quarter").rowsBetween(Window.unboundedPreceding, -1))
    return got.withColumns({"ret": F.col("last") / F.col("first") - 1, "touched": touched, "onset": touched & (F.coalesce(earlier, F.lit(0)) == 0)})


def clock_windows(bars: DataFrame, hour: int, length_h: int, *, key: str = "symbol", weekday: int | None = None) -> DataFrame:
    """Episodes from ``hour`` UTC lasting ``length_h`` hours on each day (of one ISO weekday): entry and exit opens where both bars exist."""
    opens = bars.select(key, "t", "open")
    entry = opens.where((F.floor(F.col("t") / 3_600_000) % 24) == hour)
    if weekday is not None:
        entry = entry.where(F.weekday(date_of(F.col("t"))) + 1 == weekday)
    exits = opens.select(F.col(key), (F.col("t") - length_h * 3_600_000).alias("t"), F.col("open").alias("exit"))
    return entry.join(exits, [key, "t"], "left").select(key, "t", F.col("open").alias("entry"), "exit", F.col("exit").isNull().alias("cut"))


def cycles(bars: DataFrame, formation: int, trading: int, step_ms: int, *, key: str = "symbol") -> DataFrame:
    """Bars joined to the cycles that hold them: formation then trading steps, rolled by trading steps from the first bar of all.

    The cycle numbers of a bar follow from its own place, so no join is needed.
    """
    from pyspark.sql import Window as W

    n = F.col("n")
    last = F.floor(n / trading)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((n - formation - trading + 1) / trading))
    rows = bars.withColumn("n", F.floor((F.col("t") - F.min("t").over(W.partitionBy(key))) / step_ms)).withColumn("cycle", F.explode(F.sequence(first, last)))
    return rows.withColumn("part", F.when(F.col("n") - F.col("cycle") * trading < formation, "formation").otherwise("trading"))


def folds(first_month: Column, last_month: Column, train: int, test: int, step: int) -> Column:
    """Array of (fold, train_from, test_from, test_to) in month ordinals; partial tails are left out."""
    starts = F.sequence(first_month, last_month - train - test + 1, F.lit(step).cast("long"))
    ok = last_month - first_month + 1 >= train + test
    return F.when(ok, F.transform(starts, lambda s, i: F.struct(i.cast("long").alias("fold"), s.alias("train_from"), (s + train).alias("test_from"), (s + train + test).alias("test_to")))).otherwise(F.array())


def week_marks(bars: DataFrame, *, key: str = "symbol") -> DataFrame:
    """True on the first row of each ISO week."""
    week = F.floor((day_of(F.col("t")) + 3) / 7)
    return bars.withColumn("rebalance", ~F.coalesce(F.lag(week).over(over(key)) == week, F.lit(False)))


def joint_panel(daily: DataFrame, max_age_days: int, *, key: str = "symbol") -> DataFrame:
    """All keys on the union of dates, closes carried at most some days; dates where a key is still missing are dropped, carried rows flagged."""
    keys, dates = daily.select(key).distinct(), daily.select("t").distinct()
    full = dates.crossJoin(F.broadcast(keys)).join(daily.select(key, "t", "close"), [key, "t"], "left")
    known = F.last(F.when(F.col("close").isNotNull(), F.struct("t", "close")), ignorenulls=True).over(past(key))
    full = full.withColumn("k", known).withColumn("filled", F.when(F.col("t") - F.col("k.t") <= max_age_days * 86_400_000, F.col("k.close")))
    whole = F.count("filled").over(Window.partitionBy("t")) == F.count("*").over(Window.partitionBy("t"))
    return full.withColumn("ok", whole).where("ok").select(key, "t", F.col("filled").alias("close"), F.col("close").isNull().alias("carried"))


def every_kth(bars: DataFrame, k: int, warm_up: int, *, key: str = "symbol") -> DataFrame:
    """Rebalance rows: every k-th row after the warm-up; the last row of a key, which can't be executed, is left out."""
    n = F.row_number().over(over(key))
    marked = bars.withColumns({"n": n, "next": F.lead("t").over(over(key))})
    return marked.where((F.col("n") > warm_up) & ((F.col("n") - warm_up - 1) % k == 0) & F.col("next").isNotNull()).drop("next")


def month_bounds(bars: DataFrame, *, key: str = "symbol") -> DataFrame:
    w = Window.partitionBy(key, month_ordinal(F.col("t")))
    return bars.withColumns({"month_first": F.min("t").over(w), "month_last": F.max("t").over(w)})
