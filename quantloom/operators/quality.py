"""Data-quality and coverage reports; all are frames of counts, none collects rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import day_of, over


def gap_report(bars: DataFrame, step_ms: int, *, key: str = "symbol") -> DataFrame:
    step = F.col("t") - F.lag("t").over(over(key))
    rows = bars.withColumn("step", step)
    return rows.groupBy(key).agg(
        F.count("*").alias("n"), F.count_if(F.col("step") != step_ms).alias("gaps"),
        F.coalesce(F.sum(F.when(F.col("step") > step_ms, F.floor(F.col("step") / step_ms) - 1)), F.lit(0)).cast("long").alias("missing"),
        F.count_if(F.col("step") % step_ms != 0).alias("off_grid"), F.count_if(F.col("volume") == 0).alias("zero_volume"),
        (F.floor((F.max("t") - F.min("t")) / step_ms) + 1).cast("long").alias("expected"),
    )


def first_gaps(bars: DataFrame, step_ms: int, n: int, *, key: str = "symbol") -> DataFrame:
    gaps = bars.withColumn("step", F.col("t") - F.lag("t").over(over(key))).where(F.col("step") > step_ms)
    ranked = gaps.withColumn("n", F.row_number().over(over(key)).cast("long"))
    return ranked.where(F.col("n") <= n).select(key, "n", "t", (F.floor(F.col("step") / step_ms) - 1).cast("long").alias("missing"))


def complete_days(bars: DataFrame, step_ms: int, *, key: str = "symbol") -> DataFrame:
    rows = bars.withColumn("day", day_of(F.col("t")))
    rows = rows.withColumn("step", F.col("t") - F.lag("t").over(over([key, "day"])))
    got = rows.groupBy(key, "day").agg(F.count("*").alias("n"), F.count_if(F.col("step") != step_ms).alias("bad"))
    return got.select(key, "day", "n", ((F.col("n") == 86_400_000 // step_ms) & (F.col("bad") == 0)).alias("complete"))


def contiguous_runs(bars: DataFrame, step_ms: int, min_bars: int, *, key: str = "symbol") -> DataFrame:
    fresh = F.when(F.col("t") - F.lag("t").over(over(key)) == step_ms, 0).otherwise(1)
    rows = bars.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(over(key)))
    got = rows.groupBy(key, "run").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))
    return got.where(F.col("n") >= min_bars).drop("run")


def cadence_report(rows: DataFrame, *, key: str = "symbol") -> DataFrame:
    """Counts, range, smallest and largest step between neighbouring times, days with official rows.

    Rows are counted by time first (one that comes twice has a step of 0), then steps are taken within days of a key, and
    between the last and first times of neighbouring days: no task sorts a whole key.
    """
    st, n = F.col("st"), F.col("n")
    at = rows.groupBy(key, "st").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "official").alias("official"), F.count_if(F.col("status") == "modeled").alias("modeled"))
    at = at.withColumn("day", day_of(st)).withColumns({"step": st - F.lag("st").over(over([key, "day"], "st")), "again": F.when(st.isNotNull() & (n > 1), 0)})
    days = at.groupBy(key, "day").agg(
        F.sum("n").alias("n"), F.sum("official").alias("official"), F.sum("modeled").alias("modeled"), F.min("st").alias("first_t"), F.max("st").alias("last_t"),
        F.min(F.least("step", "again")).alias("low"), F.max(F.greatest("step", "again")).alias("high"),
    )
    days = days.withColumn("gap", F.col("first_t") - F.lag("last_t").over(over(key, "day")))  # one row a day
    return days.groupBy(key).agg(
        F.sum("n").alias("n"), F.sum("official").alias("official"), F.sum("modeled").alias("modeled"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"),
        F.min(F.least("low", "gap")).alias("min_step"), F.max(F.greatest("high", "gap")).alias("max_step"), F.count_if(F.col("day").isNotNull() & (F.col("official") > 0)).alias("official_days"),
    )


def leg_alignment(left: DataFrame, right: DataFrame, time: str = "t") -> DataFrame:
    a, b = left.select(F.col(time).alias("a")), right.select(F.col(time).alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full").agg(F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a") == F.col("b")).alias("shared"))


def read_back(source: DataFrame, store: DataFrame, *, key: str = "symbol", value: str = "close") -> DataFrame:
    """Counts, nulls and first and last values of a source and its store, compared by key."""
    def about(df):
        by = F.struct("t", value)
        return df.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(value).isNull()).alias("nulls"), F.min(by).alias("a"), F.max(by).alias("b"))

    a, b = about(source), about(store).withColumnsRenamed({"n": "n_stored", "nulls": "nulls2", "a": "a2", "b": "b2"})
    agrees = (F.col("n") == F.col("n_stored")) & F.col("a").eqNullSafe(F.col("a2")) & F.col("b").eqNullSafe(F.col("b2"))
    return a.join(b, key, "full").select(key, "n", "n_stored", F.col("nulls2").alias("nulls"), F.coalesce(agrees, F.lit(False)).alias("agrees"))


def resample_agreement(own: DataFrame, other: DataFrame, *, key: str = "symbol") -> DataFrame:
    a = own.select(key, "bin", F.col("close").alias("c"), F.col("volume").alias("v"))
    r = lambda c: F.round(c, 6) + 0.0
    return other.join(a, [key, "bin"], "left").groupBy(key).agg(
        r(F.count("c") / F.count("*")).alias("matched"), r(F.avg(F.when(F.col("c") == F.col("close"), 1.0).otherwise(0.0))).alias("exact"),
        r(F.max(F.abs(F.col("c") - F.col("close")))).alias("max_close_dev"), r(F.max(F.abs(F.col("v") - F.col("volume")))).alias("max_volume_dev"),
    )


def missing_cells(cells: DataFrame, axes: list[str]) -> DataFrame:
    """Cells of the registered product that have no row; the axis tables are small, their product is the registered size."""
    product = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [cells.select(a).distinct() for a in axes])
    return product.join(cells.select(*axes).distinct(), axes, "left_anti")


def look_ahead_probe(rows: DataFrame, transform: Callable[[DataFrame], DataFrame], cut: int, *, key: str = "symbol", value: str = "x") -> DataFrame:
    """How many rows before ``cut`` change when the rows from ``cut`` on are taken away."""
    whole = transform(rows).where(F.col("t") < cut).select(key, "t", F.col(value).alias("a"))
    part = transform(rows.where(F.col("t") < cut)).select(key, "t", F.col(value).alias("b"))
    moved = F.count_if(~F.col("a").eqNullSafe(F.col("b")))
    return whole.join(part, [key, "t"], "full").groupBy(key).agg(F.count("*").alias("n_checked"), moved.alias("n_moved"))


def mismatch_counts(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], tol: float) -> DataFrame:
    """By field, the records on which two sets differ by more than ``tol`` of their size, or that one lacks."""
    b = right.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = left.join(b, keys, "full")
    ok = lambda f: F.col(f).eqNullSafe(F.col(f"_{f}")) | F.coalesce(F.abs(F.col(f) - F.col(f"_{f}")) <= tol * F.greatest(F.lit(1.0), F.abs(F.col(f"_{f}"))), F.lit(False))
    counts = joined.agg(*[F.count_if(~ok(f)).alias(f) for f in fields])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("mismatches")) for f in fields])).alias("x")).select("x.*")


def overlaps(slices: DataFrame, owner: str, name: str, *, max_length: int) -> DataFrame:
    """How many other slices of its owner each slice overlaps, ends included.

    Slices are put into time bins as long as the longest slice, so each meets only those in its own and the next bins.
    """
    a = slices.select(owner, name, "start", "end")
    bins = a.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / max_length), F.floor(F.col("end") / max_length))))
    b = bins.select(F.col(owner).alias("_o"), F.col(name).alias("_other"), F.col("start").alias("_s2"), F.col("end").alias("_e2"), F.col("bin").alias("_bin2"))
    meet = (F.col(owner) == F.col("_o")) & (F.col("bin") == F.col("_bin2")) & (F.col(name) != F.col("_other")) & (F.col("start") <= F.col("_e2")) & (F.col("_s2") <= F.col("end"))
    return bins.join(b, meet).select(owner, name, "_other").distinct().groupBy(owner, name).agg(F.count("*").alias("overlaps"))


def hold_geometry(settled: str, entered: str, left: str, *, bar: int, tolerance: int, hold: int, boundary: int) -> dict:
    """Conditions that an episode breaks: its settlement lies more than ``tolerance`` after its bar's open, it is left before its entry or after ``hold``, it isn't entered on a boundary."""
    return {
        "late_settlements": F.pmod(F.col(settled), F.lit(bar)) > tolerance, "outside_hold": ~F.col(left).between(F.col(entered), F.col(entered) + hold), "off_boundary": F.pmod(F.col(entered), F.lit(boundary)) != 0,
    }
