"""Column helpers: frames, guarded rolling aggregates, rounding for comparison, scalar functions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(key="symbol", time="t") -> WindowSpec:
    """Rows of a key in the order of time; ``key`` and ``time`` may be lists."""
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*([time] if isinstance(time, str) else time))


def frame(first: int, last: int, key="symbol", time="t") -> WindowSpec:
    return over(key, time).rowsBetween(first, last)


def past(key="symbol", time="t") -> WindowSpec:
    return over(key, time).rowsBetween(Window.unboundedPreceding, 0)


def before(key="symbol", time="t") -> WindowSpec:
    return over(key, time).rowsBetween(Window.unboundedPreceding, -1)


def rolling(column: Column, width: int, agg: Callable[[Column], Column], *, key="symbol", time="t", min_count: int | None = None, shift: int = 0) -> Column:
    """An aggregate over the last ``width`` rows (ending ``shift`` rows back); null until ``min_count`` values are there (default: all)."""
    w = frame(-width + 1 - shift, -shift, key, time)
    return F.when(F.count(column).over(w) >= (width if min_count is None else min_count), agg(column).over(w))


def same_time(time: str = "t") -> WindowSpec:
    """All rows of one time."""
    return Window.partitionBy(time)


def tidy(df: DataFrame, *keys: str, **values: Column) -> DataFrame:
    """Keys, and doubles rounded to six places (without negative zero)."""
    return df.select(*keys, *[(F.round(v.cast("double"), 6) + F.lit(0.0)).alias(n) for n, v in values.items()])


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def ln(x: Column) -> Column:
    """The logarithm of the C library; null where x isn't positive.

    Spark's own is at times off by the last bit, and that bit decides the sign of a sum of logarithms that should be zero. Python
    is called for each row, so this is for rows of bars whose signs are asked for.
    """
    c_log = F.udf(lambda v: math.log(v) if v is not None and v > 0 else None, "double")
    return F.when(x.isNotNull() & ~F.isnan(x), c_log(x.cast("double"))).otherwise(F.log(x))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def sigmoid(x: Column) -> Column:
    """Stable for large arguments of either sign."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def fill_price(price: Column, side: Column, *, ticks: float = 0.0, tick_size: float = 0.01, bps: float = 0.0) -> Column:
    """What a fill costs: price moved against the side by ticks or basis points; side is 1 to buy, -1 to sell."""
    return price + side * (ticks * tick_size) + side * price * (bps / 10_000)


def day_of(t: Column) -> Column:
    return F.floor(t / 86_400_000).cast("long")


def date_of(t: Column) -> Column:
    return F.date_from_unix_date(day_of(t).cast("int"))


def month_ordinal(t: Column) -> Column:
    return (F.year(date_of(t)) * 12 + F.month(date_of(t)) - 1).cast("long")


def quarter_ordinal(t: Column) -> Column:
    return (F.year(date_of(t)) * 4 + F.quarter(date_of(t)) - 1).cast("long")


def days_inclusive(first: Column, last: Column) -> Column:
    return day_of(last) - day_of(first) + 1
