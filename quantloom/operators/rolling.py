"""Window features: levels, returns, moments. Each takes bars (symbol, t, open, high, low, close, volume) and adds columns.

Keys with long histories: all frames here are bounded or running, so a key's rows are sorted once and streamed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import before, frame, over, past, rolling, safe_div

C = F.col


def returns(rows: DataFrame, k: int = 1, *, value: str = "close", key="symbol") -> DataFrame:
    lagged = F.lag(value, k).over(over(key))
    return rows.withColumns({"log_ret": F.log(C(value) / F.lag(value).over(over(key))), "ret_k": C(value) / lagged - 1})


def with_log_return(rows: DataFrame, key="symbol") -> DataFrame:
    return rows.withColumn("r", F.log(C("close") / F.lag("close").over(over(key))))


def sma(column: Column, w: int, key="symbol") -> Column:
    return rolling(column, w, F.avg, key=key)


def skewness(column: Column, w: int, key="symbol") -> Column:
    """Population skewness from power sums; the standard deviation is floored at 1e-12."""
    f = frame(-w + 1, 0, key)
    m = F.avg(column).over(f)
    var = F.greatest(F.avg(column**2).over(f) - m * m, F.lit(0.0))
    third = F.avg(column**3).over(f) - 3 * m * F.avg(column**2).over(f) + 2 * m**3
    return F.when(F.count(column).over(f) == w, third / F.greatest(F.sqrt(var), F.lit(1e-12)) ** 3)


def excess_kurtosis(column: Column, w: int, key="symbol") -> Column:
    f = frame(-w + 1, 0, key)
    m, m2, m3, m4 = (F.avg(column**k).over(f) for k in (1, 2, 3, 4))
    var = F.greatest(m2 - m * m, F.lit(0.0))
    fourth = m4 - 4 * m * m3 + 6 * m * m * m2 - 3 * m**4
    return F.when(F.count(column).over(f) == w, fourth / F.greatest(F.sqrt(var), F.lit(1e-12)) ** 4 - 3)


def rolling_corr(a: Column, b: Column, w: int, key="symbol") -> Column:
    """Correlation over the rows of the frame where both are there; null below max(4, w/2) of them or without variance."""
    f, both = frame(-w + 1, 0, key), a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    n = F.count(x).over(f)
    cov = F.avg(x * y).over(f) - F.avg(x).over(f) * F.avg(y).over(f)
    sd = F.stddev_pop(x).over(f) * F.stddev_pop(y).over(f)
    return F.when((n >= max(4, w // 2)) & (sd > 1e-12), cov / sd)


def trailing_beta(y: Column, x: Column, w: int, min_count: int, key="symbol") -> Column:
    """Slope of y on x over the w rows strictly before each row."""
    f, both = frame(-w, -1, key), x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    var = F.avg(x * x).over(f) - F.avg(x).over(f) ** 2
    cov = F.avg(x * y).over(f) - F.avg(x).over(f) * F.avg(y).over(f)
    return F.when((F.count(x).over(f) >= min_count) & (var > 1e-14), cov / var)


def expanding_z(column: Column, min_count: int, key="symbol", *, strict: bool = False) -> Column:
    """Against the history with the row (ddof 1), or strictly before it (population)."""
    f = before(key) if strict else past(key)
    sd = (F.stddev_pop if strict else F.stddev_samp)(column).over(f)
    return F.when((F.count(column).over(f) >= min_count) & (sd > 0), (column - F.avg(column).over(f)) / sd)


def trailing_z(column: Column, w: int, key="symbol") -> Column:
    f = frame(-w + 1, 0, key)
    sd = F.stddev_pop(column).over(f)
    return F.when((F.count(column).over(f) == w) & (sd > 0), (column - F.avg(column).over(f)) / sd)


def mid_rank_in_range(column: Column, length_ms: int, key="symbol") -> Column:
    """(below + equal / 2) / n within [t - length, t], where the history covers the range."""
    f = Window.partitionBy(key).orderBy("t").rangeBetween(-length_ms, 0)
    values = F.collect_list(column).over(f)
    covered = F.min("t").over(Window.partitionBy(key)) <= C("t") - length_ms
    below, equal = F.size(F.filter(values, lambda v: v < column)), F.size(F.filter(values, lambda v: v == column))
    return F.when(covered, (below + 0.5 * equal) / F.size(values))


def rank_in_rows(column: Column, w: int, key="symbol") -> Column:
    """Share of the last w values that are at most the row's own."""
    f = frame(-w + 1, 0, key)
    values = F.collect_list(column).over(f)
    return F.when(F.count(column).over(f) == w, F.size(F.filter(values, lambda v: v <= column)) / F.lit(float(w)))


def rolling_quantile(column: Column, w: int, q: float, key="symbol", *, shift: int = 0) -> Column:
    f = frame(-w + 1 - shift, -shift, key)
    return F.when(F.count(column).over(f) == w, F.percentile(column, q).over(f))


def drawdown(column: Column, key="symbol") -> Column:
    return column / F.max(column).over(past(key)) - 1


def forward_sum(column: Column, h: int, key="symbol") -> Column:
    f = frame(1, h, key)
    return F.when(F.count(column).over(f) == h, F.sum(column).over(f))


def forward_path(h: int, key="symbol", value: str = "close") -> tuple[Column, Column]:
    """Endpoint return and deepest fall from the running peak over the next h rows (both null near the end)."""
    f = frame(0, h, key)
    path = F.collect_list(value).over(f)
    fall = F.aggregate(path, F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd")),
                       lambda s, v: F.struct(F.greatest(s["peak"], v).alias("peak"), F.least(s["dd"], v / F.greatest(s["peak"], v) - 1).alias("dd")), lambda s: s["dd"])
    whole = F.count(value).over(f) == h + 1
    return F.when(whole, F.lead(value, h).over(over(key)) / C(value) - 1), F.when(whole, fall)


def realised(rows: DataFrame, key="symbol") -> DataFrame:
    """Per day: variance, quarticity, bipower variation and signed jump from the returns inside the day."""
    from ..functions.expr import day_of

    day = rows.withColumn("day", day_of(C("t")))
    day = day.withColumn("r", F.log(C("close") / F.lag("close").over(over([key, "day"]))))
    day = day.withColumn("pair", F.abs(C("r")) * F.abs(F.lag("r").over(over([key, "day"]))))
    got = day.groupBy(key, "day").agg(F.sum(C("r") ** 2).alias("rv"), (F.count("r") / 3 * F.sum(C("r") ** 4)).alias("rq"), (math.pi / 2 * F.sum("pair")).alias("bpv"), F.sum("r").alias("day_ret"))
    return got.withColumn("jump", F.greatest(C("rv") - C("bpv"), F.lit(0.0)) * F.signum("day_ret"))


def har_features(days: DataFrame, key="symbol") -> DataFrame:
    """log variance, its means over 5 and 22 days and the quarticity term; null unless all 22 are positive."""
    w = lambda n: frame(-n + 1, 0, key, "day")
    ok = (F.count("rv").over(w(22)) == 22) & (F.min("rv").over(w(22)) > 0)
    return days.withColumns({
        "log_rv": F.when(ok, F.log("rv")), "rv5": F.when(ok, F.avg("rv").over(w(5))), "rv22": F.when(ok, F.avg("rv").over(w(22))),
        "rq_term": F.when(ok, F.sqrt("rq") * C("rv")),
    })


def range_estimators(rows: DataFrame, w: int, key="symbol") -> DataFrame:
    """Parkinson, Garman-Klass, Roll and Corwin-Schultz over the last w rows, and high-low range over mid."""
    hl, co = F.log(C("high") / C("low")), F.log(C("close") / C("open"))
    d = C("close") - F.lag("close").over(over(key))
    rows = rows.withColumns({"_hl2": hl**2, "_gk": 0.5 * hl**2 - (2 * math.log(2) - 1) * co**2, "_d": d})
    rows = rows.withColumn("_d1", F.lag("_d").over(over(key)))
    f = frame(-w + 1, 0, key)
    full = F.count("_d1").over(f) == w
    cov = F.avg(C("_d") * C("_d1")).over(f) - F.avg(F.when(C("_d1").isNotNull(), C("_d"))).over(f) * F.avg("_d1").over(f)
    two = frame(-1, 0, key)
    beta, gamma = C("_hl2") + F.lag("_hl2").over(over(key)), F.log(F.max("high").over(two) / F.min("low").over(two)) ** 2
    k = 3 - 2 * math.sqrt(2)
    alpha = (F.sqrt(2 * beta) - F.sqrt(beta)) / k - F.sqrt(gamma / k)
    return rows.withColumns({
        "parkinson": F.when(full, F.sqrt(F.avg("_hl2").over(f) / (4 * math.log(2)))), "garman_klass": F.when(full, F.sqrt(F.greatest(F.avg("_gk").over(f), F.lit(0.0)))),
        "roll": F.when(full, 2 * F.sqrt(F.greatest(-cov, F.lit(0.0)))), "corwin_schultz": F.when(F.lag("t").over(over(key)).isNotNull(), F.greatest(2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)), F.lit(0.0))),
        "hl_mid": (C("high") - C("low")) / ((C("high") + C("low")) / 2),
    }).drop("_hl2", "_gk", "_d", "_d1")


def liquidity(rows: DataFrame, w: int, key="symbol") -> DataFrame:
    """Dollar volume strictly before, Amihud ratio, mean over variance of dollar volume, zero-volume count."""
    rows = with_log_return(rows, key).withColumn("_dv", C("close") * C("volume"))
    f, strict = frame(-w + 1, 0, key), frame(-w, -1, key)
    full = F.count("r").over(f) == w
    return rows.withColumns({
        "adv": F.when(F.count("_dv").over(strict) == w, F.avg("_dv").over(strict)), "amihud": F.when(full, F.avg(F.abs(C("r")) / C("_dv")).over(f) * 1e6),
        "dv_ratio": F.when(full, safe_div(F.avg("_dv").over(f), F.var_pop("_dv").over(f))), "zero_volume": F.sum((C("volume") == 0).cast("int")).over(f).cast("long"),
    }).drop("_dv", "r")


def momentum_set(rows: DataFrame, key="symbol") -> DataFrame:
    lagged = lambda n: F.lag("close", n).over(over(key))
    rows = with_log_return(rows, key)
    vol = lambda n: F.when(F.count("r").over(frame(1 - n, 0, key)) == n, F.stddev_samp("r").over(frame(1 - n, 0, key)) * math.sqrt(365))
    return rows.withColumns({
        "mom21": F.log(C("close") / lagged(21)), "mom63": F.log(C("close") / lagged(63)), "mom252": F.log(C("close") / lagged(252)), "mom12_1": F.log(lagged(21) / lagged(252)),
        "reversal": -F.log(C("close") / lagged(5)), "vol20": vol(20), "vol60": vol(60),
    }).drop("r")


def signature2(rows: DataFrame, x: str, y: str, w: int, key="symbol") -> DataFrame:
    """Adds s_x, s_y and s_xy of the path (x, y) over the last w steps, anchored at the frame's first point."""
    rows = rows.withColumn("_dy", F.lead(y).over(over(key)) - C(y)).withColumn("_p", C(x) * C("_dy"))
    f, steps = frame(-w, 0, key), frame(-w, -1, key)
    first_x, first_y, enough = F.first(x).over(f), F.first(y).over(f), F.count(x).over(f) == w + 1
    return rows.withColumns({
        "s_x": F.when(enough, C(x) - first_x), "s_y": F.when(enough, C(y) - first_y),
        "s_xy": F.when(enough, F.sum("_p").over(steps) - first_x * F.sum("_dy").over(steps)),
    }).drop("_dy", "_p")


def wide_range_spread(key="symbol") -> Column:
    """High-low spread of a row and the next, where the range of both passes the root of their squared ranges' sum; else zero, and null in the last row."""
    high, low, w = F.lead("high").over(over(key)), F.lead("low").over(over(key)), over(key)
    apart = F.log(C("high") / C("low")) ** 2 + F.log(high / low) ** 2
    joint = F.log(F.greatest(C("high"), high) / F.least(C("low"), low)) ** 2
    c = 3 - 2 * math.sqrt(2)
    alpha = (F.sqrt(2 * joint) - F.sqrt(joint)) / c - F.sqrt(apart / c)
    spread = F.when((joint > apart) & (alpha > 0), 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))).otherwise(0.0)
    return F.when(F.lead("t").over(w).isNotNull(), spread)
