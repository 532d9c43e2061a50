"""Ordered recursions as blocked scans.

Each row is an element of something that composes (an affine map, a clamp, a map of states). Rows of a key are numbered and cut into
blocks of 64; a block is folded into one element, the blocks are scanned in the same way, and every block is then
run through from the value that enters it. So a long key is spread over tasks, and only blocks of 64 rows are ever
gathered; a billion rows take five levels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import frame, over

C = F.col
BLOCK = 64


def blocked_scan(rows: DataFrame, element: Column, compose: Callable[[Column, Column], Column], apply: Callable[[Column, Column], Column], initial: Column, out: str, *, key: str = "symbol", time: str = "t") -> DataFrame:
    """rows with ``out``: y_n = apply(y_{n-1}, element_n), y_{-1} = initial; compose(first, second) is apply's composition."""
    numbered = rows.withColumn("_n", (F.row_number().over(over(key, time)) - 1).cast("long")).withColumn("_e", element)
    longest = numbered.agg(F.max("_n")).first()[0]
    packed = numbered.select(C(key).alias("_k"), C("_n"), C("_e"), F.struct(*[C(c) for c in rows.columns]).alias("_row"))
    return _solve(packed, compose, apply, initial, 0 if longest is None else longest + 1).select("_row.*", C("_y").alias(out))


def _solve(elements: DataFrame, compose, apply, initial: Column, n: int) -> DataFrame:
    """(_k, _m, _row, _y) of elements (_k, _n, _e, _row); rows travel inside their blocks, so nothing is joined back."""
    item = F.struct("_n", "_e", "_row")
    blocks = elements.groupBy("_k", F.floor(C("_n") / BLOCK).alias("_b")).agg(F.array_sort(F.collect_list(item), lambda x, y: (x["_n"] - y["_n"]).cast("int")).alias("_xs"))
    entering = initial
    if n > BLOCK:
        bare = elements.groupBy("_k", F.floor(C("_n") / BLOCK).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_n", "_e"))).alias("_xs"))
        first, rest = F.element_at("_xs", 1)["_e"], F.slice("_xs", 2, BLOCK)
        folded = bare.select("_k", C("_b").alias("_n"), F.aggregate(rest, first, lambda s, x: compose(s, x["_e"])).alias("_e"), F.lit(None).cast("int").alias("_row"))
        before = _solve(folded, compose, apply, initial, -(-n // BLOCK)).select(C("_k").alias("_k2"), (C("_m") + 1).alias("_b2"), C("_y").alias("_in"))
        blocks = blocks.join(before, (C("_k") == C("_k2")) & (C("_b") == C("_b2")), "left")
        entering = F.coalesce("_in", initial)
    values = F.aggregate(
        "_xs",
        F.struct(entering.alias("y"), F.slice(F.array(initial), 2, 1).alias("all")),
        lambda s, x: F.struct(apply(s["y"], x["_e"]).alias("y"), F.concat(s["all"], F.array(apply(s["y"], x["_e"]))).alias("all")),
        lambda s: s["all"],
    )
    both = blocks.select("_k", "_xs", values.alias("_ys")).select("_k", F.explode(F.arrays_zip("_xs", "_ys")).alias("_z"))
    return both.select("_k", C("_z._xs._n").alias("_m"), C("_z._xs._row").alias("_row"), C("_z._ys").alias("_y"))


def affine_scan(rows: DataFrame, a: Column, b: Column, out: str, **options) -> DataFrame:
    """y = a * y_prev + b; a row that is null in a or b keeps the value before it."""
    a, b = F.when(a.isNull() | b.isNull(), 1.0).otherwise(a), F.when(a.isNull() | b.isNull(), 0.0).otherwise(b)
    element = F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))
    return blocked_scan(
        rows, element, lambda s, e: F.struct((e["a"] * s["a"]).alias("a"), (e["a"] * s["b"] + e["b"]).alias("b")), lambda y, e: e["a"] * y + e["b"], F.lit(0.0), out, **options
    )


def vector_scan(rows: DataFrame, maps: dict[str, tuple[Column, Column]], **options) -> DataFrame:
    """Many affine scans y = a * y_prev + b in one: ``maps`` gives (a, b) for each new column; a null a or b keeps the value."""
    names = list(maps)
    parts = [(F.when(a.isNull() | b.isNull(), 1.0).otherwise(a).cast("double"), F.when(a.isNull() | b.isNull(), 0.0).otherwise(b).cast("double")) for a, b in maps.values()]
    element = F.struct(F.array(*[a for a, _ in parts]).alias("a"), F.array(*[b for _, b in parts]).alias("b"))
    # the slope and the offset of the composition, entry by entry
    compose = lambda s, e: F.struct(
        F.zip_with(s["a"], e["a"], lambda x, y: x * y).alias("a"), F.zip_with(F.zip_with(s["b"], e["a"], lambda x, y: x * y), e["b"], lambda x, y: x + y).alias("b")
    )
    apply = lambda y, e: F.zip_with(F.zip_with(y, e["a"], lambda u, v: u * v), e["b"], lambda u, v: u + v)
    got = blocked_scan(rows, element, compose, apply, F.array(*[F.lit(0.0)] * len(names)), "_all", **options)
    return got.withColumns({n: F.get("_all", F.lit(i)) for i, n in enumerate(names)}).drop("_all")


def ema_map(value: Column, alpha: float, seen: Column) -> tuple[Column, Column]:
    """The map of an exponential mean seeded by the first value; ``seen`` counts the values up to the row."""
    first = seen == 1
    return F.when(value.isNotNull(), F.when(first, 0.0).otherwise(1 - alpha)), F.when(value.isNotNull(), F.when(first, value).otherwise(alpha * value))


def wilder_map(value: Column, w: int, seen: Column, mean: Column) -> tuple[Column, Column]:
    """The map of Wilder's mean, which starts with the mean of the first w values; ``mean`` is that of all values up to the row."""
    there = value.isNotNull() & (seen >= w)
    return F.when(there, F.when(seen == w, 0.0).otherwise((w - 1) / w)), F.when(there, F.when(seen == w, mean).otherwise(value / w))


def emas(rows: DataFrame, values: dict[str, tuple[str, float]], *, key: str = "symbol", time: str = "t") -> DataFrame:
    """Exponential means {new column: (column, alpha)} in one scan, each seeded by its first value; null before it."""
    whole = frame(-(1 << 63), 0, key, time)
    counts = {f"_seen_{c}": F.count(c).over(whole) for c in {c for c, _ in values.values()}}
    got = vector_scan(rows.withColumns(counts), {n: ema_map(C(c), alpha, C(f"_seen_{c}")) for n, (c, alpha) in values.items()}, key=key, time=time)
    return got.withColumns({n: F.when(C(f"_seen_{c}") > 0, C(n)) for n, (c, _) in values.items()}).drop(*counts)


#: fixed values of the feature matrix: windows in bars, and after how many windows a family's columns are given
FEATURE_WINDOWS = (3, 6, 12, 24, 48, 72, 168, 336)
WARM_UP = {"sma": 1, "ema": 3, "rsi": 3, "atr": 3, "macd": 6}


def feature_matrix(bars: DataFrame, windows: tuple[int, ...] = FEATURE_WINDOWS, *, volume_mean: int = 24, key: str = "symbol") -> DataFrame:
    """bars with five columns of the bar (ret1, range_hl, close_open, gap, vol_ratio) and five families for each window, all known at the bar's close.

    sma_w and ema_w are log distances of the close, rsi_w is in -1 to 1, atr_w and macd_w (means of w and 2 w bars) are parts of the close. All recursions
    are one scan. A column is null in its first rows: w, 3 w (ema, rsi, atr) or 6 w (macd).
    """
    w, whole = over(key), frame(-(1 << 63), 0, key)
    before = F.lag("close").over(w)
    d = F.coalesce(C("close") - before, F.lit(0.0))
    x = bars.withColumns({"_i": F.row_number().over(w), "_priced": F.count("close").over(whole), "_up": F.greatest(d, F.lit(0.0)), "_down": F.greatest(-d, F.lit(0.0)), "_tr": true_range(key)})
    x = x.withColumns({f"_mean{c}": F.avg(c).over(whole) for c in ("_up", "_down", "_tr")})
    maps = {f"_e{k}": ema_map(C("close"), 2 / (k + 1), C("_priced")) for k in sorted({*windows, *[2 * k for k in windows]})}
    maps |= {f"{c}{k}": wilder_map(C(c), k, C("_i"), C(f"_mean{c}")) for c in ("_up", "_down", "_tr") for k in windows}
    x = vector_scan(x, maps, key=key)
    mean = lambda c, k: F.avg(c).over(frame(-k + 1, 0, key))
    out = {
        "ret1": F.log(C("close") / before), "range_hl": F.log(C("high") / C("low")), "close_open": F.log(C("close") / C("open")), "gap": F.log(C("open") / before),
        "vol_ratio": F.when(C("_i") >= volume_mean, F.log(C("volume") / mean("volume", volume_mean))),
    }
    for k in windows:
        up, down = C(f"_up{k}"), C(f"_down{k}")
        index = F.when(down > 0, 100 - 100 / (1 + up / down)).when(up > 0, 100.0).otherwise(50.0)
        columns = {"sma": F.log(C("close") / mean("close", k)), "ema": F.log(C("close") / C(f"_e{k}")), "rsi": (index - 50) / 50, "atr": C(f"_tr{k}") / C("close"), "macd": (C(f"_e{k}") - C(f"_e{2 * k}")) / C("close")}
        out |= {f"{f}_{k}": F.when(C("_i") > max(WARM_UP[f] * k, k - 1), v) for f, v in columns.items()}
    return x.select(*bars.columns, *[v.alias(n) for n, v in out.items()])


#: fixed values of the oscillators: span of the scaling volatility, speeds, ratio of slow to fast
OSCILLATOR_SPAN, SPEEDS, SLOWNESS = 22, (1, 2, 3, 4, 5, 6), 4.0


def oscillators(bars: DataFrame, value: str = "close", speeds: tuple[int, ...] = SPEEDS, *, key: str = "symbol") -> DataFrame:
    """bars with ``scaled``, the sum of changes over their exponential deviation, and osc_k for each speed: fast less slow mean of it over its own deviation.

    Deviations are about the same recursion's mean and begin at zero; where one is zero the change counts as zero and the oscillator is null. Four scans, whatever the number of speeds.
    """
    a = 2 / (OSCILLATOR_SPAN + 1)
    x = bars.withColumn("_d", F.coalesce(C(value) - F.lag(value).over(over(key)), F.lit(0.0)))
    x = emas(x, {"_mu": ("_d", a)}, key=key).withColumn("_sq", (C("_d") - C("_mu")) ** 2)
    x = emas(x, {"_var": ("_sq", a)}, key=key)
    x = x.withColumn("scaled", F.sum(F.when(C("_var") > 0, C("_d") / F.sqrt("_var")).otherwise(0.0)).over(over(key).rowsBetween(-(1 << 63), 0)))
    fast = {k: 1 / (k * 2**0.5) for k in speeds}
    x = emas(x, {f"_{n}{k}": ("scaled", v / r) for k, v in fast.items() for n, r in (("f", 1), ("s", SLOWNESS))}, key=key)
    x = x.withColumns({f"_q{k}": (C("scaled") - C(f"_f{k}")) ** 2 for k in speeds})
    x = emas(x, {f"_v{k}": (f"_q{k}", fast[k]) for k in speeds}, key=key)
    return x.select(*bars.columns, "scaled", *[F.when(C(f"_v{k}") > 0, (C(f"_f{k}") - C(f"_s{k}")) / F.sqrt(f"_v{k}")).alias(f"osc_{k}") for k in speeds])


def ema(rows: DataFrame, value: str, alpha: float, out: str, *, key: str = "symbol", time: str = "t") -> DataFrame:
    """Exponential mean seeded by the first value; nulls are skipped, and rows before the first value are null."""
    seen = F.count(value).over(frame(-(1 << 63), 0, key, time))
    rows = rows.withColumn("_seen", seen)
    first = C("_seen") == 1
    a = F.when(C(value).isNotNull(), F.when(first, 0.0).otherwise(1 - alpha))
    b = F.when(C(value).isNotNull(), F.when(first, C(value)).otherwise(alpha * C(value)))
    got = affine_scan(rows, a, b, out, key=key, time=time)
    return got.withColumn(out, F.when(C("_seen") > 0, C(out))).drop("_seen")


def ewm_variance(rows: DataFrame, value: str, alpha: float, out: str, **options) -> DataFrame:
    return ema(rows.withColumn("_sq", C(value) ** 2), "_sq", alpha, out, **options).drop("_sq")


def wilder(rows: DataFrame, value: str, w: int, out: str, *, key: str = "symbol", time: str = "t") -> DataFrame:
    """Mean of the first w values, then (y (w - 1) + x) / w; null before."""
    whole = frame(-(1 << 63), 0, key, time)
    rows = rows.withColumns({"_seen": F.count(value).over(whole), "_mean": F.avg(value).over(whole)})
    a = F.when(C(value).isNotNull() & (C("_seen") >= w), F.when(C("_seen") == w, 0.0).otherwise((w - 1) / w))
    b = F.when(C(value).isNotNull() & (C("_seen") >= w), F.when(C("_seen") == w, C("_mean")).otherwise(C(value) / w))
    got = affine_scan(rows, a, b, out, key=key, time=time)
    return got.withColumn(out, F.when(C("_seen") >= w, C(out))).drop("_seen", "_mean")


def true_range(key: str = "symbol", first: bool = True) -> Column:
    """Largest of high-low and the gaps to the close before; the first row is high-low, or null."""
    before = F.lag("close").over(over(key))
    full = F.greatest(C("high") - C("low"), F.abs(C("high") - before), F.abs(C("low") - before))
    return F.when(before.isNotNull(), full).otherwise(C("high") - C("low") if first else None)


def rsi(rows: DataFrame, w: int, out: str, *, key: str = "symbol") -> DataFrame:
    """Wilder's index: 50 where gain and loss are both zero, 100 where only loss is."""
    d = C("close") - F.lag("close").over(over(key))
    rows = rows.withColumns({"_up": F.greatest(d, F.lit(0.0)), "_down": F.greatest(-d, F.lit(0.0))})
    rows = rows.withColumns({"_up": F.when(d.isNotNull(), C("_up")), "_down": F.when(d.isNotNull(), C("_down"))})
    rows = wilder(wilder(rows, "_up", w, "_g", key=key), "_down", w, "_l", key=key)
    value = F.when((C("_g") == 0) & (C("_l") == 0), 50.0).when(C("_l") == 0, 100.0).otherwise(100 - 100 / (1 + C("_g") / C("_l")))
    return rows.withColumn(out, F.when(C("_g").isNotNull(), value)).drop("_up", "_down", "_g", "_l")


def macd(rows: DataFrame, value: str = "close", fast: int = 12, slow: int = 26, signal: int = 9, *, key: str = "symbol") -> DataFrame:
    """macd (fast less slow exponential mean) and macd_signal, its own exponential mean, in one scan.

    The state is (fast f, slow s, signal g), and a row maps it by f' = a f + x, s' = b s + y, g' = h g + u f + v s + w; such triangular maps compose.
    Rows without a value keep the state; rows before the first value are null.
    """
    k, m, c = 2 / (fast + 1), 2 / (slow + 1), 2 / (signal + 1)
    rows = rows.withColumn("_seen", F.count(value).over(frame(-(1 << 63), 0, key)))
    v, first, none = C(value).cast("double"), C("_seen") == 1, C(value).isNull()
    of = lambda kept, begins, goes_on: F.when(none, kept).when(first, begins).otherwise(goes_on)
    element = F.struct(
        of(1.0, 0.0, 1 - k).alias("a"), of(0.0, v, k * v).alias("x"), of(1.0, 0.0, 1 - m).alias("b"), of(0.0, v, m * v).alias("y"),
        of(1.0, 0.0, 1 - c).alias("h"), of(0.0, 0.0, c * (1 - k)).alias("u"), of(0.0, 0.0, -c * (1 - m)).alias("v"), of(0.0, 0.0, c * (k - m) * v).alias("w"),
    )
    both = lambda p, q: F.struct(
        (q["a"] * p["a"]).alias("a"), (q["a"] * p["x"] + q["x"]).alias("x"), (q["b"] * p["b"]).alias("b"), (q["b"] * p["y"] + q["y"]).alias("y"), (q["h"] * p["h"]).alias("h"),
        (q["h"] * p["u"] + q["u"] * p["a"]).alias("u"), (q["h"] * p["v"] + q["v"] * p["b"]).alias("v"), (q["h"] * p["w"] + q["u"] * p["x"] + q["v"] * p["y"] + q["w"]).alias("w"),
    )
    step = lambda s, e: F.struct((e["a"] * s["f"] + e["x"]).alias("f"), (e["b"] * s["s"] + e["y"]).alias("s"), (e["h"] * s["g"] + e["u"] * s["f"] + e["v"] * s["s"] + e["w"]).alias("g"))
    start = F.struct(*[F.lit(0.0).alias(n) for n in "fsg"])
    got = blocked_scan(rows, element, both, step, start, "_state", key=key)
    there = C("_seen") > 0
    return got.withColumns({"macd": F.when(there, C("_state.f") - C("_state.s")), "macd_signal": F.when(there, C("_state.g"))}).drop("_seen", "_state")


#: fixed values: the prices whose MACD is compared, the whole one last
MACD_PRICES = ("standard", "volume", "volatility", "body", "full")


def weighted_macd(bars: DataFrame, *, width: int = 10, deviation: int = 10, crossing: float = 1.0, key: str = "symbol") -> DataFrame:
    """(key, t, variant, price, macd, macd_signal, enter, leave): MACD of five prices, all in one scan, one run of rows for each key and variant.

    The close is weighted with volume, with the deviation of the bar's range over the last ``deviation`` bars as a part of the close, with the body as a part of the
    range (none where the range is zero), or with all three; this whole price is the weights' sum over that of volumes in the ``width`` bars before the row.
    enter: macd rises above ``crossing`` times its signal; leave: it falls below the signal. Both need the row before; differences under half a billionth count as
    none. Prices are null in their warm-up.
    """
    span, last, back = C("high") - C("low"), frame(1 - deviation, 0, key), frame(-width, -1, key)
    x = bars.withColumns({
        "_sd": F.when(F.count(span).over(last) == deviation, F.stddev_pop(span).over(last)) / C("close"),
        "_body": F.when(span > 0, F.abs(C("close") - C("open")) / span).otherwise(0.0),
    }).withColumn("_all", C("close") * C("volume") * C("_sd") * C("_body"))
    traded = F.sum("volume").over(back)
    whole = F.when((F.count("_all").over(back) == width) & (traded > 0), F.sum("_all").over(back) / traded)
    prices = dict(zip(MACD_PRICES, (C("close"), C("close") * C("volume"), C("close") * C("_sd"), C("close") * C("_body"), C("_whole")), strict=True))
    long = x.withColumn("_whole", whole).select(key, "t", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), p.cast("double").alias("price")) for n, p in prices.items()])).alias("_p"))
    long = long.select(key, "t", "_p.*").withColumn("_run", F.struct(key, "variant"))
    got = macd(long, "price", key="_run").withColumns({c: F.when(C("price").isNotNull(), C(c)) for c in ("macd", "macd_signal")})
    w = over("_run")
    above = lambda times: F.round(C("macd") - times * C("macd_signal"), 9)
    got = got.withColumns({"_over": above(crossing), "_past": above(1.0)})
    enter, leave = (F.lag("_over").over(w) <= 0) & (C("_over") > 0), (F.lag("_past").over(w) >= 0) & (C("_past") < 0)
    return got.select(key, "t", "variant", "price", "macd", "macd_signal", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in (("enter", enter), ("leave", leave))])


def bricks(rows: DataFrame, size: float, *, key: str = "symbol") -> DataFrame:
    """Geometric price bricks: level k clamped to [floor x, ceil x] with x = ln(close / first close) / ln(1 + size); moved is the change."""
    import math

    first = F.first("close").over(frame(-(1 << 63), 0, key))
    x = F.round(F.log(C("close") / first) / math.log(1 + size), 9)
    element = F.struct(F.floor(x).cast("double").alias("lo"), F.ceil(x).cast("double").alias("hi"))
    clamp = lambda v, e: F.least(F.greatest(v, e["lo"]), e["hi"])
    rows = rows.withColumn("_x", element)
    got = blocked_scan(rows, C("_x"), lambda s, e: F.struct(clamp(s["lo"], e).alias("lo"), clamp(s["hi"], e).alias("hi")), clamp, F.lit(0.0), "level", key=key).drop("_x")
    return got.withColumn("moved", C("level") - F.coalesce(F.lag("level").over(over(key)), F.lit(0.0)))


def hurdle_position(rows: DataFrame, forecast: str, cost: float, out: str, *, key: str = "symbol") -> DataFrame:
    """Position in -1, 0, 1 that moves to the forecast's sign only where |forecast| > cost * |move|; each row maps three states to three."""
    target = F.coalesce(F.signum(forecast), F.lit(0.0)).cast("int")
    move = lambda p: F.when(F.abs(C(forecast)) > cost * F.abs(target - p), target).otherwise(p)
    rows = rows.withColumn("_map", F.array(*[move(F.lit(p)) for p in (-1, 0, 1)]))
    at = lambda m, p: F.element_at(m, p + 2)
    return blocked_scan(rows, C("_map"), lambda s, e: F.transform(s, lambda p: at(e, p)), lambda y, e: at(e, y), F.lit(0), out, key=key).drop("_map")


def carry_sign(value: Column, key: str = "symbol", start: int = 1) -> Column:
    """Sign of the last value that isn't zero; ``start`` before the first."""
    s = F.when(value != 0, F.signum(value))
    return F.coalesce(F.last(s, ignorenulls=True).over(frame(-(1 << 63), 0, key)), F.lit(float(start)))
