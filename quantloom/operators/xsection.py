"""Cross-section summaries of pair matrices, and scores of a panel's network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import over, rolling
from .joins import symbol_pairs
from .orderstats import saved
from .scan import SPEEDS, oscillators

C = F.col


def graph_features(pairs: DataFrame, nodes: DataFrame, threshold: float, *, node: str = "symbol") -> DataFrame:
    """Edges, triangles, mean degree, density and mean clustering of the graph of pairs (a < b) with |rho| at or above a threshold.

    The clustering of a node is the share of the pairs of its neighbours that are linked, 0 with fewer than two neighbours.
    """
    e = pairs.where(F.abs("rho") >= threshold).select("a", "b")
    two = e.join(e.select(C("a").alias("b"), C("b").alias("c")), "b")
    closed = two.join(e.select("a", C("b").alias("c")), ["a", "c"])
    corner = closed.select(F.explode(F.array("a", "b", "c")).alias(node)).groupBy(node).agg(F.count("*").alias("k"))
    degree = e.select(F.explode(F.array("a", "b")).alias(node)).groupBy(node).agg(F.count("*").alias("g"))
    share = F.when(C("g") >= 2, 2 * F.coalesce("k", F.lit(0)) / (C("g") * (C("g") - 1))).otherwise(0.0)
    by_node = nodes.join(degree, node, "left").join(corner, node, "left")
    got = by_node.agg(F.count("*").alias("n"), (F.coalesce(F.sum("g"), F.lit(0)) / 2).cast("long").alias("edges"), (F.coalesce(F.sum("k"), F.lit(0)) / 3).cast("long").alias("triangles"), F.avg(share).alias("clustering"))
    return got.withColumns({"mean_degree": 2 * C("edges") / C("n"), "density": 2 * C("edges") / F.nullif(C("n") * (C("n") - 1), F.lit(0))})


def at_joint_times(bars: DataFrame, *, key: str = "symbol") -> DataFrame:
    """The bars of times at which every key of the table has one."""
    n = bars.select(key).distinct().count()
    return bars.join(bars.groupBy("t").agg(F.count_distinct(key).alias("_n")).where(C("_n") == n).select("t"), "t")


def network_momentum(bars: DataFrame, lookback: int = 22, *, beta: float = 0.01, warm_up: int = 188, spread: float = 2**0.5, speeds: tuple[int, ...] = SPEEDS, key: str = "symbol") -> DataFrame:
    """(key, t, score, state, event) of the times at which every key has a bar, after the first ``warm_up`` of them.

    The lead-lag matrix of a time holds the Levy areas of all pairs of scaled prices over ``lookback`` bars, divided by its largest size. Keys are near when their
    rows of it are: weights are 1 / (W^2 + beta) with W the squared distance of rows, none to oneself, and sum to 1. The neighbours' weighted oscillator x of each
    speed gives x exp(-x^2 / (2 spread^2)); the score is the mean over speeds, null where an oscillator is; state its sign (0 for null), event a new state that isn't 0.
    A time makes n^2 pairs of n keys, each compared over n entries, as the method asks; times are spread over the tasks.
    """
    n = bars.select(key).distinct().count()
    x = saved(oscillators(at_joint_times(bars, key=key), speeds=speeds, key=key).withColumn("_i", F.row_number().over(over(key))))
    pairs, w = symbol_pairs(x.select(C(key).alias("symbol"), "t", "scaled"), "scaled"), over(["a", "b"])
    pa, pb = F.lag("ra").over(w), F.lag("rb").over(w)
    area = (C("ra") - pa) * (pb + C("rb")) - (C("rb") - pb) * (pa + C("ra"))
    led = pairs.withColumn("_area", area).withColumn("v", rolling(C("_area"), lookback, F.sum, key=["a", "b"]))
    both = led.where("v is not null").select("t", F.explode(F.array(F.struct("a", "b", "v"), F.struct(C("b").alias("a"), C("a").alias("b"), (-C("v")).alias("v")))).alias("_z")).select("t", "_z.*")
    whole = both.unionByName(x.select("t", C(key).alias("a"), C(key).alias("b"), F.lit(0.0).alias("v")))
    rows = whole.groupBy("t", "a").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda e: e["v"]).alias("_v")).where(F.size("_v") == n)
    rows = rows.withColumn("_top", F.nullif(F.max(F.array_max(F.transform("_v", F.abs))).over(Window.partitionBy("t")), F.lit(0.0)))
    rows = saved(rows.select("t", "a", F.transform("_v", lambda v: v / F.coalesce("_top", F.lit(1.0))).alias("_v")))
    other = rows.select(C("t").alias("_t"), C("a").alias("b"), C("_v").alias("_u"))
    far = F.aggregate(F.zip_with("_v", "_u", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, e: s + e)
    near = rows.join(other, (C("t") == C("_t")) & (C("a") != C("b"))).select("t", "a", "b", (1 / (far * far + beta)).alias("_w"))
    scores = near.join(x.select("t", C(key).alias("b"), *[f"osc_{k}" for k in speeds]), ["t", "b"]).groupBy("t", "a").agg(
        *[F.when(F.count(f"osc_{k}") == F.count("*"), F.sum(C("_w") * C(f"osc_{k}")) / F.sum("_w")).alias(f"_x{k}") for k in speeds]
    )
    answer = sum((C(f"_x{k}") * F.exp(-C(f"_x{k}") * C(f"_x{k}") / (2 * spread**2)) for k in speeds), F.lit(0.0)) / len(speeds)
    late = x.where(C("_i") > warm_up).select(key, "t")
    got = late.join(scores.select(C("a").alias(key), "t", answer.alias("score")), [key, "t"], "left")
    got = got.withColumn("state", F.coalesce(F.signum(F.round("score", 9)), F.lit(0.0)).cast("long"))
    fresh = (C("state") != F.coalesce(F.lag("state").over(over(key)), F.lit(0))) & (C("state") != 0)
    return got.withColumn("event", F.when(fresh, C("state")).otherwise(0))


def ew_correlation(pairs: DataFrame, width: int, half_life: float) -> DataFrame:
    """(a, b, n, rho) of the last ``width`` rows of each pair (a, b, t, ra, rb), the weight halving every ``half_life`` rows back; zero where a side doesn't vary."""
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.col("t").desc()))
    x = pairs.withColumn("_n", place).where(F.col("_n") <= width).withColumn("_w", F.pow(F.lit(0.5), (F.col("_n") - 1) / half_life))
    g = Window.partitionBy("a", "b")
    mean = lambda c: F.sum(F.col("_w") * F.col(c)).over(g) / F.sum("_w").over(g)
    x = x.withColumns({"_x": F.col("ra") - mean("ra"), "_y": F.col("rb") - mean("rb")})
    s = lambda u, v: F.sum(F.col("_w") * F.col(u) * F.col(v))
    m = x.groupBy("a", "b").agg(F.count("*").alias("n"), s("_x", "_y").alias("_xy"), s("_x", "_x").alias("_xx"), s("_y", "_y").alias("_yy"))
    rho = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_xy") / F.sqrt(F.col("_xx") * F.col("_yy"))))
    return m.select("a", "b", "n", F.when((F.col("_xx") > 0) & (F.col("_yy") > 0), rho).otherwise(0.0).alias("rho"))
