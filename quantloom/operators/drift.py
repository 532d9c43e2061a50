"""Drift of features and scores against their own past, and the gate of trust in a score that follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clamp, over, sigmoid
from .orderstats import running_sums
from .rolling import expanding_z
from .scan import ema
from .statistics import average_rank

C = F.col


def feature_drift(rows: DataFrame, features: list[str], window: int = 252, min_count: int = 60, *, key: str = "symbol") -> DataFrame:
    """(t, drift): mean of |z| over all keys and features, each against the ``window`` rows before it (not its own); null where no feature has ``min_count`` of them and some spread."""
    f = over(key).rowsBetween(-window, -1)
    z = lambda c: F.when((F.count(c).over(f) >= min_count) & (F.stddev_pop(c).over(f) > 0), F.abs((C(c) - F.avg(c).over(f)) / F.stddev_pop(c).over(f)))
    x = rows.select("t", *[z(c).alias(f"_z{i}") for i, c in enumerate(features)])
    sums, counts = [F.coalesce(F.sum(f"_z{i}"), F.lit(0.0)) for i in range(len(features))], [F.count(f"_z{i}") for i in range(len(features))]
    n = sum(counts[1:], counts[0])
    return x.groupBy("t").agg(F.when(n > 0, sum(sums[1:], sums[0]) / n).alias("drift"))


def score_drift(rows: DataFrame, score: str, window: int = 60, min_pool: int = 20) -> DataFrame:
    """(t, ks): the largest gap between the distribution of a time's scores and that of the ``window`` times before; null with fewer than ``min_pool`` of these, or none now.

    Each score goes to the times whose pool it is in, where one sort by value merges both sides, so a time needs what its pool holds, and times are spread over the tasks.
    """
    times = running_sums(rows.select("t").distinct().withColumn("_one", F.lit(1).cast("long")), [], ["t"], {"_m": "_one"}).select("t", "_m")
    x = rows.select("t", C(score).alias("_v")).where("_v is not null").join(times, "t").select("_m", "_v")
    # the pool as counts of values, so that equal scores travel once
    by = x.groupBy("_m", "_v").agg(F.count("*").alias("_k"))
    pool = by.select(F.explode(F.sequence(C("_m") + 1, C("_m") + window)).alias("_m"), "_v", C("_k").alias("_p"), F.lit(0).cast("long").alias("_q"))
    both = pool.unionByName(by.select("_m", "_v", F.lit(0).cast("long").alias("_p"), C("_k").alias("_q")))
    upto, at = Window.partitionBy("_m").orderBy("_v"), Window.partitionBy("_m")  # equal values are taken together
    gaps = both.select("_m", F.sum("_p").over(upto).alias("a"), F.sum("_p").over(at).alias("na"), F.sum("_q").over(upto).alias("b"), F.sum("_q").over(at).alias("nb"))
    ks = gaps.where((C("na") >= min_pool) & (C("nb") > 0)).groupBy("_m").agg(F.max(F.abs(C("a") / C("na") - C("b") / C("nb"))).alias("ks"))
    return times.join(ks, "_m", "left").select("t", "ks")


def rank_correlation(rows: DataFrame, a: str, b: str, min_count: int = 3) -> DataFrame:
    """(t, rho): Spearman's correlation of two columns by time over rows that have both; null with fewer than ``min_count`` or no spread."""
    x = rows.where(C(a).isNotNull() & C(b).isNotNull()).select("t", average_rank(C(a), ["t"]).alias("_a"), average_rank(C(b), ["t"]).alias("_b"))
    g = x.groupBy("t").agg(F.count("*").alias("n"), F.covar_pop("_a", "_b").alias("c"), F.stddev_pop("_a").alias("sa"), F.stddev_pop("_b").alias("sb"))
    return g.select("t", F.when((C("n") >= min_count) & (C("sa") > 0) & (C("sb") > 0), C("c") / C("sa") / C("sb")).alias("rho"))


def mean_percentile(rows: DataFrame, features: list[str], out: str) -> DataFrame:
    """rows with the mean of a row's percentile ranks among its time, ties in the middle; null where a feature is, or where fewer than two rows have it."""
    parts: list[Column] = []
    for i, c in enumerate(features):
        rows = rows.withColumn(f"_has{i}", C(c).isNotNull())
        n = F.count("*").over(Window.partitionBy("t", f"_has{i}"))
        parts.append(F.when(C(f"_has{i}") & (n >= 2), (average_rank(C(c), ["t", f"_has{i}"]) - 0.5) / n))
    return rows.withColumn(out, F.round(sum(parts[1:], parts[0]) / len(parts), 9)).drop(*[f"_has{i}" for i in range(len(features))])


def matured_mean(series: DataFrame, value: str, maturity: int, half_life: float, min_count: int, out: str, *, key: str = "market") -> DataFrame:
    """Exponential mean of values that are known only ``maturity`` rows later; null before ``min_count`` of them are."""
    x = series.withColumn("_known", F.lag(value, maturity).over(over(key)))
    x = ema(x, "_known", 1 - 0.5 ** (1 / half_life), out, key=key)
    seen = F.count("_known").over(over(key).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_seen_known", seen).withColumn(out, F.when(C("_seen_known") >= min_count, C(out))).drop("_known", "_seen_known")


def trust_gate(health: str, drift: str, disagreement: str, *, min_count: int = 60, low: float = 0.3, high: float = 0.7, key: str = "market") -> Column:
    """0 to 1 from the z-scores of health, less 0.3 of drift's and of disagreement's, each against the strictly earlier history, through a sigmoid stretched from low to high; null where one of them is."""
    z = lambda c: expanding_z(C(c), min_count, key, strict=True)
    trust = (sigmoid(z(health) - 0.3 * z(drift) - 0.3 * z(disagreement)) - low) / (high - low)
    return F.when(trust.isNotNull(), clamp(trust, 0.0, 1.0))


def score_trust(rows: DataFrame, score: str, label: str, features: list[str], horizon: int, *, half_life: float = 30.0, min_matured: int = 20, min_count: int = 60, window: int = 252, key: str = "symbol") -> DataFrame:
    """(t, health, drift, disagreement, gate): health is the matured rank correlation of score and label, which looks ``horizon`` times ahead;
    disagreement the rank correlation of the score with the mean percentile of the features. After the aggregation there is one row for each time, in one sort."""
    ic = rank_correlation(rows, score, label).withColumnRenamed("rho", "_ic")
    dis = rank_correlation(mean_percentile(rows, features, "_second"), score, "_second").withColumnRenamed("rho", "disagreement")
    series = rows.select("t").distinct().join(ic, "t", "left").join(feature_drift(rows, features, window, key=key), "t", "left").join(dis, "t", "left").withColumn("market", F.lit(1))
    series = matured_mean(series, "_ic", horizon, half_life, min_matured, "health")
    return series.select("t", "health", "drift", "disagreement", trust_gate("health", "drift", "disagreement", min_count=min_count).alias("gate"))
