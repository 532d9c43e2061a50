"""Statistical tests and resampling as frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import over
from .orderstats import running_sums

C = F.col


def autocorrelation(rows: DataFrame, value: str, lags: list[int], *, key: str = "symbol") -> DataFrame:
    """(key, k, rho) with the mean of the whole sample and divisor n - k."""
    whole = Window.partitionBy(key)
    x = rows.withColumns({"_x": C(value) - F.avg(value).over(whole), "_v": F.var_pop(value).over(whole), "_n": F.count(value).over(whole)})
    pairs = x.withColumn("_p", F.array(*[F.struct(F.lit(k).cast("long").alias("k"), (C("_x") * F.lag("_x", k).over(over(key))).alias("p")) for k in lags]))
    return pairs.select(key, "_v", "_n", F.inline("_p")).groupBy(key, "k").agg((F.sum("p") / F.nullif(F.first("_n") - C("k"), F.lit(0)) / F.nullif(F.first("_v"), F.lit(0.0))).alias("rho"))


def average_rank(column: Column, part: list[str]) -> Column:
    """Rank from 1 with ties sharing their mean rank."""
    w = Window.partitionBy(*part)
    return F.rank().over(w.orderBy(column)) + (F.count("*").over(Window.partitionBy(*part, column)) - 1) / 2


def auroc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by tied rank sums; null when a class is absent.

    Scores are counted by value, and the counts below each value come from running sums over ranges of values.
    """
    by = rows.where(C(score).isNotNull()).groupBy(C(score).alias("s")).agg(F.sum(C(label).cast("long")).alias("p"), F.sum((1 - C(label)).cast("long")).alias("q"))
    return running_sums(by, [], ["s"], {"b": "q"}).agg(
        F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"),
        F.when((F.sum("p") > 0) & (F.sum("q") > 0), F.sum(C("p") * (C("b") + C("q") / 2)) / (F.sum("p") * F.sum("q"))).alias("auroc"),
    )


def ks_distance(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Largest gap of the two empirical distributions, ties taken together; running sums over ranges of values."""
    by = rows.where(C(value).isNotNull()).groupBy(C(value).alias("v")).agg(F.count_if(C(group) == 1).alias("p"), F.count_if(C(group) == 0).alias("q"))
    run = running_sums(by, [], ["v"], {"bp": "p", "bq": "q"})
    totals = by.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))  # one row
    gap = F.max(F.abs((C("bp") + C("p")) / C("np") - (C("bq") + C("q")) / C("nq")))
    return run.crossJoin(F.broadcast(totals)).agg(F.max("np").alias("np"), F.max("nq").alias("nq"), gap.alias("ks"))


def mcnemar(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n01, n10, chi-square with continuity correction, whether it passes the 5 % point 3.841459, and its p to six places."""
    n01, n10 = F.count_if(~C(a) & C(b)), F.count_if(C(a) & ~C(b))
    got = rows.agg(n01.alias("n01"), n10.alias("n10"))
    chi = F.when(C("n01") + C("n10") > 0, (F.abs(C("n01") - C("n10")) - 1) ** 2 / (C("n01") + C("n10")))
    return got.withColumn("chi2", chi).withColumns({"reject": C("chi2") > 3.841459, "p": erfc(F.sqrt(C("chi2") / 2))})


def erfc(x: Column) -> Column:
    """The complementary error function of x >= 0 by a rational approximation, right to 1.5e-7."""
    k = 1 / (1 + 0.3275911 * x)
    series = F.lit(1.061405429)
    for c in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):  # fixed values of the approximation, highest power first
        series = series * k + c
    return series * k * F.exp(-x * x)


def uniform(*parts) -> Column:
    """A repeatable number in (0, 1) from the MD5 of the parts, which any engine can compute."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


#: Distribution function of the Poisson distribution of mean 1 from 0 to 7.
POISSON_ONE = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(8))


def bootstrap_means(rows: DataFrame, key: str, time: str, value: str, draws: int, seed: int = 42) -> DataFrame:
    """(key, draw, mean) of resamples: each row counts in each draw as often as a Poisson number of mean 1, made by hash of row and draw.

    Rows are neither numbered nor joined; sums are taken on the map side, so the shuffle has one row for each key, draw and task.
    """
    drawn = rows.select(key, time, value, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = drawn.withColumn("_u", uniform(F.lit(seed), C(key), C(time), C("draw")))
    weight = sum(((C("_u") >= below).cast("int") for below in POISSON_ONE), F.lit(0))
    return drawn.groupBy(key, "draw").agg((F.sum(weight * C(value)) / F.nullif(F.sum(weight), F.lit(0))).alias("mean"))


#: Up to so many prefix sums (some 20 MB) are broadcast to the lookups of a block bootstrap.
BROADCAST_SUMS = 200_000


def block_bootstrap_means(rows: DataFrame, key: str, time: str, value: str, draws: int, mean_block: float = 21.0, seed: int = 42) -> DataFrame:
    """(key, draw, mean) of a stationary bootstrap: blocks of geometric length with that mean start anywhere and run on circularly until a draw has as many rows as the key.

    The sum of a block is a difference of two prefix sums, so a draw looks up two or three numbers for each of its n / mean_block blocks
    and touches no row. Block j of a draw takes its length and its start from the two halves of one MD5; 2 n / mean_block + 64 blocks
    are at hand, and the last of them runs on to the end. Lookups go to the prefix sums, which are broadcast up to ``BROADCAST_SUMS`` rows
    and else hashed by shuffle: the planner takes the draws for the few sizes that they are made from and would broadcast the lookups.
    """
    x = rows.select(C(key).alias("_key"), C(time).alias("_t"), C(value).cast("double").alias("_v"))
    numbered = running_sums(x.withColumn("_one", F.lit(1).cast("long")), ["_key"], ["_t"], {"_i": "_one"})
    # prefix sums of a key by blocks of positions: short runs of rows, then the runs
    block = 4096
    w = Window.partitionBy("_key", "_b")
    cut = numbered.withColumn("_b", F.floor(C("_i") / block))
    runs = cut.groupBy("_key", "_b").agg(F.sum("_v").alias("_s"), F.count("*").alias("_c"))
    runs = runs.select("_key", "_b", F.coalesce(F.sum("_s").over(Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_before"))
    prefix = cut.withColumn("_own", F.sum("_v").over(w.orderBy("_i"))).join(runs, ["_key", "_b"]).select("_key", (C("_i") + 1).alias("_at"), (C("_before") + C("_own")).alias("_sum"))
    sizes = numbered.groupBy("_key").agg(F.count("*").alias("_n"))
    kind = rows.schema[key].dataType.simpleString()

    def blocks(batches):
        import hashlib

        import numpy as np
        import pandas as pd

        scale, shrink, numbers = float(1 << 52), math.log(1 - 1 / mean_block), []

        def tails(n):
            numbers.extend(b"%d" % j for j in range(len(numbers), n))
            return numbers[:n]

        for some in batches:
            out = [pd.DataFrame({"_key": [], "draw": [], "_at": [], "_sign": []})]
            for k, n, draw in zip(some["_key"], some["_n"], some["draw"], strict=True):
                most = 2 * -(-n // int(mean_block)) + 64
                name = f"{seed}:{k}:{draw}:".encode()
                digests = b"".join([hashlib.md5(name + tail).digest() for tail in tails(most)])
                u, v = ((np.frombuffer(digests, ">u8").reshape(-1, 2) >> 12) + 0.5).T / scale
                length = 1 + np.floor(np.log(u) / shrink).astype(np.int64)
                end = np.cumsum(length)
                end[-1] = max(end[-1], n)
                length = np.minimum(end, n) - np.minimum(np.concatenate([[0], end[:-1]]), n)
                start = np.floor(v * n).astype(np.int64)[length > 0]
                length = length[length > 0]
                over_ = start + length - n
                at = np.concatenate([np.minimum(start + length, n), start, over_[over_ > 0]])
                sign = np.concatenate([np.ones(len(start)), -np.ones(len(start)), np.ones((over_ > 0).sum())])
                out.append(pd.DataFrame({"_key": k, "draw": draw, "_at": at[at > 0], "_sign": sign[at > 0]}))
            yield pd.concat(out[1:] or out)

    spread = sizes.select("_key", "_n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    # a number of its own, as few small rows make much work and would be put into one task
    spread = spread.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_key", "draw")
    asked = spread.mapInPandas(blocks, f"_key {kind}, draw int, _at long, _sign double")
    prefix = F.broadcast(prefix) if numbered.count() <= BROADCAST_SUMS else prefix.hint("shuffle_hash")
    return asked.join(prefix, ["_key", "_at"]).groupBy("_key", "draw").agg(F.sum(C("_sign") * C("_sum")).alias("_total")).join(sizes, "_key").select(C("_key").alias(key), "draw", (C("_total") / C("_n")).alias("mean"))


def circular_shift(rows: DataFrame, value: str, shift: int, *, key: str = "symbol") -> DataFrame:
    """Placebo: each key's values moved round by ``shift`` places."""
    x = rows.withColumns({"_i": F.row_number().over(over(key)) - 1, "_n": F.count("*").over(Window.partitionBy(key))})
    moved = x.select(C(key), F.pmod(C("_i") + shift, C("_n")).cast("int").alias("_i"), C(value).alias("placebo"))
    return x.join(moved, [key, "_i"]).drop("_i", "_n")


def shuffled(rows: DataFrame, value: str, out: str = "placebo", *, key: str = "symbol", time: str = "t", seed: int = 42) -> DataFrame:
    """Placebo: each key's values in the order of a hash of key and time, so that every key keeps its values and loses their order.

    Both numberings, by time and by hash, are running sums over ranges, so no key is in one task. Times of a key are different.
    """
    x = rows.withColumns({"_one": F.lit(1).cast("long"), "_h": F.md5(F.concat_ws(":", F.lit(seed), C(key).cast("string"), C(time).cast("string")))})
    x = running_sums(running_sums(x, [key], [time], {"_i": "_one"}), [key], ["_h"], {"_j": "_one"})
    taken = x.select(C(key).alias("_key"), C("_j").alias("_at"), C(value).alias(out))
    return x.join(taken, C(key).eqNullSafe(C("_key")) & (C("_i") == C("_at"))).drop("_one", "_h", "_i", "_j", "_key", "_at")


def random_walk(rows: DataFrame, value: str, out: str = "placebo", *, key: str = "symbol", time: str = "t", seed: int = 42) -> DataFrame:
    """Placebo: a walk from each key's first value with normal log steps of the key's own deviation and no drift; normals by Box and Muller from hashes."""
    whole = Window.partitionBy(key)
    x = rows.withColumn("_s", F.log(C(value) / F.lag(value).over(over(key, time))))
    z = F.sqrt(-2 * F.log(uniform(F.lit(seed), C(key), C(time)))) * F.cos(2 * math.pi * uniform(F.lit(seed + 1), C(key), C(time)))
    x = x.withColumns({"_sd": F.stddev_pop("_s").over(whole), "_first": F.min(F.struct(C(time), C(value))).over(whole)[value]})
    step = F.when(C("_s").isNotNull(), C("_sd") * z).otherwise(0.0)
    path = F.sum(step).over(over(key, time).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn(out, C("_first") * F.exp(path)).drop("_s", "_sd", "_first")


def variance_ratio(rows: DataFrame, value: str, q: int, *, key: str = "symbol") -> DataFrame:
    w = over(key).rowsBetween(0, q - 1)
    x = rows.withColumn("_s", F.when(F.count(value).over(w) == q, F.sum(value).over(w)))
    return x.groupBy(key).agg((F.var_pop("_s") / F.nullif(q * F.var_pop(value), F.lit(0.0))).alias("ratio"))


def fourier_residues(rows: DataFrame, k: int, m: int, a: float = 1.0, *, key: str = "symbol") -> DataFrame:
    """Mean cosine and sine of 2 pi a ((s_t - s_{t+m}) mod k) / k over a column state, by key and magnitude bucket."""
    angle = 2 * math.pi * a * F.pmod(C("state") - F.lead("state", m).over(over(key)), F.lit(k)) / k
    return rows.withColumn("_a", angle).groupBy(key, "bucket").agg(F.avg(F.cos("_a")).alias("c"), F.avg(F.sin("_a")).alias("s"), F.count("_a").alias("n"))
