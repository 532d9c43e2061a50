"""Ranks over all rows and order statistics of growing histories, without a key or the whole table in one task.

A running sum in some order is made in two passes: rows are partitioned by ranges of (key, order), each partition adds up what
it has, the few sums by partition and key are added along, and the rows get what lies before them.

Ranks and quantiles of all history up to each row work on two numberings of a key's rows, by time and by value, both cut into
blocks of BLOCK: a grid of time blocks by value blocks, the two upper levels of a wavelet matrix. How many earlier rows have smaller
values is the sum of the grid left and below, and of two parts that lie in one time block or one value block. For the k-th
smallest, the value block comes from the grid's column sums and the value from that block. So no task holds more than a
block and a row of the grid, whatever a key has; the grid has (rows of the key / BLOCK)^2 cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.stores import scratch

C = F.col
BLOCK = 2048


def saved(df: DataFrame) -> DataFrame:
    """df cut off from its lineage by a checkpoint in the shared folder; partitions and their order stay."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def running_sums(rows: DataFrame, part: list[str], order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """rows with, for each ``sums`` (new column: long column to add), what lies before the row in its key; rows with equal order stand in any order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*part, *order]
    ranged = saved(rows.repartitionByRange(n, *columns).sortWithinPartitions(*columns).withColumn("_p", F.spark_partition_id()))
    by = ranged.groupBy("_p", *part).agg(*[F.sum(v).alias(f"_s_{k}") for k, v in sums.items()])
    # one row for each partition and key that it has
    w = Window.partitionBy(*part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = by.select("_p", *[C(c).alias(f"_k{i}") for i, c in enumerate(part)], *[F.coalesce(F.sum(f"_s_{k}").over(w), F.lit(0)).alias(f"_b_{k}") for k in sums])
    names = list(sums)
    schema = StructType([*ranged.schema.fields, *[StructField(f"_l_{k}", before.schema[f"_b_{k}"].dataType) for k in names]])

    def local(batches):
        at, held = None, [0] * len(names)
        for some in batches:
            if not len(some):
                continue
            keys = pd.MultiIndex.from_frame(some[part]) if part else None
            codes = np.zeros(len(some), np.int64) if keys is None else pd.factorize(keys)[0]
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            first = None if keys is None else keys[0]
            for i, k in enumerate(names):
                v = some[sums[k]].to_numpy(np.int64)
                total = np.cumsum(v)
                base = np.repeat(total[starts] - v[starts], np.diff(np.append(starts, len(v))))
                own = total - v - base
                if at is not None and (at[0] == first or at[0] is None and first is None):
                    own[: starts[1] if len(starts) > 1 else len(v)] += held[i]
                some[f"_l_{k}"] = own
                held[i] = int(own[-1] + v[-1])
            at = (None if keys is None else keys[-1],)
            yield some

    both = ranged.mapInPandas(local, schema)
    same = C("_p") == C("_q")
    for i, c in enumerate(part):
        same = same & C(c).eqNullSafe(C(f"_k{i}"))
    return both.join(before.withColumnRenamed("_p", "_q"), same).select(*rows.columns, *[(C(f"_l_{k}") + C(f"_b_{k}")).alias(k) for k in names])


def ranked_values(rows: DataFrame, part: list[str], value: str) -> DataFrame:
    """(part..., value, _n, _below): how often each value occurs and how many rows of the key have smaller ones; nulls aren't ranked."""
    by = rows.where(C(value).isNotNull()).groupBy(*part, value).agg(F.count("*").alias("_n"))
    return running_sums(by, part, [value], {"_below": "_n"})


def average_ranks(rows: DataFrame, values: list[str], part: list[str] = ()) -> DataFrame:
    """rows with rank_<value> for each value: from 1, ties share their mean rank; counted by value first, so nothing runs over all rows in one task."""
    part = list(part)
    for v in values:
        table = ranked_values(rows, part, v).select(*[C(c).alias(f"_j{i}") for i, c in enumerate(part)], C(v).alias("_v"), (C("_below") + (C("_n") + 1) / 2).alias(f"rank_{v}"))
        same = C(v) == C("_v")
        for i, c in enumerate(part):
            same = same & C(c).eqNullSafe(C(f"_j{i}"))
        rows = rows.join(table, same, "left").drop("_v", *[f"_j{i}" for i in range(len(part))])
    return rows


def _grid(rows: DataFrame, value: str, key: str, time: str, block: int) -> tuple[DataFrame, DataFrame]:
    """(key, _i, _v, _rv, _tb, _vb, _equal) of the rows with a value, numbered by time and by (value, time), and (key, _tb, _base):
    how many rows of earlier time blocks each value block has. _equal counts the rows so far with the same value, the row included."""
    x = rows.where(C(value).isNotNull()).select(C(key).alias("_key"), C(time).alias("_t"), C(value).cast("double").alias("_v"), F.lit(1).cast("long").alias("_one"))
    x = running_sums(x, ["_key"], ["_t"], {"_i": "_one"})
    x = running_sums(x, ["_key"], ["_v", "_i"], {"_rv": "_one"})
    first = x.groupBy("_key", "_v").agg(F.min("_rv").alias("_r0"))
    x = x.join(first, ["_key", "_v"]).select("_key", "_t", "_v", "_i", "_rv", F.floor(C("_i") / block).alias("_tb"), F.floor(C("_rv") / block).alias("_vb"), (C("_rv") - C("_r0") + 1).alias("_equal"))
    x = saved(x)
    cells = x.groupBy("_key", "_tb", "_vb").agg(F.count("*").alias("_c"))
    sides = cells.groupBy("_key").agg(F.max("_tb").alias("_m"))
    every = sides.select("_key", F.explode(F.sequence(F.lit(0).cast("long"), "_m")).alias("_tb"), "_m").select("_key", "_tb", F.explode(F.sequence(F.lit(0).cast("long"), "_m")).alias("_vb"))
    filled = every.join(cells, ["_key", "_tb", "_vb"], "left")
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("_key", "_vb").orderBy("_tb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = filled.select("_key", "_tb", F.struct("_vb", before.alias("c")).alias("_x")).groupBy("_key", "_tb").agg(F.transform(F.array_sort(F.collect_list("_x")), lambda z: z["c"]).alias("_base"))
    return x, base


def _smaller_before(order: np.ndarray, value: np.ndarray, step: int = 256) -> np.ndarray:
    """For each i how many j have order[j] < order[i] and value[j] < value[i]."""
    out = np.empty(len(order), np.int64)
    for k in range(0, len(order), step):
        cut = slice(k, k + step)
        out[cut] = ((order[None, :] < order[cut, None]) & (value[None, :] < value[cut, None])).sum(axis=1)
    return out


def expanding_rank(rows: DataFrame, value: str, key: str = "symbol", time: str = "t", block: int = BLOCK) -> DataFrame:
    """rows with expanding_rank, the share of the history (the row included) at or below the row's value, and expanding_mid_rank, (below + equal / 2) / n.

    Times of a key are different; rows without a value get null and don't count.
    """
    x, base = _grid(rows, value, key, time, block)
    schema = f"_key {rows.schema[key].dataType.simpleString()}, _i long, _le long"

    def in_time(batches):
        for some in batches:
            out = [pd.DataFrame({"_key": [], "_i": [], "_le": []})]
            for k, i, rv, count in zip(some["_key"], some["i"], some["rv"], some["base"], strict=True):
                i, rv = np.array(i, np.int64), np.array(rv, np.int64)
                below = np.concatenate([[0], np.cumsum(np.array(count, np.int64))])
                out.append(pd.DataFrame({"_key": k, "_i": i, "_le": _smaller_before(i, rv) + below[rv // block]}))
            yield pd.concat(out[1:] or out)

    def in_value(batches):
        for some in batches:
            out = [pd.DataFrame({"_key": [], "_i": [], "_le": []})]
            for k, i, rv in zip(some["_key"], some["i"], some["rv"], strict=True):
                i = np.array(i, np.int64)
                out.append(pd.DataFrame({"_key": k, "_i": i, "_le": _smaller_before(i // block, np.array(rv, np.int64))}))
            yield pd.concat(out[1:] or out)

    lists = [F.collect_list("_i").alias("i"), F.collect_list("_rv").alias("rv")]  # at most a block each
    timed = x.groupBy("_key", "_tb").agg(*lists).join(base, ["_key", "_tb"]).select("_key", "i", "rv", C("_base").alias("base"))
    valued = x.groupBy("_key", "_vb").agg(*lists).select("_key", "i", "rv")
    got = timed.mapInPandas(in_time, schema).unionByName(valued.mapInPandas(in_value, schema))
    counts = got.groupBy("_key", "_i").agg((F.sum("_le") + 1).alias("_le"))
    found = x.join(counts, ["_key", "_i"]).select("_key", "_t", (C("_le") / (C("_i") + 1)).alias("expanding_rank"), ((C("_le") - C("_equal") / 2) / (C("_i") + 1)).alias("expanding_mid_rank"))
    return rows.join(found, (C(key) == C("_key")) & (C(time) == C("_t")), "left").drop("_key", "_t")


def expanding_quantile(rows: DataFrame, value: str, q: float, out: str, key: str = "symbol", time: str = "t", *, shift: int = 0, block: int = BLOCK) -> DataFrame:
    """rows with the linearly interpolated q-quantile of the key's values up to the row, or up to ``shift`` rows with a value before it; null where there is none.

    Times of a key are different. Rows without a value get null.
    """
    x, base = _grid(rows, value, key, time, block)
    kind = rows.schema[key].dataType.simpleString()
    blocks = x.groupBy("_key", "_tb").agg(F.sort_array(F.collect_list(F.struct("_i", "_vb"))).alias("xs")).join(base, ["_key", "_tb"]).select("_key", "_tb", F.transform("xs", lambda z: z["_i"]).alias("i"), F.transform("xs", lambda z: z["_vb"]).alias("vb"), C("_base").alias("base"))

    def places(batches, step=512):
        """(key, value block, time block, row, part, rank in the block among the rows so far) of the two order statistics each row asks for."""
        for some in batches:
            out_ = []
            for k, tb, i, vb, count in zip(some["_key"], some["_tb"], some["i"], some["vb"], some["base"], strict=True):
                i, vb, count = np.array(i, np.int64), np.array(vb, np.int64), np.array(count, np.int64)
                for a in range(0, len(i), step):
                    own = np.zeros((len(i[a : a + step]), len(count)), np.int64)
                    own[np.arange(len(own)), vb[a : a + step]] = 1
                    total = np.cumsum(np.cumsum(own, axis=0) + count, axis=1)
                    count = count + own.sum(axis=0)
                    h = q * i[a : a + step]
                    for part, rank in ((0, np.floor(h).astype(np.int64)), (1, np.ceil(h).astype(np.int64))):
                        at = (total > rank[:, None]).argmax(axis=1)
                        less = np.where(at > 0, total[np.arange(len(at)), np.maximum(at - 1, 0)], 0)
                        out_.append(pd.DataFrame({"_key": k, "_vb": at, "_tb": tb, "_i": i[a : a + step], "_part": part, "_r": rank - less}))
            yield pd.concat(out_) if out_ else pd.DataFrame({"_key": [], "_vb": [], "_tb": [], "_i": [], "_part": [], "_r": []})

    asked = blocks.mapInPandas(places, f"_key {kind}, _vb long, _tb long, _i long, _part int, _r long")
    asked = asked.groupBy("_key", "_vb", "_tb").agg(F.collect_list("_i").alias("i"), F.collect_list("_part").alias("part"), F.collect_list("_r").alias("r"))  # two blocks at most
    values = x.groupBy("_key", "_vb").agg(F.sort_array(F.collect_list(F.struct("_rv", "_i", "_v"))).alias("xs")).select("_key", "_vb", F.transform("xs", lambda z: z["_i"]).alias("bi"), F.transform("xs", lambda z: z["_v"]).alias("bv"))

    def picked(batches, step=256):
        for some in batches:
            out_ = []
            for k, i, part, r, bi, bv in zip(some["_key"], some["i"], some["part"], some["r"], some["bi"], some["bv"], strict=True):
                i, part, r, bi, bv = np.array(i, np.int64), np.array(part), np.array(r, np.int64), np.array(bi, np.int64), np.array(bv)
                v = np.empty(len(i))
                for a in range(0, len(i), step):
                    cut = slice(a, a + step)
                    v[cut] = bv[(np.cumsum(bi[None, :] <= i[cut, None], axis=1) > r[cut, None]).argmax(axis=1)]
                out_.append(pd.DataFrame({"_key": k, "_i": i, "_part": part, "v": v}))
            yield pd.concat(out_) if out_ else pd.DataFrame({"_key": [], "_i": [], "_part": [], "v": []})

    got = asked.join(values, ["_key", "_vb"]).select("_key", "i", "part", "r", "bi", "bv").mapInPandas(picked, f"_key {kind}, _i long, _part int, v double")
    both = got.groupBy("_key", "_i").agg(F.max(F.when(C("_part") == 0, C("v"))).alias("lo"), F.max(F.when(C("_part") == 1, C("v"))).alias("hi"))
    h = F.lit(q) * C("_i")
    both = both.select("_key", (C("_i") + shift).alias("_i"), (C("lo") + (C("hi") - C("lo")) * (h - F.floor(h))).alias(out))
    found = x.select("_key", "_t", "_i").join(both, ["_key", "_i"]).select("_key", "_t", out)
    return rows.join(found, (C(key) == C("_key")) & (C(time) == C("_t")), "left").drop("_key", "_t")
