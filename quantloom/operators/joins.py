"""Time joins: as-of, containing interval, next executable bar, pairs, cells and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.roles import DAY_MS
from .orderstats import saved

C = F.col


def asof(left: DataFrame, right: DataFrame, *, key: str, left_time: str, right_time: str, values: list[str], strict: bool = False, max_age: int | None = None, block: int = DAY_MS) -> DataFrame:
    """Left rows with the values of the last right row at or before them (strictly before with ``strict``), at most ``max_age`` old.

    Both sides are united, and sorted by time within blocks of ``block`` units of time of a key; the last right row is carried
    along, so neither side is multiplied. What earlier blocks leave comes first in a block: their last right rows are put in
    order by key, one row a block. At equal times right rows come first, or last where the match is strict. Both sides are saved once.
    """
    side = 1 if strict else 0
    mine = F.struct(*[C(c) for c in left.columns])
    theirs = F.struct(C(right_time).alias("_at"), *[C(v) for v in values])
    a = left.select(C(key).alias("_k"), C(left_time).alias("_t"), F.lit(1 - side).alias("_side"), mine.alias("_mine"))
    b = right.where(C(key).isNotNull() & C(right_time).isNotNull()).select(C(key).alias("_k"), C(right_time).alias("_t"), F.lit(side).alias("_side"), theirs.alias("_theirs"))
    both = saved(a.unionByName(b, allowMissingColumns=True).withColumn("_block", F.floor(C("_t") / block)))
    before = Window.partitionBy("_k").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = both.where("_block is not null").groupBy("_k", "_block").agg(F.max("_theirs").alias("_top"))
    first = blocks.select("_k", "_block", F.last("_top", ignorenulls=True).over(before).alias("_theirs")).where("_theirs is not null")
    w = Window.partitionBy("_k", "_block").orderBy(C("_t").asc_nulls_first(), "_side", C("_theirs")).rowsBetween(Window.unboundedPreceding, 0)
    got = both.unionByName(first, allowMissingColumns=True).withColumn("_last", F.last("_theirs", ignorenulls=True).over(w)).where(C("_mine").isNotNull())
    fresh = F.lit(True) if max_age is None else C("_t") - C("_last._at") <= max_age
    return got.select("_mine.*", *[F.when(fresh, C(f"_last.{v}")).alias(v) for v in values], F.when(fresh, C("_last._at")).alias("matched_at"))


def next_row(left: DataFrame, right: DataFrame, *, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """Left rows with the first right row strictly after them; the as-of join on reversed time."""
    a = left.withColumn("_neg", -C(left_time))
    b = right.withColumn("_neg_r", -C(right_time))
    out = asof(a, b, key=key, left_time="_neg", right_time="_neg_r", values=[*values, right_time], strict=True)
    return out.drop("_neg", "matched_at").withColumnRenamed(right_time, "next_at")


def contain(events: DataFrame, time: str, step_ms: int) -> Column:
    """The open of the regular bar that holds an event's time: an equi-join key in place of a range join."""
    return (F.floor(C(time) / step_ms) * step_ms).cast("long")


def symbol_pairs(rows: DataFrame, value: str, *, key: str = "symbol") -> DataFrame:
    """(a, b, t, ra, rb) for all pairs a < b of keys at equal times."""
    a = rows.select(C(key).alias("a"), "t", C(value).alias("ra"))
    b = rows.select(C(key).alias("b"), C("t").alias("_t"), C(value).alias("rb"))
    return a.join(b, (C("t") == C("_t")) & (C("a") < C("b"))).drop("_t")


def exactly_one(left: DataFrame, right: DataFrame, axes: list[str]) -> DataFrame:
    """Left rows with the number of right rows of their cell; anything but 1 is a fault to report."""
    n = right.groupBy(*axes).agg(F.count("*").alias("hits"))
    return left.join(n, axes, "left").fillna(0, ["hits"])


def face_neighbours(cells: DataFrame, axes: list[str], fixed: list[str]) -> DataFrame:
    """Pairs of cells that differ by one position on one axis and agree on all else.

    Each cell is put out once for each axis and step, keyed by the positions that the neighbour must have, so the
    join is on equality alone.
    """
    placed = cells
    for a in axes:
        order = cells.select(a).distinct().withColumn(f"_{a}", F.dense_rank().over(Window.orderBy(a)))
        placed = placed.join(F.broadcast(order), a)
    moves = F.array(*[F.struct(*[(C(f"_{x}") + (step if x == a else 0)).alias(f"_{x}") for x in axes]) for a in axes for step in (-1, 1)])
    asking = placed.withColumn("_to", F.explode(moves)).select(*[c for c in cells.columns], *[C(f"_to._{a}").alias(f"_{a}") for a in axes])
    other = placed.select(*fixed, *[f"_{a}" for a in axes], *[C(c).alias(f"n_{c}") for c in cells.columns if c not in fixed])
    return asking.join(other, [*fixed, *[f"_{a}" for a in axes]]).drop(*[f"_{a}" for a in axes])
