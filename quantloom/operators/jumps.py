"""Rules that go from row to row of a key by jumps: each row names a later row, and the rows reached from the first one are wanted.

Rows of a key are numbered by ranges and cut into blocks of 64. Inside a block every row is followed to where it leaves the
block; only rows that some row lands on are kept, and pointers among these are doubled until all of a key's chain is
known (log2 of its blocks rounds, each saved). Then each block is walked from the one row at which it is entered. No
more than a block is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import over
from .orderstats import running_sums, saved

C = F.col
BLOCK = 64


def numbered(rows: DataFrame, order: list[str], *, key: str = "symbol") -> DataFrame:
    """rows with _i, their number in the key from 0; rows that are equal in ``order`` are numbered in any order, but only once."""
    return running_sums(rows.withColumn("_one", F.lit(1).cast("long")), [key], order, {"_i": "_one"}).drop("_one")


def _blocks(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    return rows.groupBy(key, F.floor(C("_i") / BLOCK).alias("_b")).agg(F.array_sort(F.collect_list(F.struct("_i", *columns))).alias("_xs"))


def chain(nodes: DataFrame, *, key: str = "symbol") -> DataFrame:
    """(key, _i) of the rows reached from row 0 of their key; nodes are (key, _i, _next) with _i from 0 without holes, and _next larger than _i or null."""
    blocks = saved(_blocks(nodes.select(key, C("_i").cast("long").alias("_i"), C("_next").cast("long").alias("_next")), key, "_next"))
    leaves = lambda s, x: F.when(F.floor(x["_next"] / BLOCK) > F.floor(x["_i"] / BLOCK), x["_next"]).otherwise(F.get(s, (x["_next"] - x["_i"] - 1).cast("int")))
    exits = F.aggregate(F.reverse("_xs"), F.array().cast("array<bigint>"), lambda s, x: F.concat(F.array(leaves(s, x)), s))
    out = blocks.select(key, "_b", F.explode(F.arrays_zip("_xs", exits.alias("_to"))).alias("_z")).select(key, C("_z._xs._i").alias("_i"), C("_z._to").alias("_to")).where("_to is not null")
    landings = out.select(key, C("_to").alias("_i")).unionByName(out.where("_i < 64").select(key, F.lit(0).cast("long").alias("_i"))).distinct()
    jumps = saved(out.join(landings, [key, "_i"], "left_semi"))
    reached = blocks.where("_b = 0").select(key, F.lit(0).cast("long").alias("_i"))
    while True:
        more = saved(reached.join(jumps, [key, "_i"]).select(key, C("_to").alias("_i")))
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
        jumps = saved(jumps.join(jumps.select(key, C("_i").alias("_to"), C("_to").alias("_far")), [key, "_to"]).select(key, "_i", C("_far").alias("_to")))
    entered = reached.select(key, F.floor(C("_i") / BLOCK).alias("_b"), C("_i").alias("_in"))
    walk = F.aggregate(
        "_xs", F.struct(C("_in").alias("want"), F.array().cast("array<bigint>").alias("on")),
        lambda s, x: F.when(x["_i"] == s["want"], F.struct(x["_next"].alias("want"), F.concat(s["on"], F.array(x["_i"])).alias("on"))).otherwise(s), lambda s: s["on"],
    )
    return blocks.join(entered, [key, "_b"]).select(key, F.explode(walk).alias("_i"))


def first_at_or_after(rows: DataFrame, at: str, wanted: str, equal: Column, *, key: str = "symbol") -> DataFrame:
    """rows (numbered by _i in the order of ``at``) with _next: the first later row of the key whose ``at`` is past ``wanted``, or equal to it where ``equal`` holds."""
    ask = rows.select(key, C(wanted).alias("_at"), F.when(equal, 2).otherwise(0).alias("_o"), "_i").where("_at is not null")
    have = rows.select(key, C(at).alias("_at"), F.lit(1).alias("_o"), "_i")
    w = Window.partitionBy(key).orderBy(C("_at").desc(), "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = have.unionByName(ask).withColumn("_f", F.min(F.when(C("_o") == 1, C("_i"))).over(w)).where("_o <> 1 and _f is not null")
    return rows.join(found.select(key, "_i", F.greatest("_f", C("_i") + 1).alias("_next")), [key, "_i"], "left")


def first_outside(rows: DataFrame, value: str, band: float, *, key: str = "symbol") -> DataFrame:
    """(key, _i, _next): the first later row whose value is more than ``band`` from the row's own, by a tree of least and largest values.

    A row looks through the rest of its block, then through the later blocks of its group of 64 blocks, and so on upwards, and goes down again
    where something lies outside; so a row takes a few joins with 64 entries, whatever the distance. Null values are never outside, and have no next.
    """
    at = rows.select(key, C("_i").cast("long").alias("_i"), C(value).cast("double").alias("_v"))
    level, trees = at.select(key, C("_i").alias("_c"), C("_v").alias("lo"), C("_v").alias("hi")), []
    n = (at.agg(F.max("_i")).first()[0] or 0) + 1
    while True:
        group = level.groupBy(key, F.floor(C("_c") / BLOCK).alias("_g")).agg(F.array_sort(F.collect_list(F.struct("_c", "lo", "hi"))).alias("_xs"))
        trees.append(saved(group))
        if n <= BLOCK:
            break
        n = -(-n // BLOCK)
        level = trees[-1].select(key, C("_g").alias("_c"), F.array_min("_xs.lo").alias("lo"), F.array_max("_xs.hi").alias("hi"))
    outside = lambda x: (x["hi"] - C("_v") > band) | (C("_v") - x["lo"] > band)
    pending, found = at.where("_v is not null").withColumn("_at", C("_i")), []
    for tree in trees:
        seen = pending.withColumn("_g", F.floor(C("_at") / BLOCK)).join(tree, [key, "_g"])
        # the hit first: within one select a lambda would read the new _at
        seen = seen.withColumn("_hit", F.get(F.filter("_xs", lambda x: (x["_c"] > C("_at")) & outside(x)), F.lit(0))["_c"])
        seen = saved(seen.select(key, "_i", "_v", C("_g").alias("_at"), "_hit"))
        found.append(seen.where("_hit is not null").select(key, "_i", "_v", "_hit"))
        pending = seen.where("_hit is null").drop("_hit")
    down = found[-1]
    for tree, also in zip(trees[-2::-1], found[-2::-1], strict=True):
        inner = down.withColumnRenamed("_hit", "_g").join(tree, [key, "_g"]).select(key, "_i", "_v", F.get(F.filter("_xs", outside), F.lit(0))["_c"].alias("_hit"))
        down = also.unionByName(inner)
    return at.select(key, "_i").join(down.select(key, "_i", C("_hit").alias("_next")), [key, "_i"], "left")


def held_through(rows: DataFrame, value: str, band: float, start: float, out: str, *, key: str = "symbol", order: list[str]) -> DataFrame:
    """rows with ``out``, which is ``start`` at first and moves to a row's value where that is more than ``band`` away."""
    x = numbered(rows, order, key=key).withColumn("_i", C("_i") + 1)
    first = x.select(key).distinct().select(key, F.lit(0).cast("long").alias("_i"), F.lit(float(start)).alias("_v"))
    nodes = saved(first.unionByName(x.select(key, "_i", C(value).cast("double").alias("_v"))))
    moves = chain(first_outside(nodes, "_v", band, key=key), key=key).withColumn("_on", F.lit(True))
    w = over(key, "_i").rowsBetween(Window.unboundedPreceding, 0)
    return x.join(moves, [key, "_i"], "left").withColumn(out, F.coalesce(F.last(F.when(C("_on"), C(value).cast("double")), ignorenulls=True).over(w), F.lit(float(start)))).drop("_i", "_on")
