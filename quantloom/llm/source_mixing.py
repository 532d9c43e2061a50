"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source gets a repetition rate: its target weight times the rows wanted, over its own rows. Each row's count is the
inverse of the Poisson distribution with that mean at a uniform number made from the row's key by MD5, so the
same row gets the same count in every run and on every engine. Means above 16 are summed from equal parts of at most
16, each with a number of its own. Rows are exploded by their counts and sorted by a hash of key and copy, which
is a global shuffle.

Defined results: rows without source form a source of their own; rows without key share one uniform number. Repeated
rows get equal counts. Sources without weight get rate 0 when weights are given. An empty table stays empty.
Columns named copy, rate or shuffle_key in the input are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import computed_once, row_mark, saved

#: Rows of the table of sources up to which it is broadcast; beyond, rows meet their source in a shuffle join.
BROADCAST_SOURCES = 10_000
PART_MEAN = 16.0
#: Beyond this count the Poisson distribution of mean 16 has less than 2^-53 left.
MOST = 80


def uniform(*parts) -> F.Column:
    """A number in (0, 1) with 52 random bits from the MD5 of the parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, *, source: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, rows, rate): rate = weight * epochs * all rows / rows; weights go by rows to ``power`` unless given."""
    counted = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        counted = counted.withColumn("weight", F.pow("rows", F.lit(power)))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        counted = counted.withColumn("weight", F.coalesce(given[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0))
    totals = counted.agg(F.sum("weight").alias("w"), F.sum("rows").alias("n")).first()
    if not totals["w"]:
        return counted.select("source", "rows", F.lit(0.0).alias("rate"))
    return counted.select("source", "rows", (F.col("weight") / F.lit(float(totals["w"])) * F.lit(float(epochs)) * F.lit(int(totals["n"])) / F.col("rows")).alias("rate"))


def poisson_table(rates: DataFrame) -> DataFrame:
    """Adds parts and the distribution function of a part, up to where it reaches 1, to each rate."""
    mean = F.col("rate") / F.col("parts")
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(MOST)),
        F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.array(F.exp(-mean)).alias("all")),
        lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"), F.concat(s["all"], F.array(s["c"] + s["p"] * mean / k)).alias("all")),
        lambda s: s["all"],
    )
    out = rates.withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int"))
    return out.withColumn("below", F.array_distinct(F.filter(steps, lambda c: c < 1.0)))


def replicate(docs: DataFrame, *, key: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, power: float = 0.5, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """docs with rate, copy (from 1) and shuffle_key, repeated by their counts, in the order of shuffle_key."""
    docs = docs.drop("copy", "rate", "shuffle_key")
    rates = saved(poisson_table(source_rates(docs, source=source, weights=weights, power=power, epochs=epochs)))
    small = rates.count() <= BROADCAST_SOURCES
    rates = rates.select(F.col("source").alias("_source"), "rate", "parts", "below")
    joined = docs.join(F.broadcast(rates) if small else rates, docs[source].eqNullSafe(F.col("_source")))
    at = lambda j: uniform(F.col(key), F.lit(seed), j)
    one = lambda u: F.size(F.filter("below", lambda c: c <= u))
    first = computed_once(at(F.lit(0)))
    joined = joined.withColumn("_u", first)
    rest = F.aggregate(F.sequence(F.lit(1), F.col("parts") - 1), F.lit(0), lambda n, j: n + one(at(j)))
    counted = joined.withColumn("_count", computed_once(one(F.col("_u")) + F.when(F.col("parts") > 1, rest).otherwise(F.lit(0))))
    copies = counted.where("_count > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    return copies.select(*docs.columns, "rate", "copy", shuffle_key(key, seed).alias("shuffle_key")).orderBy("shuffle_key", key)


def shuffle_key(key: str, seed: int = 42) -> F.Column:
    return F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("copy").cast("string"), F.lit(str(seed))))


def mixed_order(docs: DataFrame, *, key: str = "doc_id", seed: int = 42, out: str = "shuffle_key") -> DataFrame:
    """Replicated rows with their shuffle key, made again from the rows alone: equal rows are numbered as copies, so neither files nor cores decide the order."""
    same = Window.partitionBy(row_mark(*docs.columns), key).orderBy(key)
    return docs.withColumn("copy", F.row_number().over(same)).withColumn(out, shuffle_key(key, seed)).drop(*({"copy"} - set(docs.columns)))
