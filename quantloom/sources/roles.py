"""The given tables in the roles of market data: ticks, bars, settlements, ledgers, grids, slices, run events.

Times are long milliseconds (ticks: microseconds) since 1970 in UTC, whatever the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_MS, DAY_MS = 3_600_000, 86_400_000
#: How much slippage a tick is worth, and the taker fee, in the INSTRUMENT role.
TICK_SIZE, TAKER_FEE = 0.01, 0.0005


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: str, unit: str = "MILLISECOND") -> Column:
    return F.expr(f"timestampdiff({unit}, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), epoch("ts", "MICROSECOND").alias("us"), F.col("event_id").alias("seq"),
        (F.col("value") + 100).alias("price"), F.lit(1.0).alias("qty"), "user_id", "props",
    )


def bars_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.bars import bars_from_ticks

    return bars_from_ticks(ticks(spark, sf_dir), HOUR_MS)


def bars_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    by = F.struct("o_orderkey", "o_totalprice")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), epoch("o_orderdate").alias("t")).agg(
        F.min(by)["o_totalprice"].alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max(by)["o_totalprice"].alias("close"), F.count("*").cast("double").alias("volume"),
    )


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderpriority").alias("symbol"), (epoch("l_shipdate") + F.col("l_linenumber") * HOUR_MS).alias("st"),
        ((F.col("l_discount") - 0.05) / 100).alias("rate"), F.col("l_extendedprice").alias("mark"),
        F.when(F.col("l_returnflag") == "R", "modeled").otherwise("official").alias("status"),
        "l_orderkey", "l_linenumber",
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("episode"), F.col("l_linenumber").cast("long").alias("level"), F.col("l_quantity").alias("qty"),
        (x / F.col("l_quantity")).alias("price"), (x * F.col("l_tax")).alias("fee"), (x * F.col("l_discount")).alias("funding"), x.alias("amount"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = fills(spark, sf_dir).groupBy("episode").agg(F.sum("amount").alias("amount"), F.sum("fee").alias("fees"), F.sum("funding").alias("funding"), F.count("*").alias("n_fills"))
    return read(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("episode")).select(
        "episode", F.col("o_orderpriority").alias("symbol"), epoch("o_orderdate").alias("t"), (F.col("o_totalprice") - F.col("amount")).alias("gross"),
        "fees", "funding", "n_fills", F.col("o_orderstatus").alias("exit_reason"), "amount",
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each cohort, axis cell and scenario grid; net_pnl, sharpe and episodes from the lines of the cell."""
    lines, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    net = F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))
    cells = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("cohort"), F.col("p_size").cast("long").alias("size"), F.col("p_type").alias("kind"), F.col("l_returnflag").alias("grid"))
    out = cells.agg(F.sum(net).alias("net_pnl"), F.avg(net).alias("mean"), F.stddev_samp(net).alias("sd"), F.count("*").alias("episodes"))
    return out.select("cohort", "size", "kind", "grid", "net_pnl", F.when(F.col("sd") > 0, F.col("mean") / F.col("sd")).otherwise(0.0).alias("sharpe"), "episodes")


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("survivor"), F.col("o_orderkey").alias("slice"), epoch("o_orderdate").alias("start"), (epoch("o_orderdate") + DAY_MS).alias("end"),
        (F.col("o_totalprice") - 150000).alias("pnl"), (F.col("o_orderkey") % 7).alias("n_episodes"), (F.col("o_totalprice") / 100000 - 1).alias("sharpe"),
    )


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.expr("case event_type when 'signup' then 'started' when 'purchase' then 'done' when 'error' then 'failed' else 'running' end")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("run"), state.alias("state"), epoch("ts").alias("t"), F.col("event_id").alias("ordinal"), F.col("value").alias("value"))


#: The same roles as SQL common table expressions.
SQL = {
    "ticks": "ticks AS (SELECT event_type AS symbol, epoch_us(ts) AS us, event_id AS seq, value + 100 AS price, 1.0::DOUBLE AS qty, user_id, props FROM events)",
    "bars": "bars AS (SELECT symbol, (us // 3600000000) * 3600000 AS t, first(price ORDER BY us, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY us, seq) AS close, sum(qty) AS volume FROM ticks GROUP BY ALL)",
    "daily": "daily AS (SELECT o_orderpriority AS symbol, epoch_ms(o_orderdate) AS t, first(o_totalprice ORDER BY o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY ALL)",
    "settlements": "settlements AS (SELECT o_orderpriority AS symbol, epoch_ms(l_shipdate) + l_linenumber * 3600000 AS st, (l_discount - 0.05) / 100 AS rate, l_extendedprice AS mark, CASE WHEN l_returnflag = 'R' THEN 'modeled' ELSE 'official' END AS status, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "fills": "fills AS (SELECT l_orderkey AS episode, l_linenumber::BIGINT AS level, l_quantity AS qty, l_extendedprice / l_quantity AS price, l_extendedprice * l_tax AS fee, l_extendedprice * l_discount AS funding, l_extendedprice AS amount FROM lineitem)",
    "episodes": "episodes AS (SELECT s.episode, o_orderpriority AS symbol, epoch_ms(o_orderdate) AS t, o_totalprice - s.amount AS gross, s.fees, s.funding, s.n_fills, o_orderstatus AS exit_reason, s.amount FROM orders JOIN (SELECT episode, sum(amount) AS amount, sum(fee) AS fees, sum(funding) AS funding, count(*) AS n_fills FROM fills GROUP BY 1) s ON o_orderkey = s.episode)",
    "grid": "grid AS (SELECT cohort, size, kind, grid, net_pnl, CASE WHEN sd > 0 THEN mean / sd ELSE 0.0 END AS sharpe, episodes FROM (SELECT p_brand AS cohort, p_size::BIGINT AS size, p_type AS kind, l_returnflag AS grid, sum(l_extendedprice * (l_discount - l_tax)) AS net_pnl, avg(l_extendedprice * (l_discount - l_tax)) AS mean, stddev_samp(l_extendedprice * (l_discount - l_tax)) AS sd, count(*) AS episodes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL))",
    "slices": "slices AS (SELECT o_custkey AS survivor, o_orderkey AS slice, epoch_ms(o_orderdate) AS start, epoch_ms(o_orderdate) + 86400000 AS \"end\", o_totalprice - 150000 AS pnl, o_orderkey % 7 AS n_episodes, o_totalprice / 100000 - 1 AS sharpe FROM orders)",
    "runs": "runs AS (SELECT user_id AS run, CASE event_type WHEN 'signup' THEN 'started' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'running' END AS state, epoch_us(ts) // 1000 AS t, event_id AS ordinal, value FROM events)",
}
_NEEDS = {"bars": ("ticks",), "episodes": ("fills",)}


def with_roles(*names: str) -> str:
    """A WITH clause that defines the roles (and what they need)."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*_NEEDS.get(n, ()), n) if x not in order]
    return "WITH " + ", ".join(SQL[n] for n in order) + " "
