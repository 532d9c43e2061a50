"""Streaming queries over parts of events, checked against the batch form of the same operator.

Events are written in four parts by time and streamed one part for each trigger; a closing row far ahead moves the watermark
past all windows, and is taken away again.
"""

from pyspark.sql import functions as F

from ..functions.expr import tidy
from ..registry import query
from ..sources import roles as R
from ..sources.roles import with_roles
from ..sources.stores import scratch
from ..streaming import streams as St

C = F.col
_OHLCV = "round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume"


def tick_stream(s, d):
    t = R.ticks(s, d).select("symbol", F.timestamp_micros("us").alias("ts"), "seq", "price", "qty", C("user_id").alias("run"))
    last = t.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).select(F.lit("~").alias("symbol"), "ts", F.lit(-1).cast("long").alias("seq"), F.lit(0.0).alias("price"), F.lit(0.0).alias("qty"), F.lit(-1).cast("long").alias("run"))
    path = scratch(s, "ticks")
    t.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(path)
    last.write.mode("append").parquet(path)
    return St.read_parts(s, path, t.schema, files_per_trigger=1)


def finished(s, stream):
    return St.run_to_table(stream, scratch(s, "out"), scratch(s, "state")).where("symbol <> '~'")


@query("st_03_tumbling_bars", with_roles("bars") + f"SELECT symbol, t, {_OHLCV} FROM bars")
def st_03(s, d):
    x = finished(s, St.tumbling_bars(tick_stream(s, d), "1 hour", "60 days"))
    return tidy(x, "symbol", "t", **{c: C(c) for c in ("open", "high", "low", "close", "volume")})


@query("st_04_sliding_volume", with_roles("ticks") + ", w AS (SELECT symbol, us, unnest(range(0, 4)) AS k FROM ticks) SELECT symbol, ((us // 21600000000) - k) * 21600000 AS t, count(*)::DOUBLE AS volume FROM w GROUP BY 1, 2")
def st_04(s, d):
    return finished(s, St.sliding_volume(tick_stream(s, d), "24 hours", "6 hours", "60 days"))


@query("st_05_gap_sessions", with_roles("ticks") + ", g AS (SELECT symbol, us, sum(CASE WHEN us - l < 3660000000 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY us, seq) AS run FROM (SELECT *, lag(us) OVER (PARTITION BY symbol ORDER BY us, seq) AS l FROM ticks)) SELECT symbol, min(us) AS first_us, count(*) AS n FROM g GROUP BY symbol, run")
def st_05(s, d):
    return finished(s, St.gap_sessions(tick_stream(s, d), "61 minutes", "60 days"))


@query("st_01_event_feed", "SELECT DISTINCT user_id AS run, event_type AS symbol FROM events")
def st_01(s, d):
    return finished(s, St.event_feed(tick_stream(s, d), ["run", "symbol"], "60 days").select("run", "symbol"))


@query("st_08_live_snapshot", with_roles("runs") + "SELECT run, count(*) AS n, max(t) AS last_t FROM runs GROUP BY 1")
def st_08(s, d):
    """The last state of each run, kept by a streaming aggregate in complete mode and taken at the end."""
    name = "snapshot_" + scratch(s, "x").rsplit("-", 1)[1]
    agg = tick_stream(s, d).where("symbol <> '~'").groupBy("run").agg(F.count("*").alias("n"), F.max(F.floor(F.unix_micros("ts") / 1000)).alias("last_t"))
    store = scratch(s, "snapshot")
    q = agg.writeStream.outputMode("complete").foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(store)).option("checkpointLocation", scratch(s, name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.parquet(store)
