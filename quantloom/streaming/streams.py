"""Structured Streaming forms of bars, gap sessions, event feeds, stalls and forward slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


def read_parts(spark: SparkSession, path: str, schema, *, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files under a folder as a stream, so many for each trigger."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def tumbling_bars(ticks: DataFrame, length: str, delay: str) -> DataFrame:
    """Bars of arriving ticks (symbol, ts, seq, price, qty); late rows beyond the watermark are dropped."""
    by = F.struct("ts", "seq", "price")
    bars = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", length)).agg(
        F.min(by)["price"].alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(by)["price"].alias("close"), F.sum("qty").alias("volume"))
    return bars.select("symbol", F.unix_millis("window.start").alias("t"), "open", "high", "low", "close", "volume")


def sliding_volume(ticks: DataFrame, length: str, slide: str, delay: str) -> DataFrame:
    got = ticks.withWatermark("ts", delay).groupBy("symbol", F.window("ts", length, slide)).agg(F.sum("qty").alias("volume"))
    return got.select("symbol", F.unix_millis("window.start").alias("t"), "volume")


def gap_sessions(ticks: DataFrame, gap: str, delay: str) -> DataFrame:
    """Runs of ticks with no gap of that length, for each symbol."""
    got = ticks.withWatermark("ts", delay).groupBy("symbol", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return got.select("symbol", F.unix_micros("session_window.start").alias("first_us"), "n")


def _written(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False


def new_keys(events: DataFrame, key: list[str], ttl_ms: int, delay: str) -> DataFrame:
    """(key, t) of arriving events (key, t in ms, ts) whose key wasn't seen in the ``ttl_ms`` before; every event renews its key.

    A key's state is the last time it was seen, and goes when the watermark has passed that time by ``ttl_ms``. Times of one key in one trigger are held as longs;
    an event older than one already seen is not new. Events with a null t or ts are left out.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def watch(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = np.sort(np.concatenate([some["t"].to_numpy(np.int64) for some in batches]))
        last = state.get[0] if state.exists else None
        before = np.append(times[0] if last is None else last, times[:-1])
        if last is not None:
            before = np.maximum(before, last)
        found = times[(times - before > ttl_ms) | ((np.arange(len(times)) == 0) & (last is None))]
        last = int(times[-1]) if last is None else max(last, int(times[-1]))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + ttl_ms, state.getCurrentWatermarkMs()) + 1)
        if len(found):  # most keys that come again are not new, and an empty frame costs as much as a full one
            yield pd.DataFrame({k: [v] * len(found) for k, v in zip(key, names, strict=True)} | {"t": found})

    types = dict(events.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in key) + ", t long"
    there = events.where(C("t").isNotNull() & C("ts").isNotNull()).select(*key, "t", "ts")
    return there.withWatermark("ts", delay).groupBy(*key).applyInPandasWithState(watch, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def poll(feed: DataFrame, store: str, checkpoint: str) -> list:
    """One poll: all that is available goes through ``feed`` and what it emits is added to ``store``/rows; the first poll only records. Returns its progress.

    The checkpoint is the memory between polls. A first poll that breaks off stays the first; batches replayed after a fault overwrite themselves.
    """
    spark, first = feed.sparkSession, not _written(feed.sparkSession, f"{store}/recorded")

    def put(batch: DataFrame, number: int) -> None:
        if first:
            batch.write.format("noop").mode("overwrite").save()
        else:
            batch.write.mode("overwrite").parquet(f"{store}/rows/batch={number}")

    q = feed.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if first:
        spark.range(1).write.mode("overwrite").parquet(f"{store}/recorded")
    return q.recentProgress


def late_rows(progress: list) -> int:
    """Rows of the stateful operators (for aggregates: groups of a trigger) that came behind the watermark and were dropped."""
    return sum(o["numRowsDroppedByWatermark"] for p in progress for o in p["stateOperators"])


def late_sessions(ticks: DataFrame, gap: str, watermark: str) -> int:
    """Sessions made among themselves by the rows of a trigger whose own windows end at or before the watermark. Spark counts what it drops before sessions of different tasks are merged, so its own figure depends on the partitions."""
    late = ticks.where(C("ts") + F.expr(f"interval {gap}") <= F.lit(watermark).cast("timestamp"))
    return late.groupBy("symbol", F.session_window("ts", gap)).agg(F.count("*").alias("n")).count()


def event_feed(events: DataFrame, key: list[str], delay: str) -> DataFrame:
    """Each key once, however often it arrives within the delay; the checkpoint is the seen set."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def interval_join(bars: DataFrame, settlements: DataFrame, step: str, delay: str) -> DataFrame:
    """Settlements to the bar that holds them, stream to stream, with both watermarks bounding the state.

    The key is symbol and time bin, a bar standing in its own bin and the next, so a settlement meets two bars' worth of state and not all of its symbol's.
    """
    bin_of = lambda ts: F.floor(F.unix_micros(ts) / F.expr(f"unix_micros(timestamp_micros(0) + interval {step})"))
    b = bars.withWatermark("open_ts", delay).withColumn("_bin", F.explode(F.array(bin_of("open_ts"), bin_of("open_ts") + 1)))
    s = settlements.withWatermark("st_ts", delay).withColumnRenamed("symbol", "s_symbol").withColumn("_s_bin", bin_of("st_ts"))
    return b.join(s, F.expr(f"symbol = s_symbol and _bin = _s_bin and st_ts >= open_ts and st_ts < open_ts + interval {step}")).drop("s_symbol", "_bin", "_s_bin")


def stalls(events: DataFrame, idle_ms: int, delay: str) -> DataFrame:
    """(run, last_t, status) with an event-time timer for each run: stale when nothing came for ``idle_ms``, done at its end."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"run": [key[0]], "last_t": [last], "status": ["stale"]})
            return
        last, done = (state.get[0] if state.exists else 0), False
        for some in batches:
            last, done = max(last, int(some["t"].max())), done or bool((some["state"] == "done").any())
        if done:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"run": [key[0]], "last_t": [last], "status": ["done"]})
        else:
            state.update((last,))
            state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark("ts", delay).groupBy("run").applyInPandasWithState(watch, "run long, last_t long, status string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def append_slices(stream: DataFrame, store: str, accept: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str, schema: str):
    """Starts a query that appends only the slices that ``accept(new, stored)`` lets through; batches replayed after a fault are skipped by number."""
    spark = stream.sparkSession

    def put(batch: DataFrame, number: int) -> None:
        try:
            stored = spark.read.schema(schema + ", batch long").parquet(store)
        except Exception as e:  # the store doesn't exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            stored = spark.createDataFrame([], schema + ", batch long")
        old = stored.where(C("batch") < number)
        accept(batch, old.drop("batch")).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{store}/batch_dir={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()


def append_now(stream: DataFrame, path: str, checkpoint: str) -> list:
    """Everything available now, appended to a Parquet table; returns the progress of the run."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q.recentProgress


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything available now, written as Parquet and read back."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
