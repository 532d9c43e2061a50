"""Polled feeds: the first poll only records, keys are renewed and forgotten, and late rows are dropped and counted."""

import tempfile

from pyspark.sql import functions as F

from quantloom.plans import feeds
from quantloom.sources import roles as R
from quantloom.streaming import streams as St

HOUR = 3_600_000


def arrive(spark, path, rows):
    spark.createDataFrame(rows, "k string, t long").withColumn("ts", F.timestamp_millis("t")).write.mode("append").parquet(path)
    return St.new_keys(St.read_parts(spark, path, "k string, t long, ts timestamp"), ["k"], 10 * HOUR, "1 hour")


def test_first_poll_records_later_ones_give_new_keys(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    path, store, memory = f"{base}/in", f"{base}/store", f"{base}/state"
    St.poll(arrive(spark, path, [("a", 1), ("b", HOUR), (None, HOUR)]), store, memory)
    St.poll(arrive(spark, path, [("a", 5 * HOUR), ("c", 5 * HOUR), ("c", 6 * HOUR), (None, 6 * HOUR), ("d", None)]), store, memory)
    St.poll(arrive(spark, path, [("a", 14 * HOUR), ("c", 30 * HOUR), ("c", 41 * HOUR)]), store, memory)
    got = spark.read.schema("k string, t long").parquet(f"{store}/rows/*").collect()
    assert sorted((r.k, r.t // HOUR) for r in got) == [("c", 5), ("c", 30), ("c", 41)]  # a was renewed at 5; c was forgotten twice


def test_a_poll_without_input_gives_nothing(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    St.poll(arrive(spark, f"{base}/in", []), f"{base}/store", f"{base}/state")
    St.poll(arrive(spark, f"{base}/in", [("a", HOUR)]), f"{base}/store", f"{base}/state")
    assert [r.k for r in spark.read.parquet(f"{base}/store/rows/*").collect()] == ["a"]


def test_state_of_keys_long_unseen_goes(spark, sf):
    ticks = feeds._ticks(spark, sf).where("run % 2 = 0 or t < 1705000000000")  # odd runs end early
    _, last = feeds.polled_feed(spark, ticks)
    kept = last[-1].stateOperators[0].numRowsTotal
    ended = R.ticks(spark, sf).where("user_id % 2 = 1").select("user_id", "symbol").distinct().count()
    assert ended > 0 and 0 < kept <= ticks.select("run", "symbol").distinct().count() - ended


def test_late_rows_are_dropped_and_counted(spark, sf):
    ticks = feeds._ticks(spark, sf)
    late = ticks.where(feeds._late(ticks))
    want = late.select("symbol", F.floor(F.col("t") / HOUR)).distinct().count()
    bars, dropped = feeds.arriving_late(spark, ticks, lambda t: St.tumbling_bars(t, "1 hour", "1 day"))
    assert dropped == want > 0
    assert bars.agg(F.sum("volume")).first()[0] == ticks.count() - late.count()


def test_late_ticks_close_together_are_one_session(spark):
    rows = [(1, "a", i, 1.0, 1.0, feeds.CUTS[0] - 5 * 24 * HOUR + i * 60_000) for i in range(400)] + [(1, "a", 1000 + i, 1.0, 1.0, cut + HOUR) for i, cut in enumerate(feeds.CUTS)]
    ticks = spark.createDataFrame(rows, "run long, symbol string, seq long, price double, qty double, t long").withColumn("ts", F.timestamp_millis("t"))
    x, dropped = feeds.arriving_late(spark, ticks, lambda t: St.gap_sessions(t, "61 minutes", "1 day"), "61 minutes")
    assert dropped == 1  # ten ticks, 40 minutes apart
    assert x.agg(F.sum("n")).first()[0] == 392


def test_interval_join_is_keyed_by_time_too(spark):
    base = tempfile.mkdtemp(prefix="spark-")
    spark.range(200).selectExpr("'a' AS symbol", "timestamp_millis(id * 3600000 + 1234567) AS open_ts").write.parquet(f"{base}/bars")  # off the full hour
    spark.range(3000).selectExpr("'a' AS symbol", "timestamp_millis(id * 239987) AS st_ts", "id AS seq").write.parquet(f"{base}/ticks")
    bars, ticks = St.read_parts(spark, f"{base}/bars", "symbol string, open_ts timestamp"), St.read_parts(spark, f"{base}/ticks", "symbol string, st_ts timestamp, seq long")
    joined = St.interval_join(bars, ticks, "1 hour", "60 days")
    got = {(r.seq, r.at) for r in St.run_to_table(joined, f"{base}/out", f"{base}/state").select("seq", F.unix_millis("open_ts").alias("at")).collect()}
    assert got == {(i, (i * 239_987 - 1_234_567) // HOUR * HOUR + 1_234_567) for i in range(3000) if 1_234_567 <= i * 239_987 < 200 * HOUR + 1_234_567}
    assert "(_bin#" in joined._jdf.queryExecution().analyzed().toString()  # an equality, so part of the state's key
