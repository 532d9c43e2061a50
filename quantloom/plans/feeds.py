"""Streams that arrive in several runs: feeds that first only record, and ticks that come too late.

Ticks are cut at fixed days into parts; each part is written, then one run takes what is available, with the checkpoint as the memory between runs.
"""

from pyspark.sql import functions as F

from ..registry import query
from ..sources import roles as R
from ..sources.roles import DAY_MS, with_roles
from ..sources.stores import scratch
from ..streaming import streams as St

C = F.col
#: where the ticks are cut: 11 and 21 January 2024
CUTS = (1_704_931_200_000, 1_705_795_200_000)
TTL_MS = 3 * DAY_MS


def _ticks(s, d):
    t = R.ticks(s, d)
    return t.select(C("user_id").alias("run"), "symbol", "seq", "price", "qty", F.floor(C("us") / 1000).alias("t"), F.timestamp_micros("us").alias("ts"))


def _part(ticks, i):
    """Number i of the three parts."""
    low, high = (None, *CUTS)[i], (*CUTS, None)[i]
    return ticks.where((C("t") >= low if low else F.lit(True)) & (C("t") < high if high else F.lit(True)))


_KEYS = with_roles("ticks") + f", k AS (SELECT user_id AS run, symbol, us // 1000 AS t, lag(us // 1000) OVER (PARTITION BY user_id, symbol ORDER BY us) AS p FROM ticks) SELECT run, symbol, t FROM k WHERE (p IS NULL OR t - p > {TTL_MS}) AND t >= {CUTS[0]}"


@query("st_01_polled_feed", _KEYS)
def st_01_polled(s, d):
    """Three polls over three parts: the first records the keys (run, symbol) it finds; the others give each key not seen in the three days before."""
    return polled_feed(s, _ticks(s, d))[0]


def polled_feed(s, ticks):
    """(rows, progress of the last poll)."""
    path, store, memory = scratch(s, "arriving"), scratch(s, "feed"), scratch(s, "state")
    for i in range(3):
        _part(ticks, i).select("run", "symbol", "t", "ts").write.mode("append").parquet(path)
        arriving = St.read_parts(s, path, "run long, symbol string, t long, ts timestamp")
        last = St.poll(St.new_keys(arriving, ["run", "symbol"], TTL_MS, "1 hour"), store, memory)
    return s.read.schema("run long, symbol string, t long").parquet(f"{store}/rows/*"), last


def _late(ticks):
    """Every 40th tick before the first cut, which comes with the last part only."""
    return (C("t") < CUTS[0]) & (C("seq") % 40 == 0)


def arriving_late(s, ticks, shape, gap=None):
    """(table, rows dropped) of a windowed stream whose watermark trails by a day, fed in three parts, a tick far ahead closing all windows; with a gap, the sessions that the dropped rows of a part would make."""
    path, out, memory = scratch(s, "ticks"), scratch(s, "out"), scratch(s, "state")
    names = ["symbol", "ts", "seq", "price", "qty"]
    late, dropped, watermark = _late(ticks), 0, "1970-01-01T00:00:00.000Z"
    far = ticks.agg((F.max("ts") + F.expr("interval 400 days")).alias("ts")).select(F.lit("~").alias("symbol"), "ts", F.lit(-1).cast("long").alias("seq"), F.lit(0.0).alias("price"), F.lit(0.0).alias("qty"))
    parts = [_part(ticks, 0).where(~late), _part(ticks, 1), _part(ticks, 2).unionByName(ticks.where(late)), far]
    for part in parts:
        part.select(names).write.mode("append").parquet(path)
        stream = shape(St.read_parts(s, path, ticks.select(names).schema))
        progress = St.append_now(stream, out, memory)
        n = St.late_rows(progress)
        dropped += St.late_sessions(part.select(names), gap, watermark) if gap and n else n
        watermark = ([watermark] + [p["eventTime"]["watermark"] for p in progress if "watermark" in p["eventTime"]])[-1]
    return s.read.schema(stream.schema).parquet(out).where("symbol <> '~'"), dropped


_LATE = f"(us // 1000 < {CUTS[0]} AND seq % 40 = 0)"


@query("st_03_late_bars", with_roles("ticks") + f", b AS (SELECT symbol, us // 3600000000 AS h, sum(qty) AS v FROM ticks WHERE NOT {_LATE} GROUP BY 1, 2), l AS (SELECT count(*) AS dropped FROM (SELECT DISTINCT symbol, us // 3600000000 FROM ticks WHERE {_LATE})) SELECT symbol, count(*) AS bars, sum(v) AS volume, any_value(dropped) AS dropped FROM b, l GROUP BY 1")
def st_03_late(s, d):
    """Hour bars of each symbol where some ticks come too late; dropped counts the late groups (symbol, hour) of all symbols."""
    x, dropped = arriving_late(s, _ticks(s, d), lambda t: St.tumbling_bars(t, "1 hour", "1 day"))
    return x.groupBy("symbol").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume")).withColumn("dropped", F.lit(dropped).cast("long"))


@query("st_04_late_volume", with_roles("ticks") + f", w AS (SELECT symbol, us // 21600000000 - k AS h, {_LATE} AS late FROM ticks, range(0, 4) AS r(k)), l AS (SELECT count(*) AS dropped FROM (SELECT DISTINCT symbol, h FROM w WHERE late)) SELECT symbol, count(DISTINCT h) AS windows, count(*)::DOUBLE AS volume, any_value(dropped) AS dropped FROM w, l WHERE NOT late GROUP BY 1")
def st_04_late(s, d):
    """Day windows every six hours where some ticks come too late; dropped counts the late groups (symbol, window) of all symbols."""
    x, dropped = arriving_late(s, _ticks(s, d), lambda t: St.sliding_volume(t, "24 hours", "6 hours", "1 day"))
    return x.groupBy("symbol").agg(F.count("*").alias("windows"), F.sum("volume").alias("volume")).withColumn("dropped", F.lit(dropped).cast("long"))


def _sessions(which):
    return f"SELECT symbol, count(*) AS sessions, sum(n)::BIGINT AS ticks FROM (SELECT symbol, count(*) AS n FROM (SELECT symbol, sum(CASE WHEN us - l < 3660000000 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY us, seq) AS run FROM (SELECT *, lag(us) OVER (PARTITION BY symbol ORDER BY us, seq) AS l FROM ticks WHERE {which})) GROUP BY symbol, run) GROUP BY symbol"


@query("st_05_late_sessions", with_roles("ticks") + f", g AS ({_sessions(f'NOT {_LATE}')}), l AS (SELECT coalesce(sum(sessions), 0)::BIGINT AS dropped FROM ({_sessions(_LATE)})) SELECT g.*, dropped FROM g, l")
def st_05_late(s, d):
    """Sessions of each symbol where some ticks come too late; dropped counts the sessions that the late ticks would make among themselves."""
    x, dropped = arriving_late(s, _ticks(s, d), lambda t: St.gap_sessions(t, "61 minutes", "1 day"), "61 minutes")
    return x.groupBy("symbol").agg(F.count("*").alias("sessions"), F.sum("n").alias("ticks")).withColumn("dropped", F.lit(dropped).cast("long"))
