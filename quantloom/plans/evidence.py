"""Evidence operators whole: generations and grace of families, incident lines, progress of the newest attempt, inputs of verdicts, problems of slices, geometry of holds."""

from pyspark.sql import functions as F

from ..functions.expr import tidy
from ..operators import evidence as E
from ..operators import quality as Q
from ..registry import query
from ..sources import roles as R
from ..sources.roles import DAY_MS, HOUR_MS, with_roles

C = F.col
GRID, SL, RUNS = with_roles("grid"), with_roles("slices"), with_roles("runs")


@query("ev_10_missing_grids", GRID + ", c AS (SELECT cohort, size, kind, concat_ws(',', CASE WHEN NOT bool_or(grid = 'A') THEN 'A' END, CASE WHEN NOT bool_or(grid = 'N') THEN 'N' END, CASE WHEN NOT bool_or(grid = 'R') THEN 'R' END) AS missing FROM grid GROUP BY 1, 2, 3) SELECT * FROM c WHERE missing <> ''")
def ev_10_missing(s, d):
    return E.missing_grids(R.grid(s, d), ["cohort", "size", "kind"], ["A", "N", "R"])


@query("ev_10_winner_grids", GRID + ", g AS (SELECT cohort, size, kind, grid, round(net_pnl, 6) AS net FROM grid), w AS (SELECT * FROM g WHERE grid = 'A' QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY net DESC, size, kind) = 1) SELECT w.cohort, w.size, w.kind, count(*) AS hits, round(max(g.net) FILTER (g.grid = 'A'), 4) + 0.0 AS net_a, round(max(g.net) FILTER (g.grid = 'N'), 4) + 0.0 AS net_n, round(max(g.net) FILTER (g.grid = 'R'), 4) + 0.0 AS net_r FROM w JOIN g ON g.cohort = w.cohort AND g.size = w.size AND g.kind = w.kind GROUP BY 1, 2, 3")
def ev_10_winners(s, d):
    """Each cohort's winner by the net of grid A, with its net in every grid."""
    x = E.winners_in_grids(R.grid(s, d).withColumn("net_pnl", F.round("net_pnl", 6)), "cohort", ["size", "kind"], "A", ["A", "N", "R"])
    return x.select("cohort", "size", "kind", "hits", *[(F.round(f"net_{g}", 4) + 0.0).alias(f"net_{g}") for g in "anr"])


def _attempts(s, d):
    """Runs as attempts of thirty families in three rounds."""
    g = R.run_events(s, d).groupBy("run").agg(F.min("t").alias("created"), F.max("t").alias("activity"), F.count_if(C("state") == "done").alias("done"), F.count_if(C("state") == "failed").alias("failed"), F.count("*").alias("n"))
    return g.withColumns({"family": C("run") % 30, "round": F.floor(C("run") / 30) % 3 + 1})


_ATT = RUNS + ", a AS (SELECT run, run % 30 AS family, (run // 30) % 3 + 1 AS round, min(t) AS created, max(t) AS activity, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'failed') AS failed, count(*) AS n FROM runs GROUP BY run), now AS (SELECT max(t) AS now FROM runs)"


@query("ev_07_family_states", _ATT + """, f AS (SELECT f AS family, CASE WHEN f <> 37 THEN now - f * 1800000 + 54000000 END AS created, f <> 5 AS readable, now FROM now, range(0, 40) AS r(f)), v AS (SELECT DISTINCT family, round FROM a WHERE done > failed UNION ALL SELECT 38, 1),
l AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY family ORDER BY round DESC, activity DESC, run DESC) = 1),
x AS (SELECT f.family, l.run, CASE WHEN NOT readable THEN 'unreadable' WHEN l.run IS NOT NULL THEN CASE WHEN now - activity > 259200000 THEN 'stale' WHEN done + failed = 0 THEN 'live' WHEN EXISTS (SELECT 1 FROM v WHERE v.family = f.family AND v.round = l.round) THEN 'decided' ELSE 'undecided' END WHEN f.family IN (SELECT family FROM v) THEN 'closed' WHEN f.created IS NULL THEN 'unregistered' WHEN now - f.created <= 3600000 THEN 'launching' ELSE 'abandoned' END AS status, readable FROM f LEFT JOIN l ON l.family = f.family)
SELECT family, CASE WHEN readable THEN run END AS run, status, status IN ('unreadable', 'live', 'undecided', 'unregistered', 'launching') AS in_flight FROM x""")
def ev_07_families(s, d):
    """Forty families, thirty with attempts, at the time of the last event, with a window of three days."""
    a = _attempts(s, d)
    now = a.agg(F.max("activity").alias("now"))  # one row
    families = s.range(40).select(C("id").alias("family")).crossJoin(F.broadcast(now)).select("family", "now", F.when(C("family") != 37, C("now") - C("family") * 1_800_000 + 54_000_000).alias("created_t"), (C("family") != 5).alias("readable"))
    verdicts = a.where("done > failed").select("family", "round").unionByName(s.range(1).select(F.lit(38).cast("long").alias("family"), F.lit(1).cast("long").alias("round")))
    return E.family_states(families, a.select("family", "round", "run", "activity", (C("done") + C("failed") > 0).alias("terminal")), verdicts, C("now"), window=3 * DAY_MS)


_LINE = """CASE WHEN ordinal % 11 = 0 THEN '{"incident_id": ' || ordinal WHEN ordinal % 7 = 0 THEN '{"incident_id":"' || ordinal || '"}' ELSE '{"incident_id":"' || ordinal || '","family_id":"f' || (run % 30) || '","round_id":"r' || ((run // 30) % 3 + 1) || '","run_id":"' || run || '"}' END"""


@query("ev_08_incident_lines", _ATT + ", i AS (SELECT ordinal, run, " + _LINE + " AS line FROM runs WHERE state = 'failed') SELECT line, CASE WHEN ordinal % 11 <> 0 THEN ordinal::VARCHAR END AS incident, CASE WHEN ordinal % 11 = 0 THEN 'unparsable' WHEN ordinal % 7 = 0 THEN 'no family' ELSE 'unresolved' END AS why FROM i WHERE ordinal % 11 = 0 OR ordinal % 7 = 0 OR (run % 30 % 4 <> 0 AND run NOT IN (SELECT run FROM a WHERE done > failed))")
def ev_08_lines(s, d):
    """Failures as lines of an incident log, some cut off, some without a family; each fourth family has a verdict, and attempts with more ends than failures are clean."""
    a = _attempts(s, d)
    named = a.select(F.concat(F.lit("f"), "family").alias("family"), F.concat(F.lit("r"), "round").alias("round"), C("run").cast("string").alias("run"), C("done") > C("failed"), C("family").alias("number"))
    lines = R.run_events(s, d).where("state = 'failed'").select(F.expr(_LINE.replace("run // 30", "run div 30")).alias("line"))
    return E.open_incidents(lines, named.where("number % 4 = 0"), named.where("`(done > failed)`"))


@query("ev_09_generation_progress", _ATT + ", l AS (SELECT *, CASE WHEN run % 6 <> 5 THEN 200 END AS total, CASE WHEN run % 4 = 1 THEN 3 ELSE run % 9 END AS sd, CASE WHEN run % 4 = 1 THEN 2 ELSE 8 END AS st, CASE WHEN run % 10 = 3 THEN 'DONE' WHEN run % 10 = 4 THEN 'FAILED' END AS mark, CASE WHEN run % 8 <> 1 THEN created END AS c FROM a QUALIFY row_number() OVER (PARTITION BY family ORDER BY CASE WHEN run % 8 <> 1 THEN created END DESC NULLS LAST, round DESC, run DESC) = 1), k AS (SELECT *, CASE WHEN mark = 'DONE' THEN coalesce(total, 0) WHEN mark IS NOT NULL THEN 0 WHEN total IS NULL THEN n WHEN sd <= st THEN greatest(n, least(total, total * sd // st)) ELSE n END AS d FROM l) SELECT family, run, d::BIGINT AS done, total::BIGINT AS total, round(CASE WHEN mark = 'DONE' THEN 100 WHEN mark IS NOT NULL OR total IS NULL THEN 0 ELSE least(100.0, 100.0 * d / total) END, 6) + 0.0::DOUBLE AS pct FROM k")
def ev_09_generations(s, d):
    """Progress of thirty families by their newest attempt: rows, or a counter of steps (out of range in every fourth) scaled to a total of 200 (unknown for some)."""
    odd = C("run") % 4 == 1
    a = _attempts(s, d).select(
        "family", "round", "run", F.when(C("run") % 8 != 1, C("created")).alias("created"), F.when(C("run") % 6 != 5, F.lit(200).cast("long")).alias("total"), C("n").alias("rows"), F.when(odd, 3).otherwise(C("run") % 9).alias("steps_done"),
        F.when(odd, 2).otherwise(8).cast("long").alias("steps_total"), F.when(C("run") % 10 == 3, "DONE").when(C("run") % 10 == 4, "FAILED").alias("terminal"),
    )
    return tidy(E.progress(a), "family", "run", "done", "total", pct=C("pct"))


_CUT = 788_918_400_000


@query("dq_12_slice_problems", SL + f""", o AS (SELECT DISTINCT a.slice FROM slices a JOIN slices b ON a.survivor = b.survivor AND a.slice <> b.slice AND a.start <= b."end" AND b.start <= a."end"), p AS (SELECT survivor, slice, concat_ws(',', CASE WHEN survivor % 19 = 0 THEN 'survivor' END, CASE WHEN survivor % 19 <> 0 AND slice % 9 = 0 THEN 'params' END, CASE WHEN survivor % 19 <> 0 AND slice % 13 = 0 THEN 'bundle' END, CASE WHEN survivor % 19 <> 0 AND (survivor % 17 = 0 OR start <= {_CUT}) THEN 'cutoff' END, CASE WHEN slice IN (SELECT slice FROM o) THEN 'overlap' END) AS problems FROM slices) SELECT * FROM p WHERE problems <> ''""")
def dq_12_problems(s, d):
    """Slices against frozen survivors: some of other params or bundles (one bundle in thirteen is null), of survivors that aren't there or have no cutoff, at or before 1995, or overlapping."""
    own = lambda what: F.sha2(F.concat(F.lit(what), C("survivor")), 256)
    x = R.slices(s, d).select("survivor", "slice", "start", "end", F.when(C("slice") % 9 == 0, "other").otherwise(own("params")).alias("params"), F.when(C("slice") % 13 != 0, own("bundle")).alias("bundle"))
    entries = x.select("survivor").distinct().where("survivor % 19 <> 0").select("survivor", own("params").alias("params"), own("bundle").alias("bundle"), F.when(C("survivor") % 17 != 0, F.lit(_CUT)).alias("cutoff"))
    return E.slice_problems(x, entries, Q.overlaps(x, "survivor", "slice", max_length=DAY_MS))


@query("dq_13_hold_geometry", with_roles("settlements") + ", g AS (SELECT symbol, st, epoch_ms(o_orderdate) AS entered FROM settlements s JOIN orders o ON o.o_orderkey = s.l_orderkey) SELECT symbol, count(*) AS n, count(*) FILTER (st % 28800000 > 3600000) AS late_settlements, count(*) FILTER (st < entered OR st > entered + 7776000000) AS outside_hold, count(*) FILTER (entered % 604800000 <> 0) AS off_boundary FROM g GROUP BY 1")
def dq_13_hold(s, d):
    """Episodes entered at an order's time and left at a settlement: settled within an hour of an eight-hour bar, left within 90 days, entered on a week's boundary."""
    o = R.read(s, d, "orders").select(C("o_orderkey").alias("l_orderkey"), R.epoch("o_orderdate").alias("entered"))
    x = R.settlements(s, d).join(o, "l_orderkey")
    bad = Q.hold_geometry("st", "entered", "st", bar=8 * HOUR_MS, tolerance=HOUR_MS, hold=90 * DAY_MS, boundary=7 * DAY_MS)
    return x.groupBy("symbol").agg(F.count("*").alias("n"), *[F.count_if(c).alias(n) for n, c in bad.items()])


@query("agg_12_funnel_by_family", _ATT + ", e AS (SELECT family, sum(CASE WHEN run % 4 = 0 THEN 500 ELSE n END)::BIGINT AS e FROM a GROUP BY 1), l AS (SELECT run % 30 AS family, count(*) AS k FROM runs, now WHERE t > now - 86400000 GROUP BY 1), f AS (SELECT unnest(range(0, 40)) AS family) SELECT f.family, coalesce(e, 0) > 0 AS evaluated, coalesce(e, 0) AS evaluations, coalesce(k, 0) AS lately FROM f LEFT JOIN e ON e.family = f.family LEFT JOIN l ON l.family = f.family")
def agg_12_families(s, d):
    """Forty registered families, thirty with attempts; every fourth attempt publishes a total of 500. lately: rows of the last day before the last event."""
    a, rows = _attempts(s, d), R.run_events(s, d).select((C("run") % 30).alias("family"), "run", "t")
    now = rows.agg(F.max("t").alias("now"))  # one row
    families = s.range(40).select(C("id").alias("family")).crossJoin(F.broadcast(now))
    return E.funnel(families, a.select("family", "run", F.when(C("run") % 4 == 0, F.lit(500).cast("long")).alias("total")), rows, C("now"))
