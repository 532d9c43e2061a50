"""Evidence operators: reconciliation of ledgers, deterministic identities, states of families, incidents, progress, verdict inputs, forward slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def identity(*fields: str) -> Column:
    """``sv-`` and 16 hex digits of the SHA-256 of the canonical JSON of the fields (in the order given, which is sorted)."""
    return F.concat(F.lit("sv-"), F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 16))


def reconcile(episodes: DataFrame, fills: DataFrame, tol: float = 1e-3) -> DataFrame:
    """By symbol: episodes, those whose fees or fill counts differ from their fills (an episode without fills or with a missing figure differs), those
    without fills, counts by exit reason, four sums, and fills without an episode, which have no symbol."""
    f = fills.groupBy("episode").agg(F.sum("fee").alias("f_fees"), F.count("*").alias("f_n"))
    j = episodes.withColumn("_there", F.lit(True)).join(f, "episode", "full")
    there, closed = C("_there").isNotNull(), C("f_n").isNotNull()
    same = F.coalesce(F.abs(C("fees") - C("f_fees")) <= tol, F.lit(False)) & F.coalesce(C("n_fills") == C("f_n"), F.lit(False))
    exits = [F.count_if(there & (C("exit_reason") == x)).alias(f"exits_{x.lower()}") for x in "FOP"] if "exit_reason" in episodes.columns else []
    sums = [F.sum(c).alias(c) for c in ("gross", "fees", "funding") if c in episodes.columns]
    return j.groupBy("symbol").agg(F.count_if(there).alias("n"), F.count_if(there & ~same).alias("differ"), F.count_if(there & ~closed).alias("no_fills"), F.count_if(~there).alias("orphans"), *exits, *sums)


def equity_measures(steps: DataFrame, time: str, step: str, start: float, *, key: str = "symbol", chunk: int = 90) -> DataFrame:
    """(key, days, max_dd, sharpe) of the equity start + running sum of ``step`` in the order of ``time`` (whole numbers, one row a day).

    Stretches of ``chunk`` days are folded to (sum, peak, low, deepest fall), which compose, so no running window goes over a key: only its
    few stretches are put in order. Returns need the equity that enters a stretch, the sum of those before it.
    """
    runs = steps.groupBy(key, F.floor(C(time) / chunk).alias("_c")).agg(F.array_sort(F.collect_list(F.struct(C(time).alias("t"), C(step).alias("x")))).alias("_xs"))
    zero, low, high = F.lit(0.0), F.lit(float("inf")), F.lit(float("-inf"))
    fold = F.aggregate(
        "_xs", F.struct(zero.alias("sum"), high.alias("peak"), low.alias("low"), zero.alias("fall")),
        lambda s, e: F.struct((s["sum"] + e["x"]).alias("sum"), F.greatest(s["peak"], s["sum"] + e["x"]).alias("peak"), F.least(s["low"], s["sum"] + e["x"]).alias("low"), F.least(s["fall"], s["sum"] + e["x"] - F.greatest(s["peak"], s["sum"] + e["x"])).alias("fall")),
    )
    runs = runs.withColumn("_e", fold)
    entering = F.sum("_e.sum").over(Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_in", entering)
    returns = F.aggregate(
        "_xs", F.struct((F.lit(start) + C("_in")).alias("eq"), zero.alias("n"), zero.alias("m"), zero.alias("q")),
        lambda s, e: F.when(s["eq"].isNull(), F.struct((F.lit(start) + e["x"]).alias("eq"), s["n"].alias("n"), s["m"].alias("m"), s["q"].alias("q"))).otherwise(
            F.struct((s["eq"] + e["x"]).alias("eq"), (s["n"] + 1).alias("n"), (s["m"] + e["x"] / s["eq"]).alias("m"), (s["q"] + (e["x"] / s["eq"]) ** 2).alias("q"))),
    )
    runs = runs.withColumn("_r", returns)
    by = runs.groupBy(key).agg(F.sum(F.size("_xs")).alias("days"), F.array_sort(F.collect_list(F.struct("_c", "_e"))).alias("_es"), F.sum("_r.n").alias("_n"), F.sum("_r.m").alias("_m"), F.sum("_r.q").alias("_q"))
    whole = F.aggregate(
        "_es", F.struct(zero.alias("sum"), high.alias("peak"), low.alias("low"), zero.alias("fall")),
        lambda s, x: F.struct((s["sum"] + x["_e"]["sum"]).alias("sum"), F.greatest(s["peak"], s["sum"] + x["_e"]["peak"]).alias("peak"), F.least(s["low"], s["sum"] + x["_e"]["low"]).alias("low"), F.least(s["fall"], x["_e"]["fall"], s["sum"] + x["_e"]["low"] - s["peak"]).alias("fall")),
    )
    mean = C("_m") / C("_n")
    var = (C("_q") - C("_n") * mean**2) / (C("_n") - 1)
    sharpe = F.when(C("days") <= 2, 0.0).when(var > 0, mean / F.sqrt(var) * F.sqrt(F.lit(365.0))).otherwise(0.0)
    return by.select(key, "days", whole["fall"].alias("max_dd"), sharpe.alias("sharpe"))


def newest(attempts: DataFrame, key: str, *order: str) -> DataFrame:
    """The attempt of each key that is last in the given order (nulls first)."""
    names = [c for c in attempts.columns if c != key]
    last = F.max(F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.struct(*names).alias("_row")))
    return attempts.groupBy(key).agg(last.alias("_x")).select(key, "_x._row.*")


def family_states(families: DataFrame, attempts: DataFrame, verdicts: DataFrame, now: Column, *, window: int = 90 * 60_000, grace: int = 60 * 60_000) -> DataFrame:
    """(family, run, status, in_flight) of families (family, created_t, readable), attempts (family, round, run, activity, terminal) and verdicts (family, round).

    The newest generation decides (round, then activity, then run; attempts without activity don't count): stale beyond the window; live without a terminal mark; undecided
    until its own round has a verdict, then decided. Without attempts a family is closed by any verdict; launching within the grace after its creation, else abandoned. A family that
    can't be read, or has no creation time, is held in flight (unreadable, unregistered).
    """
    last = newest(attempts.where("activity is not null"), "family", "round", "activity", "run")
    decided = verdicts.select("family", "round").distinct().withColumn("_decided", F.lit(True))
    closed = verdicts.select("family").distinct().withColumn("_closed", F.lit(True))
    x = families.join(last, "family", "left").join(decided, ["family", "round"], "left").join(closed, "family", "left")
    tried, inside = F.col("activity").isNotNull(), now - F.col("activity") <= window
    status = (
        F.when(~F.col("readable"), "unreadable").when(tried & ~inside, "stale").when(tried & ~F.col("terminal"), "live").when(tried & F.col("_decided"), "decided").when(tried, "undecided")
        .when(F.col("_closed"), "closed").when(F.col("created_t").isNull(), "unregistered").when(now - F.col("created_t") <= grace, "launching").otherwise("abandoned")
    )
    x = x.select("family", F.when(F.col("readable"), F.col("run")).alias("run"), status.alias("status"))
    return x.withColumn("in_flight", F.col("status").isin("unreadable", "live", "undecided", "unregistered", "launching"))


def open_incidents(lines: DataFrame, verdicts: DataFrame, clean: DataFrame) -> DataFrame:
    """(line, incident, why) of log lines that nothing has resolved: neither a verdict of their family nor a clean end of their attempt (family, round, run).

    Lines that can't be read, or that name no family, stay open. Blank lines are no incidents; equal lines count each.
    """
    doc = F.from_json("line", "incident_id string, family_id string, round_id string, run_id string, _corrupt_record string", {"mode": "PERMISSIVE"})
    x = lines.where("trim(line) <> ''").select("line", doc.alias("_d")).select("line", "_d.*")
    done = verdicts.select(F.col("family").alias("family_id")).distinct().withColumn("_verdict", F.lit(True))
    ended = clean.select(F.col("family").alias("family_id"), F.col("round").alias("round_id"), F.col("run").alias("run_id")).distinct().withColumn("_clean", F.lit(True))
    x = x.join(done, "family_id", "left").join(ended, ["family_id", "round_id", "run_id"], "left")
    named = F.coalesce(F.length("family_id"), F.lit(0)) > 0
    why = F.when(F.col("_corrupt_record").isNotNull(), "unparsable").when(~named, "no family").when(F.col("_verdict").isNull() & F.col("_clean").isNull(), "unresolved")
    return x.select("line", F.when(F.col("_corrupt_record").isNull(), F.col("incident_id")).alias("incident"), why.alias("why")).where("why is not null")


def progress(attempts: DataFrame) -> DataFrame:
    """(family, run, done, total, pct) of the newest attempt of each family (by creation, nulls first, then round and run).

    Attempts: family, round, run, created, total (null: unknown), rows, steps_done, steps_total, terminal (DONE, another mark or null). DONE is 100 %, another mark 0; else the rows, or the
    counter of steps scaled to the total and rounded down where that is more and it is well formed.
    """
    x = newest(attempts, "family", "created", "round", "run")
    steps = F.when((F.col("steps_total") > 0) & F.col("steps_done").between(0, F.col("steps_total")), F.least("total", F.floor(F.col("total") * F.col("steps_done") / F.col("steps_total"))))
    counted = F.greatest("rows", steps)
    done = F.when(F.col("terminal") == "DONE", F.coalesce("total", F.lit(0))).when(F.col("terminal").isNotNull(), 0).when(F.col("total").isNull(), F.col("rows")).otherwise(counted)
    pct = F.when(F.col("terminal") == "DONE", 100.0).when(F.col("terminal").isNotNull() | F.col("total").isNull(), 0.0).otherwise(F.least(F.lit(100.0), 100.0 * done / F.col("total")))
    return x.select("family", "run", done.cast("long").alias("done"), "total", pct.alias("pct"))


def missing_grids(cells: DataFrame, key: list[str], grids: list[str]) -> DataFrame:
    """Cells that lack a grid, with the missing names in order, comma-joined."""
    has = cells.groupBy(*key).agg(F.collect_set(F.when(F.col("grid").isin(grids), F.col("grid"))).alias("_has"))  # no more than the grids
    lost = F.array_except(F.array(*[F.lit(g) for g in sorted(grids)]), "_has")
    return has.select(*key, F.array_join(lost, ",").alias("missing")).where("missing <> ''")


def winners_in_grids(cells: DataFrame, cohort: str, key: list[str], canonical: str, grids: list[str]) -> DataFrame:
    """(cohort, key, hits, net_<grid>) of each cohort's cell with the largest net in the canonical grid (ties: smallest key), with its net in every grid; hits counts its rows."""
    best = cells.where(F.col("grid") == canonical).groupBy(cohort).agg(F.min(F.struct((-F.col("net_pnl")).alias("_n"), *key)).alias("_x")).select(cohort, *[f"_x.{k}" for k in key])
    nets = [F.max(F.when(F.col("grid") == g, F.col("net_pnl"))).alias(f"net_{g.lower()}") for g in grids]
    return best.join(cells.where(F.col("grid").isin(grids)), [cohort, *key]).groupBy(cohort, *key).agg(F.count("*").alias("hits"), *nets)


def slice_problems(slices: DataFrame, entries: DataFrame, overlapping: DataFrame) -> DataFrame:
    """(survivor, slice, problems) of slices that can't be forward evidence; problems in a fixed order, comma-joined.

    entries (survivor, params, bundle, cutoff) are the frozen survivors; overlapping (survivor, slice) are slices that cover times of another. dates: it ends before it starts; survivor:
    no such entry; params, bundle: not the frozen ones (null: neither); cutoff: none, or the slice starts at or before it.
    """
    e = entries.select("survivor", F.col("params").alias("_p"), F.col("bundle").alias("_b"), "cutoff", F.lit(True).alias("_there"))
    x = slices.join(e, "survivor", "left").join(overlapping.select("survivor", "slice").distinct().withColumn("_o", F.lit(True)), ["survivor", "slice"], "left")
    there, differ = F.col("_there").isNotNull(), lambda a, b: ~F.coalesce(F.col(a) == F.col(b), F.lit(False))
    found = {
        "dates": F.col("start") > F.col("end"), "survivor": ~there, "params": there & differ("params", "_p"), "bundle": there & differ("bundle", "_b"),
        "cutoff": there & (F.col("cutoff").isNull() | (F.col("start") <= F.col("cutoff"))), "overlap": F.col("_o").isNotNull(),
    }
    text = F.concat_ws(",", *[F.when(c, n) for n, c in found.items()])
    return x.select("survivor", "slice", text.alias("problems")).where("problems <> ''")


def funnel(families: DataFrame, attempts: DataFrame, rows: DataFrame, now: Column, *, span: int = 86_400_000) -> DataFrame:
    """(family, evaluated, evaluations, lately) of registered families: the evaluations of their attempts, and the rows of the ``span`` up to ``now``, which ``families`` carries.

    attempts (family, run, total) give an authoritative total where there is one, else the rows (family, run, t) that were counted. Attempts without rows or a total count as none.
    """
    per = rows.groupBy("family", "run").agg(F.count("*").alias("_n"))
    counted = attempts.join(per, ["family", "run"], "left").withColumn("_e", F.coalesce("total", "_n", F.lit(0)))
    sums = counted.groupBy("family").agg(F.sum("_e").alias("_sum"))
    late = rows.join(families, "family").where((F.col("t") > now - span) & (F.col("t") <= now)).groupBy("family").agg(F.count("*").alias("_late"))
    x = families.join(sums, "family", "left").join(late, "family", "left")
    total = F.coalesce("_sum", F.lit(0))
    return x.select("family", (total > 0).alias("evaluated"), total.alias("evaluations"), F.coalesce("_late", F.lit(0)).alias("lately"))
