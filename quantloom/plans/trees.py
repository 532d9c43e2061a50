"""Stores in their published layouts: month shards named by symbol and interval, evidence trees, slice logs, declared inputs and grids."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import tidy
from ..operators.orderstats import saved
from ..registry import query
from ..sources import roles as R
from ..sources import stores as St
from ..sources.roles import with_roles

C = F.col


@query("src_01_month_shards", with_roles("bars") + "SELECT symbol, '1h' AS \"interval\", '2024-01' AS month, count(*) AS n, round(sum(close), 6) + 0.0 AS closes FROM bars WHERE symbol IN ('click', 'view') AND t BETWEEN 1704844800000 AND 1705708799999 GROUP BY 1")
def src_01_months(s, d):
    """Hourly and daily bars as gzip shards in named files; two symbols' hours of ten days scanned back, other files pruned by their names."""
    shape = [C("t").alias("open_time_ms"), "open", "high", "low", "close", "volume"]
    hours = R.bars_1h(s, d).select("symbol", *shape, (C("t") + 3_599_999).alias("close_time_ms"), F.lit("1h").alias("interval"))
    days = R.bars_1d(s, d).select("symbol", *shape, (C("t") + 86_399_999).alias("close_time_ms"), F.lit("1d").alias("interval"))
    root = St.scratch(s, "klines")
    St.write_month_shards(hours.unionByName(days), root)
    x = St.scan_bars(s, root, ["click", "view"], ["1h"], 1_704_844_800_000, 1_705_708_799_999)
    return tidy(x.groupBy("symbol", "interval", "month").agg(F.count("*").alias("n"), F.sum("close").alias("c")), "symbol", "interval", "month", "n", closes=C("c"))


@query("src_06_names_agree", "SELECT 'grid' AS kind, 'stress' AS name, 'declared' AS only UNION ALL SELECT 'column', 'cagr', 'declared' UNION ALL SELECT 'column', 'sharpe', 'found' UNION ALL SELECT DISTINCT 'grid', l_returnflag, 'found' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')")
def src_06_names(s, d):
    """Grid and column names that a manifest declares against those of the CSV folders: the manifest here leaves out a grid and a column, and has one more of each."""
    path, at = St.scratch(s, "grid-csv"), St.scratch(s, "manifest")
    St.write_grid(R.grid(s, d), path, fmt="csv")
    fixed = F.lit("A"), F.lit("N"), F.lit("stress")
    columns = [F.lit(c) for c in ("cohort", "size", "kind", "net_pnl", "cagr", "episodes")]
    s.range(1).select(F.array(*fixed).alias("grids"), F.array(*columns).alias("header")).write.json(at)
    m = s.read.schema("grids array<string>, header array<string>").json(at)
    declared = m.select(F.lit("grid").alias("kind"), F.explode("grids").alias("name")).unionByName(m.select(F.lit("column").alias("kind"), F.explode("header").alias("name")))
    x = s.read.option("header", True).csv(path)
    found = x.select(F.lit("grid").alias("kind"), C("grid").alias("name")).distinct()
    for c in x.columns:
        if c != "grid":
            found = found.unionByName(s.range(1).select(F.lit("column").alias("kind"), F.lit(c).alias("name")))
    return St.disagreements(declared, found)


def _tree(s, d):
    """Runs of families f0 to f2 in rounds r1 and r2. One run in five has no result, one in seven an unreadable one; round r2 has no verdict, and family f2 no document."""
    runs = R.run_events(s, d).groupBy("run").agg(F.count("*").alias("n")).withColumns({"family": F.concat(F.lit("f"), C("run") % 3), "round": F.concat(F.lit("r"), C("run") % 2 + 1)})
    runs = saved(runs)
    round_at = F.concat(F.lit("results/"), "family", F.lit("/rounds/"), "round", F.lit("/"))
    run_at = F.concat(round_at, F.lit("attempts/"), "run", F.lit("/"))
    doc = lambda rows, at, file, **fields: rows.select(F.concat(at, F.lit(file)).alias("path"), F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("text"))
    rounds, name = runs.select("family", "round").distinct(), C("run").cast("string")
    broken = runs.where("run % 5 <> 0 and run % 7 = 3").select(F.concat(run_at, F.lit("result.json")).alias("path"), F.lit('{"run_id": oops').alias("text"))
    parts = [
        doc(runs, run_at, "state.json", run_id=name, stage=F.lit("grid")), doc(runs.where("run % 5 <> 0 and run % 7 <> 3"), run_at, "result.json", run_id=name, episodes=C("n")), broken,
        doc(runs, run_at, "bundle.json", run_id=name, bundle_identity_sha256=F.sha2(name, 256)), doc(rounds, round_at, "round-spec.json", round_id=C("round"), expected_total=F.lit(7)),
        doc(rounds.where("round = 'r1'"), round_at, "verdict.json", round_id=C("round"), verdict=F.lit("SURVIVED")),
        doc(rounds.where("family <> 'f2'").select("family").distinct(), F.concat(F.lit("results/"), "family", F.lit("/")), "family.json", family_id=C("family")),
    ]
    root = St.scratch(s, "tree")
    St.write_documents(reduce(DataFrame.unionByName, parts), root)
    return St.artefact_tables(s, root)


_TREE = with_roles("runs") + ", u AS (SELECT run, 'f' || (run % 3) AS family, 'r' || (run % 2 + 1) AS round, count(*) AS n FROM runs GROUP BY run) "


@query("src_07_typed_tables", _TREE + "SELECT family, round, run::VARCHAR AS run, 'grid' AS stage, n AS episodes, sha256(run::VARCHAR) AS bundle, 7::BIGINT AS expected_total, CASE WHEN round = 'r1' THEN 'SURVIVED' END AS verdict, family <> 'f2' AS registered FROM u WHERE run % 5 <> 0 AND run % 7 <> 3")
def src_07_typed(s, d):
    """Every readable result with what the other five typed tables say of its run, round and family."""
    t = _tree(s, d)
    run, at = ["family", "round", "run"], ["family", "round"]
    x = t["result"].where("problem is null").select(*run, "episodes").join(t["state"].select(*run, "stage"), run, "left").join(t["bundle"].select(*run, C("bundle_identity_sha256").alias("bundle")), run, "left")
    x = x.join(t["round_spec"].select(*at, "expected_total"), at, "left").join(t["verdict"].select(*at, "verdict"), at, "left")
    x = x.join(t["family"].select("family", "family_id"), "family", "left").withColumn("registered", C("family_id").isNotNull())
    return x.select(*run, "stage", "episodes", "bundle", "expected_total", "verdict", "registered")


@query("src_07_refusals", _TREE + "SELECT family, round, run::VARCHAR AS run, 'result' AS kind, CASE WHEN run % 5 = 0 THEN 'absent' ELSE 'unreadable' END AS problem FROM u WHERE run % 5 = 0 OR run % 7 = 3 UNION ALL SELECT DISTINCT family, round, '', 'verdict', 'absent' FROM u WHERE round = 'r2' UNION ALL SELECT DISTINCT family, '', '', 'family', 'absent' FROM u WHERE family = 'f2'")
def src_07_refused(s, d):
    """Documents of the tree that can't be read or are absent."""
    return St.refused_artefacts(_tree(s, d), ["family", "round_spec", "verdict", "state", "result"])


@query("src_08_survivor_logs", with_roles("slices") + "SELECT survivor::VARCHAR AS survivor, CASE WHEN survivor % 10 <> 3 THEN count(*) END AS n, survivor % 10 = 3 AS void FROM slices GROUP BY survivor")
def src_08_logs(s, d):
    """One log for each survivor in a thousand folders, a slice a line; a line that can't be read voids the survivor (one in ten here)."""
    x = R.slices(s, d).select(F.concat(C("survivor") % 1000, F.lit("/"), "survivor", F.lit(".jsonl")).alias("path"), F.to_json(F.struct("slice", "start", "end")).alias("line"), "slice", "survivor")
    broken = x.where("survivor % 10 = 3").select("path").distinct().select("path", F.lit('{"slice": oops').alias("line"), F.lit(-1).cast("long").alias("slice"))
    root = St.scratch(s, "logs")
    St.write_lines(x.drop("survivor").unionByName(broken), root, "slice")
    slices, void = St.scan_slice_log(s, root, "slice long, start long, end long")
    kept = slices.groupBy("survivor").agg(F.count("*").alias("n")).withColumn("void", F.lit(False))
    return kept.unionByName(void.select("survivor", F.lit(None).cast("long").alias("n"), F.lit(True).alias("void")))


_REQUIRED = ("click", "view", "purchase", "funding_8h", "open_interest")


@query("src_09_required_inputs", with_roles("bars") + ", q AS (SELECT unnest(" + str(list(_REQUIRED)) + ") AS symbol), g AS (SELECT symbol, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM bars GROUP BY 1) SELECT q.symbol, n, first_t, last_t, CASE WHEN n > 0 THEN 'present' ELSE 'absent' END AS status FROM q LEFT JOIN g ON q.symbol = g.symbol")
def src_09_required(s, d):
    """Every required input with its rows, first and last times; two of the five are absent."""
    required = s.range(1).select(F.explode(F.array(*[F.lit(x) for x in _REQUIRED])).alias("symbol"))
    found = R.bars_1h(s, d).groupBy("symbol").agg(F.count("*").alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return St.required_inputs(required, found, "symbol")
