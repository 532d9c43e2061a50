"""What only larger tables show: sums of doubles that pass 1e12, late ticks close together, many small files, rows that come twice."""

import tempfile

from quantloom import registry


def tables(spark, **rows):
    base = tempfile.mkdtemp(prefix="spark-")
    for name, df in rows.items():
        df.coalesce(1).write.parquet(f"{base}/{name}.parquet")
    return base


def test_a_ledger_of_large_sums_still_adds_up(spark):
    orders = spark.range(6000).selectExpr("id AS o_orderkey", "id AS o_custkey", "'F' AS o_orderstatus", "round(1e9 + id * 377.77, 2) AS o_totalprice", "timestamp'1995-01-01' AS o_orderdate", "'5-LOW' AS o_orderpriority")
    lines = spark.range(6000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "2.0D AS l_quantity", "round(9e8 + id * 255.13, 2) AS l_extendedprice", "0.03D AS l_discount", "0.07D AS l_tax")
    (got,) = registry.queries()["agg_01_ledger_summary"](spark, tables(spark, orders=orders, lineitem=lines)).collect()
    paid, spent = (sum(at * 100 + i * step for i in range(6000)) for at, step in ((10**9, 37777), (9 * 10**8, 25513)))  # in cents
    assert got["turnover"] == spent / 100 and got["gross"] == (paid - spent) / 100 and got["adds_up"]


def largest_task(spark, group, run):
    """What ``run`` returns, and the most rows that one task read from a shuffle."""
    sc, held = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    sc.setJobGroup(group, group)
    try:
        for k, v in zip(held, ("false", "-1", "16"), strict=True):
            spark.conf.set(k, v)
        got = run()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
        sc.setLocalProperty("spark.jobGroup.id", None)
    track, store, most = sc.statusTracker(), sc._jsc.sc().statusStore(), 0
    for stage in {i for job in track.getJobIdsForGroup(group) for i in track.getJobInfo(job).stageIds}:
        if track.getStageInfo(stage) and track.getStageInfo(stage).numCompletedTasks:
            tasks = store.taskList(stage, 0, 1000)
            most = max([most, *[tasks.apply(i).taskMetrics().get().shuffleReadMetrics().recordsRead() for i in range(tasks.size())]])
    return got, most


HALF_HOUR = 1_800_000


def long_history(spark, n):
    """One symbol with a settlement each half hour from 1995 on, every tenth of them twice, every third not official; daily bars on even days."""
    orders = spark.range(n).selectExpr("id AS o_orderkey", "id AS o_custkey", "'F' AS o_orderstatus", "1000.0D AS o_totalprice", "timestamp_millis(788918400000 + 2 * 86400000 * (id div 96)) AS o_orderdate", "'5-LOW' AS o_orderpriority")
    lines = spark.range(n).selectExpr("id AS l_orderkey", "explode(if(id % 10 = 0, array(0, 0), array(0))) AS l_linenumber", "1.0D AS l_quantity", "100.0D AS l_extendedprice", "0.06D AS l_discount", "0.0D AS l_tax", "if(id % 3 = 0, 'R', 'N') AS l_returnflag", f"timestamp_millis(788918400000 + {HALF_HOUR} * id) AS l_shipdate")
    return tables(spark, orders=orders, lineitem=lines)


def test_a_long_history_of_one_symbol_has_its_cadence_from_many_tasks(spark):
    n = 6000
    base = long_history(spark, n)
    ((got,), most) = largest_task(spark, "cadence", lambda: registry.queries()["dq_04_cadence_report"](spark, base).collect())
    twice, modeled = n // 10, sum(2 if i % 10 == 0 else 1 for i in range(0, n, 3))
    want = {"symbol": "5-LOW", "n": n + twice, "official": n + twice - modeled, "modeled": modeled, "first_t": 788918400000, "last_t": 788918400000 + HALF_HOUR * (n - 1), "min_step": 0, "max_step": HALF_HOUR, "official_days": n // 48}
    assert got.asDict() == want
    assert most < n / 4  # there is one key, and there are sixteen tasks


def test_a_long_history_of_one_symbol_is_joined_by_many_tasks(spark):
    n = 6000
    base = long_history(spark, n)
    got, most = largest_task(spark, "asof", lambda: registry.queries()["join_01_asof_last_bar"](spark, base).collect())
    want = {}
    for i in (i for i in range(1, n) if i % 3):  # strictly after the bar: a settlement at a bar's time goes to the bar before
        bar = min((i - 1) // 96, (n - 1) // 96)
        want[bar] = want.get(bar, 0) + (2 if i % 10 == 0 else 1)
    assert {(r["t"] - 788918400000) // (2 * 86400000): r["n"] for r in got} == want
    assert most < n / 4


def test_asof_carries_over_empty_blocks_and_takes_no_null(spark):
    from quantloom.operators import joins as J

    right = spark.createDataFrame([("a", 5, 1.0), ("a", 95, 2.0), ("b", 7, 3.0), (None, 1, 4.0), ("b", None, 5.0)], "k string, t long, v double")
    left = spark.createDataFrame([("a", 4), ("a", 5), ("a", 60), ("a", 94), ("a", 95), ("a", 99), ("a", 500), ("b", 6), ("b", 700), (None, 9), ("b", None)], "k string, e long")
    at = lambda **more: {(r.k, r.e): r.v for r in J.asof(left, right, key="k", left_time="e", right_time="t", values=["v"], block=10, **more).collect()}
    want = {("a", 4): None, ("a", 5): 1.0, ("a", 60): 1.0, ("a", 94): 1.0, ("a", 95): 2.0, ("a", 99): 2.0, ("a", 500): 2.0, ("b", 6): None, ("b", 700): 3.0, (None, 9): None, ("b", None): None}
    assert at() == want
    assert at(strict=True) == want | {("a", 5): None, ("a", 95): 1.0}
    assert at(max_age=50) == want | {("a", 60): None, ("a", 94): None, ("a", 500): None, ("b", 700): None}


def test_fits_of_few_rows_run_in_few_tasks(spark):
    from quantloom.operators import models as M

    rows = spark.range(600).selectExpr("id * 86400000L + 946684800000L AS t", "(id + 1) * 86400000L + 946684800000L AS known_t", "24000 + id div 30 AS month", "cast(id % 7 AS double) AS f0", "cast(id % 2 AS int) AS y").repartition(64, "t")
    got = M.walk_forward(rows, ["f0"], "y", [(24000, 24010, 24012), (24002, 24012, 24014)], "logit")
    assert {r["fold"] for r in got.select("fold").distinct().collect()} == {0, 1} and got.rdd.getNumPartitions() <= 2  # one for each of two folds at most


def test_signs_of_a_close_that_comes_again_are_those_of_the_sql(spark):
    import duckdb

    from .oracle import differences

    base = tempfile.mkdtemp(prefix="spark-")
    values = ", ".join(f"({i}, {v})" for i, v in enumerate((6.0, 217.0, 16.0, 331.0, 74.0, 194.0, 6.0)))
    events = f"SELECT i::BIGINT AS event_id, make_timestamp(1706216400000000 + i * 3600000000) AS ts, 1::BIGINT AS user_id, 'view' AS event_type, v::DOUBLE AS value, '' AS props FROM (VALUES {values}) AS x(i, v)"
    duckdb.connect().execute(f"COPY ({events}) TO '{base}/events.parquet' (FORMAT parquet)")
    assert differences(spark, registry.queries()["sig_07_baselines"], registry.oracle_sql()["sig_07_baselines"], base) is None
