"""Stores in named files: what is pruned isn't opened, shards are whole, refusals name what is unreadable or absent."""

import gzip
import os
import tempfile

import pytest

from quantloom.sources import stores as St

HOUR, DAY = 3_600_000, 86_400_000
JAN = 1_704_067_200_000


def bars(spark, n=1500):
    x = spark.range(n).selectExpr(f"{JAN} + id * {HOUR} AS open_time_ms", f"{JAN} + id * {HOUR} + {HOUR - 1} AS close_time_ms", "1.0 AS open", "2.0 AS high", "0.5 AS low", "1 / (id + 3) AS close", "cast(id AS double) AS volume")
    return x.selectExpr("*", "'A' AS symbol", "'1h' AS interval").unionByName(x.selectExpr("*", "'B' AS symbol", "'1h' AS interval"))


def test_shards_are_whole_and_others_are_not_opened(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    done = St.write_month_shards(bars(spark), root)
    assert sorted((r.path, r.n) for r in done.collect())[:2] == [("klines/A/1h/A-1h-2024-01.jsonl.gz", 744), ("klines/A/1h/A-1h-2024-02.jsonl.gz", 696)]
    assert not [f for _, _, names in os.walk(root) for f in names if f.endswith(".part")]
    with gzip.open(f"{root}/klines/A/1h/A-1h-2024-01.jsonl.gz", "rt") as f:
        assert len(f.readlines()) == 744
    for other in ("A/1h/A-1h-2024-02", "A/1d/A-1d-2024-01", "B/1h/B-1h-2024-01"):  # not gzip: whoever opens one fails
        os.makedirs(os.path.dirname(f"{root}/klines/{other}"), exist_ok=True)
        with open(f"{root}/klines/{other}.jsonl.gz", "wb") as f:
            f.write(b"not a shard")
    end = JAN + 31 * DAY - 1
    got = St.scan_bars(spark, root, ["A"], ["1h"], JAN, end)
    assert got.count() == 744
    assert abs(got.agg({"close": "sum"}).first()[0] - sum(1 / (i + 3) for i in range(744))) < 1e-9
    with pytest.raises(Exception):  # noqa: B017  the reader's own error
        St.scan_bars(spark, root, ["B"], ["1h"], JAN, end).collect()
    St.write_month_shards(bars(spark), root)  # the same again mends them
    assert St.scan_bars(spark, root, ["A", "B"], ["1h"], JAN, JAN + 100 * DAY).count() == 3000


def test_bars_without_a_key_are_refused(spark):
    with pytest.raises(Exception, match="without a path"):
        St.write_month_shards(bars(spark, 3).selectExpr("* EXCEPT (symbol)", "cast(null AS string) AS symbol"), tempfile.mkdtemp(prefix="spark-"))


def test_refusals(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    run = "results/f/rounds/r/attempts/"
    St.write_documents(spark.createDataFrame([(f"{run}1/state.json", '{"run_id": "1"}'), (f"{run}1/result.json", '{"run_id": "1", "episodes": 4}'), (f"{run}2/state.json", " ")], "path string, text string"), root)
    tables = St.artefact_tables(spark, root)
    assert [(r.run, r.episodes, r.problem) for r in tables["result"].collect()] == [("1", 4, None)]
    got = {tuple(r) for r in St.refused_artefacts(tables, ["family", "result"]).collect()}
    assert got == {("f", "", "", "family", "absent"), ("f", "r", "2", "result", "absent"), ("f", "r", "2", "state", "unreadable")}


def test_one_bad_line_voids_a_log(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    St.write_documents(spark.createDataFrame([("a.jsonl", '{"slice": 1}\n\n{"slice": 2}\n'), ("b.jsonl", '{"slice": 1}\n{"slice":'), ("c.jsonl", "")], "path string, text string"), root)
    slices, void = St.scan_slice_log(spark, root, "slice long")
    assert sorted((r.survivor, r.slice) for r in slices.collect()) == [("a", 1), ("a", 2)] and [r.survivor for r in void.collect()] == ["b"]


def test_a_tree_of_many_runs_is_opened_once(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    run = "concat('results/f/rounds/r/attempts/', id, '/"
    docs = spark.range(150).selectExpr(f"{run}result.json') AS path", "concat('{\"run_id\": \"', id, '\", \"episodes\": ', id, '}') AS text")
    St.write_documents(docs.unionByName(spark.range(150).selectExpr(f"{run}state.json') AS path", "'' AS text")), root)
    with open(f"{root}/results/f/rounds/r/attempts/7/result.json.0.part", "w") as f:
        f.write("{}")
    assert St.find_files(spark, root).count() == 150  # more folders than one task lists; half files and files of no bytes are left out
    tables = St.artefact_tables(spark, root)
    os.rename(f"{root}/results", f"{root}/gone")
    refused = St.refused_artefacts(tables, ["state"])
    assert tables["result"].agg({"episodes": "sum"}).first()[0] == 149 * 75 and refused.where("kind = 'state' and problem = 'absent'").count() == 150


def test_lines_of_logs_are_read_in_pieces_and_once(spark):
    root = tempfile.mkdtemp(prefix="spark-")
    with open(f"{root}/a.jsonl", "wb") as f:
        f.write(b'{"slice": 1}\r\n' + b'{"slice": 2}\n' * 700_000 + b'{"slice": 3}')
    slices, void = St.scan_slice_log(spark, root, "slice long")
    os.rename(f"{root}/a.jsonl", f"{root}/gone")
    assert slices.agg({"slice": "sum"}).first()[0] == 1_400_004 and void.count() == 0
