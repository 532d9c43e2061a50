"""Reading and writing market data: bar shards, settlements, instruments, grids, ledgers, evidence trees, slice logs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
BAR = "open_time_ms long, close_time_ms long, open double, high double, low double, close double, volume double"
SETTLEMENT = "funding_time_ms long, funding_rate double, mark_price double, truth_status string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, or in a temporary one where it is unset (local tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: list[str]) -> DataFrame:
    """df written as Parquet under a new path and read again."""
    path = scratch(df.sparkSession, name)
    df.repartition(*partition_by).write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.parquet(path)


def scan_bars(spark: SparkSession, root: str, symbols: list[str], intervals: list[str], start_ms: int, end_ms: int) -> DataFrame:
    """Month shards ``klines/<symbol>/<interval>/<symbol>-<interval>-YYYY-MM.jsonl.gz``; keys come from the path.

    Months outside the range are pruned by name before any file is opened; ``end_ms`` is the last day's end.
    """
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(BAR).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl*").json(f"{root}/klines")
    named = rows.select("*", F.regexp_extract(path, r"/klines/([^/]+)/", 1).alias("symbol"), F.regexp_extract(path, r"/klines/[^/]+/([^/]+)/", 1).alias("interval"), F.regexp_extract(path, r"(\d{4}-\d{2})\.jsonl", 1).alias("month"))
    month = lambda ms: F.date_format(F.date_from_unix_date(F.lit(ms // 86_400_000).cast("int")), "yyyy-MM")
    return named.where(F.col("symbol").isin(symbols) & F.col("interval").isin(intervals) & F.col("month").between(month(start_ms), month(end_ms)) & F.col("open_time_ms").between(start_ms, end_ms))


def _file_system(root: str):
    """(file system, folder) of a path or URI, for tasks that write files under names of their own."""
    from pyarrow import fs

    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return fs.FileSystem.from_uri(root)


def _finish(files, part: str, path: str) -> None:
    """Puts a whole file in its place; a repeated task puts the same file there again."""
    files.move(part, path)


def _many(spark: SparkSession) -> int:
    """Into how many tasks files go: fixed, as few bytes in many files would be put into one task."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_lines(rows: DataFrame, root: str, *order: str) -> DataFrame:
    """Rows (path, line, order...) as text files under root, gzip where the name ends so; returns (path, n), one row for each file.

    A file is written by one task, batch by batch in the given order, under a name of its own and then moved, so that half files are never seen and none is held in memory. A null path raises.
    """

    def put(batches):
        import numpy as np
        import pandas as pd

        files, folder = _file_system(root)
        now, out, n, part, made, done = None, None, 0, None, None, []
        for batch in batches:
            paths, lines = batch["path"].to_numpy(), batch["line"].to_numpy()
            starts = np.flatnonzero(np.append(True, paths[1:] != paths[:-1])) if len(paths) else []
            for at, end in zip(starts, [*starts[1:], len(paths)], strict=True):
                path = paths[at]
                if path is None or path != path:
                    raise ValueError("a line without a path")
                if path != now:
                    if out:
                        out.close()
                        _finish(files, part, f"{folder}/{now}")
                        done.append((now, n))
                    into = f"{folder}/{path}".rsplit("/", 1)[0]
                    if into != made:
                        files.create_dir(into, recursive=True)
                        made = into
                    now, n, part = path, 0, f"{folder}/{path}.{uuid.uuid4().hex}.part"
                    out = files.open_output_stream(part, compression="gzip" if path.endswith(".gz") else None)
                out.write(("\n".join(lines[at:end]) + "\n").encode())
                n += int(end - at)
            if done:
                yield pd.DataFrame(done, columns=["path", "n"])
                done = []
        if out:
            out.close()
            _finish(files, part, f"{folder}/{now}")
            yield pd.DataFrame({"path": [now], "n": [n]})

    done = scratch(rows.sparkSession, "files-written")  # tasks run once, whatever is asked of the list
    rows.repartition(_many(rows.sparkSession), "path").sortWithinPartitions("path", *order).mapInPandas(put, "path string, n long").write.parquet(done)
    return rows.sparkSession.read.parquet(done)


def write_month_shards(bars: DataFrame, root: str) -> DataFrame:
    """Bars (symbol, interval and those of ``BAR``) as ``klines/<symbol>/<interval>/<symbol>-<interval>-YYYY-MM.jsonl.gz``, in the order of time; rows without symbol, interval or time have no shard and raise."""
    names = [f.split()[0] for f in BAR.split(", ")]
    month = F.date_format(F.date_from_unix_date(F.floor(F.col("open_time_ms") / 86_400_000).cast("int")), "yyyy-MM")
    shard = F.concat(F.lit("klines/"), "symbol", F.lit("/"), "interval", F.lit("/"), "symbol", F.lit("-"), "interval", F.lit("-"), month, F.lit(".jsonl.gz"))
    return write_lines(bars.select(shard.alias("path"), F.to_json(F.struct(*names)).alias("line"), "open_time_ms"), root, "open_time_ms")


def write_documents(documents: DataFrame, root: str) -> None:
    """Each row (path, text) as a file of that name under root."""

    def put(batches):
        files, folder = _file_system(root)
        made = None
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"], strict=True):
                into = f"{folder}/{path}".rsplit("/", 1)[0]
                if into != made:
                    files.create_dir(into, recursive=True)
                    made = into
                part = f"{folder}/{path}.{uuid.uuid4().hex}.part"
                with files.open_output_stream(part) as out:
                    out.write(text.encode())
                _finish(files, part, f"{folder}/{path}")
            yield batch[["path"]].iloc[:0]

    folder = F.regexp_extract("path", r"^(.*)/", 1)
    documents.select("path", "text").repartition(_many(documents.sparkSession), folder).sortWithinPartitions("path").mapInPandas(put, "path string").write.format("noop").mode("overwrite").save()


def find_files(spark: SparkSession, root: str) -> DataFrame:
    """(path) of all files with bytes under a folder but hidden and half ones, listed by tasks, so that no process holds the names of all.

    A task descends until a folder has more than 64 others; those are spread over the tasks of the next round.
    """

    def look(batches):
        import pandas as pd
        from pyarrow import fs

        files, _ = _file_system(root)
        for batch in batches:
            found, folders = [], list(batch["path"])
            while folders:
                inner = []
                for x in files.get_file_info(fs.FileSelector(folders.pop(), allow_not_found=True)):
                    if x.base_name[:1] in ("_", ".") or x.base_name.endswith(".part"):
                        continue
                    if x.type == fs.FileType.Directory:
                        inner.append(x.path)
                    elif x.size:
                        found.append((x.path, False))
                if len(inner) > 64:
                    found += [(x, True) for x in inner]
                else:
                    folders += inner
                if len(found) > 10_000:
                    yield pd.DataFrame(found, columns=["path", "folder"])
                    found = []
            yield pd.DataFrame(found, columns=["path", "folder"])

    level, out = spark.range(1).select(F.lit(_file_system(root)[1]).alias("path")), None
    while True:
        at = scratch(spark, "listed")
        level.mapInPandas(look, "path string, folder boolean").write.parquet(at)
        seen = spark.read.parquet(at)
        here = seen.where("not folder").select("path")
        out = here if out is None else out.unionByName(here)
        level = seen.where("folder").select("path")
        if level.isEmpty():
            return out
        level = level.repartition(_many(spark))


def read_files(files: DataFrame, root: str, *, lines: bool) -> DataFrame:
    """(path, value) of the files (path) under root, a row for each line or for each file; unpacked where the name says so."""

    def get(batches):
        import pandas as pd

        store, _ = _file_system(root)
        for batch in batches:
            out, held = [], 0
            for path in batch["path"]:
                with store.open_input_stream(path) as f:
                    left = b""
                    while True:
                        some = f.read(4_000_000) if lines else f.read()
                        if not lines:
                            out.append((path, some.decode(errors="replace")))
                            held += len(some)
                            break
                        got = (left + some).splitlines(keepends=True)
                        left = got.pop() if got and some else b""  # its end may come with the next bytes
                        out += [(path, x.rstrip(b"\r\n").decode(errors="replace")) for x in got]
                        held += len(some)
                        if held > 4_000_000:
                            yield pd.DataFrame(out, columns=["path", "value"])
                            out, held = [], 0
                        if not some:
                            break
                if held > 4_000_000:
                    yield pd.DataFrame(out, columns=["path", "value"])
                    out, held = [], 0
            yield pd.DataFrame(out, columns=["path", "value"])

    return files.repartition(_many(files.sparkSession)).mapInPandas(get, "path string, value string")


def write_bar_store(bars: DataFrame, path: str) -> None:
    """The splittable copy of gzip shards: Parquet by interval, symbol and month, sorted by time."""
    bars.repartition("interval", "symbol", "month").sortWithinPartitions("interval", "symbol", "month", "open_time_ms").write.mode("overwrite").partitionBy("interval", "symbol", "month").parquet(path)


def scan_settlements(spark: SparkSession, path: str, *, truth: str = "official") -> tuple[DataFrame, DataFrame]:
    """(usable rows, row counts by status and reason)."""
    rows = spark.read.schema(SETTLEMENT).json(path)
    bad = F.when(F.col("truth_status") != truth, "status").when(F.isnan("funding_rate") | F.col("funding_rate").isNull(), "rate").when(F.col("mark_price") <= 0, "mark")
    marked = rows.withColumn("refused", bad)
    return marked.where("refused is null").drop("refused"), marked.groupBy("truth_status", "refused").count()


def scan_instruments(spark: SparkSession, path: str) -> DataFrame:
    """instruments[].fields flattened, one row for each symbol; legal is false where the taker fee is missing."""
    fields = "struct<fields:struct<raw_symbol:string,price_increment:double,taker_fee:double,maker_fee:double,quote_currency:string>>"
    rows = spark.read.schema(f"schema_version string, instruments array<{fields}>").option("multiLine", True).json(path)
    return rows.select(F.explode("instruments.fields").alias("f")).select("f.*").withColumn("legal", F.col("taker_fee").isNotNull())


def scan_series(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Auxiliary daily series as one long table (series, day, value); value is the close where there is no value."""
    out = None
    for name, path in paths.items():
        one = spark.read.schema("open_time_ms long, close double, value double").json(path).select(F.lit(name).alias("series"), F.floor(F.col("open_time_ms") / 86_400_000).alias("day"), F.coalesce("value", "close").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def write_grid(rows: DataFrame, path: str, *, fmt: str = "parquet") -> None:
    rows.write.mode("overwrite").partitionBy("grid").option("header", True).format(fmt).save(path)


def _parsed(text, schema: str):
    """JSON text as a struct of the schema with ``_corrupt_record``, the text where it can't be read; blank text can't be read either."""
    return F.from_json(F.when(F.trim(text) == "", "{").otherwise(text), f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE"})  # with options the optimizer leaves all fields in


def scan_artefacts(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """JSON documents ``results/<family>/rounds/<round>/attempts/<run>/<name>`` with keys from their paths; unreadable ones keep their text."""
    found = find_files(spark, f"{root}/results").where(C("path").endswith(f"/{name}"))
    return _keyed(read_files(found, root, lines=False), schema)


def _keyed(texts: DataFrame, schema: str) -> DataFrame:
    part = lambda what: F.regexp_extract("path", rf"/{what}/([^/]+)/", 1)
    return texts.withColumn("_doc", _parsed(C("value"), schema)).select(part("results").alias("family"), part("rounds").alias("round"), part("attempts").alias("run"), "_doc.*")


#: fixed values: the documents of an evidence tree, at which level they lie, and their fields
ARTEFACTS = {
    "family": ("family", "family.json", "family_id string, created_at_utc string"),
    "round_spec": ("round", "round-spec.json", "round_id string, expected_total long"),
    "verdict": ("round", "verdict.json", "round_id string, verdict string"),
    "state": ("run", "state.json", "run_id string, stage string"),
    "result": ("run", "result.json", "run_id string, episodes long"),
    "bundle": ("run", "bundle.json", "run_id string, bundle_identity_sha256 string"),
}
_LEVELS = {"family": ["family"], "round": ["family", "round"], "run": ["family", "round", "run"]}


def artefact_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The six typed tables of a tree; ``problem`` is unreadable where a document isn't JSON, else null. The tree is listed and its files opened once."""
    names = [file for _, file, _ in ARTEFACTS.values()]
    found = find_files(spark, f"{root}/results").withColumn("file", F.substring_index("path", "/", -1)).where(C("file").isin(names))
    at, tables = scratch(spark, "documents"), {}
    read_files(found, root, lines=False).withColumn("file", F.substring_index("path", "/", -1)).write.partitionBy("file").parquet(at)
    texts = spark.read.schema("path string, value string, file string").parquet(at)
    for kind, (_, file, schema) in ARTEFACTS.items():
        rows = _keyed(texts.where(C("file") == file), schema)
        tables[kind] = rows.withColumn("problem", F.when(F.col("_corrupt_record").isNotNull(), "unreadable")).drop("_corrupt_record")
    return tables


def refused_artefacts(tables: dict[str, DataFrame], required: list[str]) -> DataFrame:
    """(family, round, run, kind, problem): documents that can't be read, and required ones that are absent where another document of their family, round or run exists. Files of no bytes count as absent."""
    places = None
    for kind, rows in tables.items():
        at = rows.select("family", "round", "run")
        places = at if places is None else places.unionByName(at)
    kept = scratch(places.sparkSession, "places")
    places.distinct().write.parquet(kept)
    places = places.sparkSession.read.parquet(kept)
    out = None
    for kind, rows in tables.items():
        keys = _LEVELS[ARTEFACTS[kind][0]]
        bad = rows.where("problem is not null").select("family", "round", "run", F.lit(kind).alias("kind"), "problem")
        out = bad if out is None else out.unionByName(bad)
        if kind in required:
            there = places.select(*keys).where(" and ".join(f"{k} <> ''" for k in keys)).distinct()
            gone = there.join(rows.select(*keys), keys, "left_anti")
            out = out.unionByName(gone.select(*[F.col(k) if k in keys else F.lit("").alias(k) for k in _LEVELS["run"]], F.lit(kind).alias("kind"), F.lit("absent").alias("problem")))
    return out


def required_inputs(required: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every required input with what was found of it and a status, present or absent."""
    return required.join(found, key, "left").withColumn("status", F.when(F.col("n") > 0, "present").otherwise("absent"))


def disagreements(declared: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of either side that the other hasn't, once each, with ``only`` telling the side."""
    a, b = declared.exceptAll(found).distinct(), found.exceptAll(declared).distinct()
    return a.withColumn("only", F.lit("declared")).unionByName(b.withColumn("only", F.lit("found")))


def scan_slice_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(slices, survivors voided by a line that can't be read) of append-only logs, one file for each survivor."""
    lines = read_files(find_files(spark, path), path, lines=True).where("trim(value) <> ''")
    at = scratch(spark, "slices")  # both results are made of them, and the files are opened once
    lines.select(_parsed(F.col("value"), schema).alias("_doc"), F.regexp_extract("path", r"([^/]+)\.jsonl", 1).alias("survivor")).select("_doc.*", "survivor").write.parquet(at)
    rows = spark.read.parquet(at)
    void = rows.groupBy("survivor").agg(F.bool_or(F.col("_corrupt_record").isNotNull()).alias("void")).where("void").select("survivor")
    return rows.join(void, "survivor", "left_anti").drop("_corrupt_record"), void


def export_ordered(df: DataFrame, path: str, fmt: str, *order) -> None:
    """A small result as one ordered file, for people."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).format(fmt).save(path)


def write_bar_shards(bars: DataFrame, root: str) -> None:
    """Gzip JSON shards under symbol, interval and month folders, one task for each month of a symbol."""
    month = F.date_format(F.date_from_unix_date(F.floor(F.col("open_time_ms") / 86_400_000).cast("int")), "yyyy-MM")
    rows = bars.withColumn("month", month)
    rows.repartition("symbol", "interval", "month").write.partitionBy("symbol", "interval", "month").option("compression", "gzip").json(f"{root}/klines")


def scan_shards(spark: SparkSession, root: str, *, intervals: list[str], start_ms: int, end_ms: int) -> DataFrame:
    """The folders of ``write_bar_shards``; interval and month prune folders, the time range is exact."""
    month = lambda ms: F.date_format(F.date_from_unix_date(F.lit(ms // 86_400_000).cast("int")), "yyyy-MM")
    rows = spark.read.schema(f"{BAR}, symbol string, interval string, month string").json(f"{root}/klines")
    return rows.where(F.col("interval").isin(intervals) & F.col("month").between(month(start_ms), month(end_ms)) & F.col("open_time_ms").between(start_ms, end_ms))
