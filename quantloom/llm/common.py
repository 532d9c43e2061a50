"""What the text operators share: tables, shared folders, word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word, [\x20\x09-\x0D], as a Java regular expression.
SPACES = "[ \\t-\\r]+"

#: ASCII letters go to lower case; every ASCII byte that is no letter or digit becomes a space.
ALNUM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: ASCII letters go to lower case, all other bytes stay.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where unset a new one for local tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """df cut off from its lineage by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Rows and bytes of whole texts that go to a Python worker at once, whichever comes first; one longer text goes alone.
ARROW_ROWS, ARROW_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by rows and bytes, unless it has limits of its own; all operators that send whole texts to Python call it.

    Spark reads both settings when a plan runs, so they stay set. No result depends on them.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, str(ARROW_ROWS))
    given = spark.conf.get(size, None)
    if given is None or given.upper() in ("64MB", "64M", "67108864", "67108864B", "2147483647", "2147483647B", "-1", "0"):  # Spark's own defaults
        spark.conf.set(size, str(ARROW_BYTES))


def words_by_space(text) -> "F.Column":
    """Words [^\\x20\\x09-\\x0D]+ of a text column as an array; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def process_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, for models that are read once and for caches."""
    import sys
    import types

    module = sys.modules.setdefault("_quantloom_llm_store", types.ModuleType("_quantloom_llm_store"))
    return module.__dict__.setdefault(name, {})


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-case words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_BYTES).split() if text else []


def computed_once(column) -> "F.Column":
    """The same values, but as an expression that the optimizer neither repeats at each use nor moves below a filter."""
    return F.when(F.spark_partition_id() >= 0, column)


#: Keys up to which a set of rows to leave out is broadcast; a long takes some 30 bytes there.
BROADCAST_KEYS = 1_000_000


def row_mark(*columns: str) -> "F.Column":
    """A hash of the values of the columns that tells null from everything else; what rows with equal values share."""
    return F.xxhash64(*columns, *[F.col(c).isNull() for c in columns])


def without(rows: DataFrame, gone: DataFrame, *keys: str, how: str = "left_anti") -> DataFrame:
    """rows whose keys aren't in ``gone``, or those that are with ``how`` left_semi; null is a key like any other.

    The keys are saved and counted: few are broadcast, so that wide rows stay where they are; more meet them in a shuffle join.
    """
    gone = saved(gone.select(*[F.col(k).alias(f"_gone_{k}") for k in keys]).distinct())
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_gone_{k}"))
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, same, how)
