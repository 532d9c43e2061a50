"""Exact duplicates by an extendible-hash index on shared files.

Documents are read once: each task hashes the normalised texts (all of [\\x20\\x09-\\x0D] deleted) and numbers the different
texts it has met, so that copies within a task are one local text from then on. This store is written to the shared
folder. The index has the hash values as keys: a directory of 2^depth cells over the leading bits of the hash, doubled
as long as a bucket holds more keys than fit, and buckets that several cells may share. Owner tasks take ranges
of buckets, chain the local texts of each hash value and compare their bytes, so texts with one hash but other bytes
are different classes. Hash values that one local text alone has need no comparison and no text leaves the store for
them. Directory and buckets are Parquet in the shared folder; whoever has the paths can read them again.

A text that very many tasks hold is compared in two rounds: FAN local texts of it at a time, then what is left of each.
Other work on a group is sums over one row a task.

Defined results: null counts as empty, so null, empty and white texts are one class. Of a class the row with the most code
points stays, then the smallest key (rows without key last), then the first one read; so one row of repeated rows
stays. An empty table gives an empty result. Other input columns, whatever their names, don't enter the decisions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import BROADCAST_KEYS, saved, scratch_path, small_batches, without

C = F.col
WHITE = bytes([32, *range(9, 14)])
#: Bytes that continue a UTF-8 character.
CONTINUED = bytes(range(0x80, 0xC0))
#: Hash values that a bucket holds; another one splits it.
BUCKET_KEYS = 1 << 16
#: Bytes of different texts that a task remembers before it starts afresh; later copies become further local texts, which the owners unite.
LOCAL_BYTES = 32 << 20
#: Local texts of one hash value that are compared in one task at once.
FAN = 256
#: Levels of the directory below which a bucket isn't looked for; with even hashes none is.
FOLDED = 8
DIGESTED = "_h long, _local long, _row long, _first boolean, _n long, _sha string"


def _store(docs: DataFrame, key: str, text: str, hash_bits: int, whole: bool) -> DataFrame:
    """The rows as (_key, _text, [_rest,] _h, _local, _row, _first, _n, _sha); without ``whole`` only the first row of a local text keeps it."""
    small_batches(docs.sparkSession)
    kept = [C(key).alias("_key"), C(text).cast("string").alias("_text")] + ([F.struct("*").alias("_rest")] if whole else [])
    rows = docs.select(*kept)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        known: dict[int, list] = {}
        held, base = 0, TaskContext.get().partitionId() << 40
        row = local = base
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for raw in batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist():
                plain = raw.translate(None, WHITE)
                h = xxhash.xxh64_intdigest(plain) >> (64 - hash_bits) << (64 - hash_bits)
                chain = known.setdefault(h, [])
                found = next((x for x in chain if x[0] == plain), None)
                first = found is None
                if first:
                    if held > LOCAL_BYTES:
                        known, held = {}, 0
                        chain = known.setdefault(h, [])
                    found = (plain, local, hashlib.sha256(plain).hexdigest())
                    chain.append(found)
                    held += len(plain) + 200
                    local += 1
                out.append((h - (1 << 63), found[1], row, first, len(raw.translate(None, CONTINUED)), found[2]))
                row += 1
            made = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()), strict=True)]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            if not whole:
                columns["_text"] = pa.compute.if_else(made[3], columns["_text"], pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*columns.values(), *made], [*columns, "_h", "_local", "_row", "_first", "_n", "_sha"])

    schema = StructType([*rows.schema.fields, *StructType.fromDDL(DIGESTED).fields])
    path = scratch_path(docs.sparkSession, "exact-store")
    rows.mapInArrow(digest, schema).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _cell(depth: int):
    """The directory cell of a hash value: its leading bits; the order of cells is that of the hashes."""
    return F.shiftright(C("_h"), 64 - depth) + F.lit(1 << (depth - 1)).cast("long") if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = BUCKET_KEYS, max_depth: int = 48) -> tuple[DataFrame, int]:
    """(cell, bucket, local_depth, n) of the hash values (_h, different), and the depth: cells of the least depth, or eight below
    the last doubling, at which no bucket holds more than ``capacity`` keys."""
    n = keys.count()
    depth = max(0, math.ceil(math.log2(max(n, 1) / capacity)))
    while True:
        cells = keys.groupBy(_cell(depth).alias("cell")).agg(F.count("*").alias("_in"))
        fullest = cells.agg(F.max("_in")).first()[0] or 0
        if fullest <= capacity or depth >= max_depth:
            break
        depth += 1  # the directory doubles
    local, bucket, size = F.lit(depth), C("cell"), C("_in")
    for level in range(depth - 1, max(-1, depth - FOLDED - 1), -1):  # buddies that fit together share a bucket
        shift = depth - level
        together = F.sum("_in").over(Window.partitionBy(F.shiftright("cell", shift)))
        fits = together <= capacity
        local, bucket, size = F.when(fits, F.lit(level)).otherwise(local), F.when(fits, F.shiftleft(F.shiftright("cell", shift), shift)).otherwise(bucket), F.when(fits, together).otherwise(size)
    return cells.select("cell", bucket.alias("bucket"), local.cast("int").alias("local_depth"), size.alias("n")), depth


def _chained(entries: DataFrame, salted: bool) -> DataFrame:
    """(_h, _local, _rep, _chain) of entries (bucket, _h, _salt, _local, _text): the first local text with the same bytes, and its number in the chain of its hash value."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chain = None, []
        for batch in batches:
            h, salt, local = (batch.column(k).to_pylist() for k in (0, 1, 2))
            rep, number = [], []
            for i, raw in enumerate(batch.column(3).cast(pa.binary()).fill_null(b"").to_pylist()):
                if at != (h[i], salt[i]):
                    at, chain = (h[i], salt[i]), []
                plain = raw.translate(None, WHITE)
                k = next((k for k, x in enumerate(chain) if x[0] == plain), None)
                if k is None:
                    k = len(chain)
                    chain.append((plain, local[i]))
                rep.append(chain[k][1])
                number.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rep, pa.int64()), pa.array(number, pa.int32())], ["_h", "_local", "_rep", "_chain"])

    owners = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = entries.repartitionByRange(owners, "bucket", "_h", "_salt") if salted else entries.repartitionByRange(owners, "bucket", "_h")
    return ranged.select("_h", "_salt", "_local", "_text").sortWithinPartitions("_h", "_salt", "_local").mapInArrow(compare, "_h long, _local long, _rep long, _chain int")


def build_index(store: DataFrame, capacity: int = BUCKET_KEYS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """The directory (cell, bucket, local_depth, n) and the buckets (bucket, _h, _chain, _local, _rep) of a store's local texts, both read back from the shared folder."""
    spark = store.sparkSession
    firsts = store.where("_first")
    keys = saved(firsts.groupBy("_h").agg(F.count("*").alias("copies")))
    cells, depth = directory(keys, capacity)
    paths = {what: scratch_path(spark, f"exact-{what}") for what in ("directory", "buckets", "round")}
    cells.write.parquet(paths["directory"])
    cells = spark.read.parquet(paths["directory"])
    small = F.broadcast(cells) if cells.count() <= BROADCAST_KEYS else cells
    placed = lambda rows: rows.withColumn("cell", _cell(depth)).join(small.select("cell", "bucket"), "cell").drop("cell")

    shared = keys.where("copies > 1")
    most = shared.agg(F.max("copies")).first()[0] or 0
    entries = placed(without(firsts.select("_h", "_local", "_text"), shared, "_h", how="left_semi"))
    if most > fan:
        salt = F.pmod(F.xxhash64("_local"), F.lit(-(-most // fan)))
        _chained(entries.withColumn("_salt", salt), True).write.parquet(paths["round"])
        once = spark.read.parquet(paths["round"])
        left = without(entries, once.where("_rep = _local").select("_local"), "_local", how="left_semi")
        again = _chained(left.withColumn("_salt", F.lit(0).cast("long")), False).select(C("_local").alias("_rep"), C("_rep").alias("_last"), "_chain")
        met = once.select("_h", "_local", "_rep").join(again, "_rep").select("_h", "_local", C("_last").alias("_rep"), "_chain")
    else:
        met = _chained(entries.withColumn("_salt", F.lit(0).cast("long")), False)
    alone = without(firsts.select("_h", "_local"), shared, "_h").select("_h", "_local", C("_local").alias("_rep"), F.lit(0).alias("_chain"))
    placed(met.unionByName(alone)).select("bucket", "_h", "_chain", "_local", "_rep").sortWithinPartitions("bucket", "_h").write.parquet(paths["buckets"])
    return cells, spark.read.parquet(paths["buckets"])


def _decided(store: DataFrame, capacity: int, fan: int) -> DataFrame:
    """The store's rows with _keep (the key that stays), _size and _kept."""
    best = F.min(F.struct((-C("_n")).alias("n"), C("_key").isNull().alias("unnamed"), C("_key").alias("key"), C("_row").alias("row"))).alias("_best")
    local = store.groupBy("_local").agg(F.count("*").alias("_size"), best)
    _, buckets = build_index(store, capacity, fan)
    named = buckets.select("_local", "_rep")
    classes = local.join(named, "_local").groupBy("_rep").agg(F.sum("_size").alias("_size"), F.min("_best").alias("_best"))
    by_local = named.join(classes, "_rep").select("_local", "_size", "_best")
    return store.join(by_local, "_local").withColumns({"_keep": C("_best.key"), "_kept": C("_row") == C("_best.row")})


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", *, capacity: int = BUCKET_KEYS, fan: int = FAN, hash_bits: int = 64) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) for every row of docs. ``hash_bits`` below 64 makes collisions, for tests."""
    decided = _decided(_store(docs, key, text, hash_bits, False), capacity, fan)
    return decided.select(C("_key").alias(key), C("_keep").alias("keep_id"), C("_size").cast("long").alias("group_size"), C("_kept").alias("kept"), C("_sha").alias("text_sha256"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", *, capacity: int = BUCKET_KEYS, fan: int = FAN, hash_bits: int = 64) -> DataFrame:
    """The rows of docs that stay, with all their columns and whole texts."""
    return _decided(_store(docs, key, text, hash_bits, True), capacity, fan).where("_kept").select("_rest.*")
