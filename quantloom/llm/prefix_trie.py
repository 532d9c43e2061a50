"""Prefix trie of conversations: which turns do conversations begin with in common, and what does sharing them save?

Turns (role, text) are dictionary-encoded, so a conversation is a row of numbers, and equal conversations are one row with
their count. Rows are sorted by range into shards. Each shard keeps its prefixes in a ternary search tree: a node has a turn id,
links to smaller and larger ids after the same prefix, and one to the next turn; rows are inserted from the median
outwards, which balances the tree. One iterative pass over the nodes adds up members, leaves and savings.

A prefix that two neighbouring shards share is a boundary node. It is on the last path of the first shard that has it, which owns it.
All it counts is a sum over shards (a saving is members times length, less the length once, by the owner), so shards
give their parts and the parts are added. The driver sees two lengths of common prefixes for each shard.

Defined results: rows without conversation id belong to none and are left out. Null turns come first; equal turn numbers are
ordered by a hash of role and text, so that the order of rows doesn't matter. Null roles and texts are empty. Repeated rows are
repeated turns. The remainders of negative ids have their sign, as in SQL. An empty table has no root and gives an empty result.
Other columns aren't read.

The turn ids of one conversation are one array (16 bytes a turn; texts aren't in it), and the digest of the ids
that end at a node is made in one task, by streaming, as SHA-256 can't be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, saved

C = F.col
#: Turns of different conversations in a shard.
SHARD_TURNS = 1 << 18
NOTHING = hashlib.sha256(b"").hexdigest()


def encoded(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, xs): each conversation's turns in order as an array of (id, chars)."""
    r, x = F.coalesce(C(role).cast("string"), F.lit("")), F.coalesce(C(text).cast("string"), F.lit(""))
    turns = rows.where(C(conv).isNotNull()).select(C(conv).cast("long").alias("conv"), C(turn).alias("turn"), F.sha2(F.concat(F.char_length(r).cast("string"), F.lit(":"), r, x), 256).alias("_d"), F.char_length(x).cast("long").alias("chars"))
    words = saved(turns.groupBy("_d").agg(F.first("chars").alias("chars")).withColumn("id", F.monotonically_increasing_id()))
    coded = turns.drop("chars").join(words, "_d")
    order = F.struct(C("turn").isNotNull().alias("known"), "turn", F.xxhash64("_d").alias("tie"), "id", "chars")
    return coded.groupBy("conv").agg(F.array_sort(F.collect_list(order)).alias("_o")).select("conv", F.transform("_o", lambda o: F.struct(o["id"].alias("id"), o["chars"].alias("chars"))).alias("xs"))


def rebuilt(conversations: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """(conv, xs) with the first h turns of conversation conv - conv % group in place of the own ones; h is crc32(conv) % heads."""
    first = conversations.where(C("conv") % group == 0).select(C("conv").alias("_base"), F.slice("xs", 1, heads - 1).alias("_head"))
    h = (F.crc32(C("conv").cast("string").cast("binary")) % heads).cast("int")
    x = conversations.withColumns({"_base": C("conv") - C("conv") % group, "_h": h}).join(first, "_base", "left")
    head = F.slice(F.coalesce("_head", F.slice("xs", 1, 0)), F.lit(1), C("_h"))
    return x.select("conv", F.concat(head, F.slice("xs", C("_h") + 1, F.greatest(F.size("xs"), F.lit(1)))).alias("xs"))


def endings(sequences: DataFrame) -> DataFrame:
    """(_s, ends): SHA-256 of the ids of each sequence's members, ascending, comma-joined."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha, done = None, None, []
        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s == at:
                    sha.update(b",%d" % c)
                    continue
                if at is not None:
                    done.append((at, sha.hexdigest()))
                at, sha = s, hashlib.sha256(b"%d" % c)
            if len(done) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["_s", "ends"])
                done = []
        if at is not None:
            done.append((at, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["_s", "ends"])

    return sequences.select("_s", "conv").repartition("_s").sortWithinPartitions("_s", "conv").mapInArrow(digest, "_s string, ends string")


class TernaryTree:
    """Prefixes of rows of numbers. Node 0 is the empty prefix; ``link`` of a node is the root of the search tree of what follows it."""

    def __init__(self):
        self.key, self.low, self.high, self.link = [0], [-1], [-1], [-1]
        self.parent, self.depth = [-1], [0]

    def insert(self, row: list[int]) -> int:
        """The node of the row, made with all its prefixes where they are missing."""
        key, low, high, link = self.key, self.low, self.high, self.link
        at = 0
        for x in row:
            node, side, of = link[at], link, at
            while node >= 0 and key[node] != x:
                side, of = (low, node) if x < key[node] else (high, node)
                node = side[node]
            if node < 0:
                node = len(key)
                side[of] = node
                key.append(x)
                for new in (low, high, link):
                    new.append(-1)
                self.parent.append(at)
                self.depth.append(self.depth[at] + 1)
            at = node
        return at


def from_median(n: int) -> Iterator[int]:
    """0 to n - 1, the median first, then the medians of both halves, and so on."""
    level = [(0, n)]
    while level:
        below = []
        for a, b in level:
            if a < b:
                middle = (a + b) // 2
                yield middle
                below += [(a, middle), (middle + 1, b)]
        level = below


def owners(edges: list[tuple[int, int, int]]) -> dict[int, tuple[list[int], list[int]]]:
    """For each shard the owners of the prefixes that its first row shares with the shard before, and of those that its last row shares with the one behind.

    edges: (shard, common prefix of its first row and the last row before it or -1, common prefix of its first and last row), in order.
    """
    out, before, last_of = {}, None, []
    for i, (shard, common, inner) in enumerate(edges):
        first = [] if before is None else [last_of[d] if d < len(last_of) else before for d in range(common + 1)]
        behind = edges[i + 1][1] if i + 1 < len(edges) else -1
        last_of = [first[d] if d < len(first) and d <= inner else shard for d in range(behind + 1)]
        out[shard] = (first, last_of)
        before = shard
    return out


def trie_nodes(sequences: DataFrame, *, shard_turns: int = SHARD_TURNS, shards: int | None = None) -> DataFrame:
    """The nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of rows (conv, xs)."""
    spark = sequences.sparkSession
    named = saved(sequences.withColumn("_s", F.sha2(F.array_join(F.transform("xs", lambda x: x["id"].cast("string")), ","), 256)))
    different = named.groupBy("_s").agg(F.first("xs").alias("xs"), F.count("*").alias("n"), F.min("conv").alias("conv"))
    different = different.join(endings(named), "_s").select(F.transform("xs", lambda x: x["id"]).alias("ids"), F.transform("xs", lambda x: x["chars"]).alias("chars"), "n", "conv", "ends")
    if shards is None:
        turns = named.agg(F.sum(F.size("xs"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    # the checkpoint keeps partitions as they are: one sorted range each
    sharded = saved(different.repartitionByRange(shards, "ids").sortWithinPartitions("ids").withColumn("shard", F.spark_partition_id()))

    common = lambda a, b: F.coalesce(F.nullif(F.array_position(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"].eqNullSafe(z["b"])), False), F.lit(0)) - 1, F.size(a)).cast("int")
    edge = sharded.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))  # one row a shard
    edge = edge.withColumn("before", F.lag("last").over(Window.orderBy("shard")))
    edges = edge.select("shard", F.when(C("before").isNull(), -1).otherwise(common(C("before"), C("first"))), common(C("first"), C("last"))).collect()
    owned = spark.sparkContext.broadcast(owners(sorted(map(tuple, edges))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, shard = [], -1
        for batch in batches:
            for r in batch.to_pylist():
                rows.append((r["ids"], r["chars"], r["n"], r["conv"], r["ends"]))
                shard = r["shard"]
        if not rows:
            return
        tree = TernaryTree()
        ends, length = {}, [0]
        for i in from_median(len(rows)):
            ids, chars, many, conv, sha = rows[i]
            node = tree.insert(ids)
            grown = len(tree.key) - len(length)
            length += chars[len(ids) - grown :] if grown else []
            ends[node] = (many, conv, sha)
        size = len(tree.key)
        n, least, leaves, children, saved_sum = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
        first_of, last_of = owned.value[shard]
        owner = {}
        for path, whose in ((rows[0][0], first_of), (rows[-1][0], last_of)):
            node = 0
            for d, who in enumerate(whose):
                if d:
                    node = child(tree, node, path[d - 1])
                owner[node] = who
        for node in range(size - 1, -1, -1):  # children have higher numbers than their parents
            if node in ends:
                many, conv, _ = ends[node]
                n[node] += many
                least[node] = conv if least[node] is None else min(least[node], conv)
            mine = owner.get(node, shard) == shard
            if not children[node] and node not in owner:
                leaves[node] += 1
            saved_sum[node] += n[node] * length[node] - (length[node] if mine else 0)
            up = tree.parent[node]
            if up >= 0:
                n[up] += n[node]
                least[up] = least[node] if least[up] is None else min(least[up], least[node])
                leaves[up] += leaves[node]
                saved_sum[up] += saved_sum[node]
                children[up] += 1 if mine else 0
        names = ["owner", "depth", "conv", "up_owner", "up_conv", "n", "children", "leaves", "saved", "ends"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        for at in range(0, size, 50_000):
            out = []
            for node in range(at, min(size, at + 50_000)):
                up = tree.parent[node]
                out.append((owner.get(node), tree.depth[node], least[node], owner.get(up), None if up < 0 or up in owner else least[up], n[node], children[node], leaves[node], saved_sum[node], ends[node][2] if node in ends else None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    parts = saved(sharded.mapInArrow(build, "owner int, depth long, conv long, up_owner int, up_conv long, n long, children long, leaves long, saved long, ends string"))
    boundary = parts.where("owner is not null").groupBy("owner", "depth").agg(F.min("conv").alias("conv"), F.max("up_owner").alias("up_owner"), F.min("up_conv").alias("up_conv"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.max("ends").alias("ends"))
    boundary = saved(boundary)
    above = boundary.select(C("owner").alias("up_owner"), (C("depth") + 1).alias("depth"), C("conv").alias("_conv"))
    above = F.broadcast(above) if boundary.count() <= BROADCAST_KEYS else above
    nodes = parts.where("owner is null").unionByName(boundary).join(above, ["up_owner", "depth"], "left")
    return nodes.select(
        C("conv").alias("conv_id"), "depth", F.coalesce("up_conv", "_conv").alias("parent_conv_id"), C("n").alias("n_convs"), C("children").alias("n_children"), C("leaves").alias("n_leaves"),
        C("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )


def child(tree: TernaryTree, node: int, key: int) -> int:
    """The node behind ``node`` by a turn that is there."""
    at = tree.link[node]
    while tree.key[at] != key:
        at = tree.low[at] if key < tree.key[at] else tree.high[at]
    return at


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, share_heads: bool = False, **options) -> DataFrame:
    """The trie of conversations; with ``share_heads`` of the conversations rebuilt by :func:`rebuilt`."""
    sequences = saved(encoded(conversations, conv, turn, role, text))
    return trie_nodes(rebuilt(sequences) if share_heads else sequences, **options)
