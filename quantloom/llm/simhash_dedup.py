"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly in tiles.

Fingerprints of whole texts are made in Arrow batches. Different fingerprints are sorted by their bit counts and cut
into tiles of bounded size; two tiles are compared only if their bit counts (of the whole word and of its four
quarters) come within the radius, with numpy exclusive-or and bit counts over the whole pair of tiles. A tile pair
emits a spanning forest of its links, never all of them, which keeps every connection. Components are then
found by alternating star contraction over those links. Copies with one fingerprint are one node throughout, so
groups of copies of any size cost one row.

With a second seed each text has a second, independent fingerprint, and a link has both within the radius. That takes
wide radii, which catch copies with several changed words: on one fingerprint such a radius also meets unrelated texts, on
two it hardly ever does.

The work on pairs of tiles grows with the square of the number of different fingerprints, divided by what the
bit counts exclude; this is the price of exact comparison without candidates.

Defined results: null and empty texts, and texts of white space, have fingerprint 0 and are linked like any other;
a text of one or two words is one shingle. Repeated doc_ids keep their rows; each row has the component of its own
fingerprint. Rows without doc_id are linked like any other; they lead a component only where no row of it has one.
An empty table gives an empty result. Input columns named _row are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, row_mark, saved, small_batches, without


def fingerprints(text: str | None, seeds: tuple[int, ...], width: int = 3, chunk: int = 1 << 16) -> list[int]:
    """For each seed the majority bits of the XXH64 of all word shingles of a text; 0 without words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []
    if not words:
        return [0] * len(seeds)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return [digest(b" ".join(words), seed) for seed in seeds]
    total, ones = len(words) - width + 1, np.zeros((len(seeds), 64), np.int64)
    for at in range(0, total, chunk):
        some = words[at : at + chunk + width - 1]
        shingles = [b" ".join(x) for x in zip(*(some[k:] for k in range(width)), strict=False)]
        for row, seed in zip(ones, seeds, strict=True):
            row += bit_sums(np.fromiter((digest(x, seed) for x in shingles), np.uint64, len(shingles)))
    return [sum(1 << i for i in range(64) if 2 * n[i] > total) for n in ones.tolist()]


def fingerprint(text: str | None, width: int = 3, seed: int = 42, chunk: int = 1 << 16) -> int:
    return fingerprints(text, (seed,), width, chunk)[0]


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduce(bits, axis=0, dtype=np.int64)


def with_fingerprints(docs: DataFrame, text: str, seeds: dict[str, int], width: int = 3) -> DataFrame:
    """Adds a fingerprint of each whole text for every seed, by name, as signed longs; texts reach Python once for all."""

    @F.pandas_udf(", ".join(f"{name} long" for name in seeds))
    def marks(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            got = np.array([fingerprints(t, tuple(seeds.values()), width) for t in some], np.uint64).reshape(-1, len(seeds))
            yield pd.DataFrame(got.view(np.int64), columns=list(seeds))

    marked = docs.withColumn("_marks", marks(text))
    return marked.select(*docs.columns, "_marks.*")


def bit_counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the four quarters of each fingerprint, then of the whole: columns of an (n, 5) array."""
    quarters = np.bitwise_count(fp.astype("<u8").view(np.uint16).reshape(-1, 4)).astype(np.int16)
    return np.column_stack([quarters, quarters.sum(axis=1)])


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of a subset of the links a[i]-b[i] between n nodes that connects whatever they all connect."""
    parent = list(range(n))
    used = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            used.append(i)
    return np.array(used, np.int64)


def fewer(a: np.ndarray, b: np.ndarray, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links row-column (a, b), in order of rows, as (row, column) and (row, row) links that connect the same: each column
    keeps its first row, and each row meets the first rows of its columns."""
    first = np.full(columns, -1, np.int64)
    first[b[::-1]] = a[::-1]
    meets = np.zeros((rows, rows), bool)
    meets[a, first[b]] = True
    np.fill_diagonal(meets, False)
    has = np.flatnonzero(first >= 0)
    return first[has], has, *np.nonzero(meets)


def links_of_tiles(left: np.ndarray, right: np.ndarray | None, radius: int, seconds: tuple[np.ndarray, np.ndarray] | None = None, block: int = 256, columns: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between fingerprints at most ``radius`` bits apart, within one tile (right None) or between two.

    Fingerprints are named by their place, those of the right tile from the size of the left one on. ``seconds`` are
    second fingerprints of both tiles that must lie within the radius too. ``block`` rows meet ``columns`` at a time,
    so that a group in which all are linked takes no more memory than any other.
    """
    same = right is None
    right = left if same else right
    shift = 0 if same else len(left)
    boxes = [bit_counts(left), bit_counts(right)]
    found_a, found_b = [], []
    for at in range(0, len(left), block):
        box = boxes[0][at : at + block]
        near = np.flatnonzero(((boxes[1] >= box.min(axis=0) - radius) & (boxes[1] <= box.max(axis=0) + radius)).all(axis=1))
        if same:
            near = near[near > at]
        if not len(near):
            continue
        for some in (near[k : k + columns] for k in range(0, len(near), columns)):
            apart = np.bitwise_count(left[at : at + block, None] ^ right[some][None, :])
            a, b = np.nonzero(apart <= radius)
            if seconds:
                close = np.bitwise_count(seconds[0][at + a] ^ seconds[1][some[b]]) <= radius
                a, b = a[close], b[close]
            if same:
                after = a + at < some[b]
                a, b = a[after], b[after]
            if not len(a):
                continue
            a, b, c, d = fewer(a, b, len(box), len(some))
            found_a += [a + at, c + at]
            found_b += [some[b] + shift, d + at]
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    keep = forest(a, b, len(left) + (0 if same else len(right)))
    return a[keep], b[keep]


def tiles(fps: DataFrame, tile_rows: int) -> DataFrame:
    """(tile, low, high, box, words) from different (fp, second, node), sorted by bit counts.

    Pieces of sorted partitions are put together until they have ``tile_rows`` rows (less than twice as many at most), so
    that tiles are no smaller where there are many partitions. Only the sizes of pieces are summed in one task.
    """
    n, kinds = fps.count(), ("fp", "second", "node")
    ordered = fps.select(*kinds, F.bit_count("fp").alias("_bits"), F.bit_count(F.shiftrightunsigned("fp", 32)).alias("_half"))
    ordered = ordered.repartitionByRange(max(1, -(-n // tile_rows)), "_bits", "_half", "fp", "second").sortWithinPartitions("_bits", "_half", "fp", "second")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for at in range(0, len(some), tile_rows):
                part = some.iloc[at : at + tile_rows]
                yield pd.DataFrame({"rows": [len(part)], **{c: [part[c].to_numpy(np.int64).tobytes()] for c in kinds}})

    pieces = saved(ordered.mapInPandas(cut, "rows int, fp binary, second binary, node binary").withColumn("piece", F.monotonically_increasing_id()))
    before = F.sum("rows").over(Window.orderBy("piece")) - F.col("rows")
    placed = pieces.select("piece", "rows").withColumn("tile", F.floor(before / tile_rows)).drop("rows")
    joined = pieces.join(placed, "piece").groupBy("tile").agg(F.array_sort(F.collect_list(F.struct("piece", *kinds))).alias("xs"))

    def boxed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for row in some.itertuples():
                whole = {c: b"".join(x[c] for x in row.xs) for c in kinds}
                counts = bit_counts(np.frombuffer(whole["fp"], np.uint64))
                yield pd.DataFrame({
                    "tile": [row.tile], "low": [int(counts[:, 4].min())], "high": [int(counts[:, 4].max())],
                    "box_min": [counts.min(axis=0).tolist()], "box_max": [counts.max(axis=0).tolist()], **{c: [whole[c]] for c in kinds},
                })

    return joined.mapInPandas(boxed, "tile long, low int, high int, box_min array<int>, box_max array<int>, fp binary, second binary, node binary")


def fingerprint_links(fps: DataFrame, radius: int = 2, tile_rows: int = 8192, two: bool = False) -> DataFrame:
    """Links (a, b) of nodes that connect all rows of different fp lying at most ``radius`` bits apart, in ``second`` too with ``two``.

    Tile pairs are found by an equi-join on total bit counts over the tiles' ranges and then held against the boxes of
    the quarters; only tile numbers and boxes take part in that join. Loaded pairs are dealt out evenly, a few to a task.
    """
    if "node" not in fps.columns:
        fps = fps.select("fp", F.lit(0).cast("long").alias("second"), F.col("fp").alias("node"))
    tiled = saved(tiles(fps, tile_rows))
    about = tiled.select("tile", "low", "high", "box_min", "box_max")
    home = about.select(*[F.col(c).alias(f"l_{c}") for c in about.columns], F.explode(F.sequence("low", "high")).alias("_at"))
    near = about.select(
        *[F.col(c).alias(f"r_{c}") for c in about.columns],
        F.explode(F.sequence(F.greatest(F.col("low") - radius, F.lit(0)), F.least(F.col("high") + radius, F.lit(64)))).alias("_at"),
    )
    meets = F.forall(
        F.arrays_zip(F.col("l_box_min").alias("a"), F.col("l_box_max").alias("b"), F.col("r_box_min").alias("c"), F.col("r_box_max").alias("d")),
        lambda x: (x["a"] <= x["d"] + radius) & (x["c"] <= x["b"] + radius),
    )
    pairs = saved(home.join(near, "_at").where((F.col("l_tile") <= F.col("r_tile")) & meets).select("l_tile", "r_tile").distinct())
    payload = tiled.select("tile", F.struct("fp", "second", "node").alias("x"))
    loaded = pairs.join(payload.withColumnsRenamed({"tile": "l_tile", "x": "l"}), "l_tile").join(payload.withColumnsRenamed({"tile": "r_tile", "x": "r"}), "r_tile")
    loaded = loaded.repartition(max(1, -(-pairs.count() // 2)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for row in some.to_pylist():
                same = row["l_tile"] == row["r_tile"]
                left, right = ({c: np.frombuffer(row[side][c], np.uint64) for c in ("fp", "second", "node")} for side in "lr")
                a, b = links_of_tiles(left["fp"], None if same else right["fp"], radius, (left["second"], right["second"]) if two else None)
                node = (left["node"] if same else np.concatenate([left["node"], right["node"]])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return loaded.mapInArrow(compare, "a long, b long")


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of the links (a, b), the smallest node that it reaches.

    Alternating star contraction: each node's larger neighbours are tied to its smallest one (large star), then its
    smaller neighbours are (small star), until the links stay the same. Each round ends in a checkpoint.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        edges = saved(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _components(docs: DataFrame, key: str, text: str, mark: str | None = None, *, radius: int = 2, width: int = 3, seed: int = 42, second_seed: int | None = None, tile_rows: int = 8192) -> DataFrame:
    """(key, fp, component_id) for each row; with a column ``mark`` also mark and leads, true for the rows of the component's smallest (key, mark), nulls last."""
    small_batches(docs.sparkSession)
    extra, two = [mark] if mark else [], second_seed is not None
    marked = with_fingerprints(docs.select(key, text, *extra), text, {"fp": seed} | ({"second": second_seed} if two else {}), width)
    marked = marked if two else marked.withColumn("second", F.lit(0).cast("long"))
    marked = saved(marked.select(key, "fp", (F.xxhash64("fp", "second") if two else F.col("fp")).alias("node"), "second", *extra))
    first = [F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(mark).alias("mark"))).alias("_first")] if mark else []
    nodes = saved(marked.groupBy("fp", "second", "node").agg(F.min(key).alias("_least"), *first))
    roots = connected(fingerprint_links(nodes.select("fp", "second", "node"), radius, tile_rows, two)).withColumnRenamed("node", "_node")
    kept = ["_least", *(["_first"] if mark else [])]
    grouped = nodes.join(roots, nodes.node == roots._node, "left").select("node", *kept, F.coalesce("root", "node").alias("root"))
    least = grouped.groupBy("root").agg(F.min("_least").alias("component_id"), *([F.min("_first").alias("_leader")] if mark else []))
    named = grouped.select("node", "root").join(least, "root").drop("root")
    out = marked.join(named, "node", "left")
    if not mark:
        return out.select(key, "fp", "component_id")
    leads = F.col(key).eqNullSafe(F.col("_leader.key")) & (F.col(mark) == F.col("_leader.mark"))
    return out.select(key, "fp", "component_id", mark, leads.alias("leads"))


def simhash_components(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, fp, fingerprint, component_id) for each row; component_id is the smallest key of its component, null where no row of it has a key."""
    found = _components(docs, key, text, **options)
    return found.select(key, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component: that with its smallest key, rows without key last; among rows of that key, the smallest hash of the whole row.

    Rows are decided on one by one: a key that is repeated with other texts stays once in each component that it leads,
    and a component without any key keeps one of its rows. All columns of ``docs`` stay. Texts are read again rather
    than shuffled, as long as the rows that go are few enough for their keys and hashes to be broadcast.
    """
    rows = docs.withColumn("_row", row_mark(*docs.columns))
    found = saved(_components(rows, key, text, "_row", **options))
    stay = without(rows, found.where("not leads"), key, "_row")
    twice = found.where("leads").groupBy(key, "_row").count().where("count > 1")
    if not twice.isEmpty():  # rows that are equal in every column
        several = without(stay, twice, key, "_row", how="left_semi").dropDuplicates(docs.columns)
        stay = without(stay, twice, key, "_row").unionByName(several)
    return stay.drop("_row")
