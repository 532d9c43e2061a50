"""Benchmark decontamination with suffix arrays of the training text.

Each task cuts its documents into shards of bounded size, and keeps of a shard the stretches whose words all occur in
the benchmark and that are at least as long as its shortest window (no other suffix can match a window whole). A suffix
array of these stretches is sorted by prefix doubling with numpy; the windows at which test suffixes begin are
binary-searched in it, all at once, which gives every place of every verbatim match. Windows whose hash no stretch of the
shard has can't occur and aren't searched. Matches at successive places of a document and an item are joined to longest
matches. Documents are never shuffled.

Items with one text are one. The benchmark is read in blocks of bounded text, whose windows are built in the tasks. Where
there is more than one block, the rows are saved after each pass with what was hit, and the block is
freed; so neither driver nor workers ever hold more than one block.

Defined results: null and empty texts have no words and no hits; an empty benchmark hits nothing. Items without words
have no windows; items with the same text all count. Item ids are compared as strings; a repeated item_id counts once.
Windows of items without id hit like any other: all such items together count once in n_items, and aren't in the list
of items. The longest match is the most words in a row that a document and an item share, where that is at least a
window (an item shorter than a window must occur whole); else 0.
Repeated documents each get their own row. Input columns named _row are not carried.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, process_store, row_mark, saved, small_batches, without

#: Characters of benchmark text in a block; what one pass gives each worker.
BLOCK_CHARS = 24_000_000
#: Words of documents in a shard.
SHARD_WORDS = 1_000_000


def window_hashes(words: np.ndarray, lengths: set[int], multiplier: int) -> dict[int, np.ndarray]:
    """For each wanted length the hashes of all stretches of so many words, by their start."""
    factor = np.uint64(multiplier)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out, h = {}, np.zeros(len(words), np.uint64)
    for n in range(1, max(lengths) + 1):
        h = h[: len(words) - n + 1] * factor + mixed[n - 1 :]
        if n in lengths:
            out[n] = (h ^ (h >> np.uint64(32))) * factor + np.uint64(n)
    return out


class Windows:
    """The different windows of the texts of a block: hashes in order, words, lengths, and all their places."""

    def __init__(self, texts: list[tuple[str, list[str], bool]], width: int = 13):
        self.width, self.word_ids = width, {}
        self.texts = [(items, unnamed) for _, items, unnamed in texts]
        coded = [np.array([self.word_ids.setdefault(w, len(self.word_ids) + 1) for w in alnum_words(t)] + [0], np.int32) for t, *_ in texts]
        size = np.array([len(c) - 1 for c in coded], np.int64)
        self.flat = np.concatenate([*coded, np.zeros(width, np.int32)])
        begin = np.cumsum(size + 1) - size - 1
        n = np.where(size > 0, np.maximum(size - width + 1, 1), 0)
        text = np.repeat(np.arange(len(texts)), n)
        start = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + begin[text]
        length = np.minimum(size[text], width)
        self.lengths = {int(x) for x in np.unique(length)}
        for self.multiplier in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
            hashes, by_length = np.zeros(len(start), np.uint64), window_hashes(self.flat, self.lengths, self.multiplier) if self.lengths else {}
            for k, h in by_length.items():
                hashes[length == k] = h[start[length == k]]
            self.hashes, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
            self.start, self.length = start[first], length[first]
            same = length == self.length[kind]
            for k in range(width):
                same &= (k >= length) | (self.flat[np.minimum(start + k, len(self.flat) - 1)] == self.flat[np.minimum(self.start[kind] + k, len(self.flat) - 1)])
            if same.all():
                break
        else:
            raise RuntimeError("windows with other words have the same hash")
        order = np.argsort(kind, kind="stable")
        self.bound = np.searchsorted(kind[order], np.arange(len(self.hashes) + 1))
        self.place, self.text = start[order], text[order].astype(np.int32)
        self.shortest = int(self.length.min()) if len(self.length) else 0
        self._items: dict[int, frozenset[str | None]] = {}

    def items(self, k: int) -> frozenset[str | None]:
        if k not in self._items:
            found = [self.texts[t] for t in self.text[self.bound[k] : self.bound[k + 1]].tolist()]
            self._items[k] = frozenset(i for items, _ in found for i in items) | frozenset([None] if any(u for _, u in found) else [])
        return self._items[k]

    def words(self, which: np.ndarray) -> np.ndarray:
        """Words of windows, one row each; beyond a window's length other words follow."""
        return self.flat[self.start[which][:, None] + np.arange(self.width)].astype(np.int64)

    def possible(self, words: np.ndarray) -> np.ndarray:
        """The windows whose hash some stretch of ``words`` has."""
        some = {n for n in self.lengths if n <= len(words)}
        found = [np.searchsorted(self.hashes, h) for h in window_hashes(words, some, self.multiplier).values() for h in [np.unique(h)] for h in [h[np.isin(h, self.hashes, assume_unique=True)]]] if some else []
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``words`` in the order of their first ``depth`` words."""
    rank, step = words.astype(np.int64), 1
    while step < depth:
        ahead = np.zeros_like(rank)
        ahead[:-step] = rank[step:]
        different, rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)
        step *= 2
        if len(different) == len(rank):
            break
    return np.argsort(rank, kind="stable")


def places(words: np.ndarray, order: np.ndarray, wanted: Windows, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end index in ``order`` of the suffixes that begin with each window: one binary search for all."""
    padded = np.concatenate([words.astype(np.int64), np.zeros(wanted.width, np.int64)])
    target, length = wanted.words(some), wanted.length[some]
    inside = np.arange(wanted.width)[None, :] < length[:, None]

    def search(beyond: bool) -> np.ndarray:
        low, high = np.zeros(len(target), np.int64), np.full(len(target), len(order), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            start = order[np.minimum(mid, len(order) - 1)]
            sign = np.where(inside, np.sign(padded[start[:, None] + np.arange(wanted.width)] - target), 0)
            first = np.argmax(sign != 0, axis=1)
            side = sign[np.arange(len(sign)), first]
            right = open_ & ((side < 0) | (beyond & (side == 0)))
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)
        return low

    return search(False), search(True)


def shard_hits(docs: list[list[bytes]], wanted: Windows) -> dict[int, tuple[list[tuple[int, int]], set[str | None], int]]:
    """For each document of a shard with a match: covered word ranges, items, and the longest match in words."""
    get = wanted.word_ids.get
    ids = np.fromiter((get(w, 0) for d in docs for w in (*d, b"")), np.int64, sum(map(len, docs)) + len(docs))
    known = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]]).astype(np.int8)))
    begin, end = known[::2], known[1::2]
    long_enough = end - begin >= wanted.shortest
    begin, end = begin[long_enough], end[long_enough]
    if not len(begin):
        return {}
    size = end - begin + 1  # each with the 0 behind it, which matches nothing
    shift = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    at = np.arange(int(size.sum())) + shift
    words = ids[at]
    possible = wanted.possible(words)
    if not len(possible):
        return {}
    order = suffix_array(words, int(wanted.length[possible].max()))
    starts, kinds = [], []
    for k in range(0, len(possible), 1 << 15):
        some = possible[k : k + (1 << 15)]
        first, stop = places(words, order, wanted, some)
        n = stop - first
        starts.append(order[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
        kinds.append(np.repeat(some, n))
    start, kind = np.concatenate(starts), np.concatenate(kinds)
    sort = np.lexsort((kind, start))
    start, kind = at[start[sort]], kind[sort]
    doc_start = np.cumsum([0] + [len(d) + 1 for d in docs])
    doc = np.searchsorted(doc_start, start, side="right") - 1
    out: dict[int, tuple[list[tuple[int, int]], set[str | None], int]] = {}
    before, runs = -2, {}  # the last full window's start, and by place in the benchmark how many windows in a row end there
    for s, k, n, d in zip(start.tolist(), kind.tolist(), wanted.length[kind].tolist(), doc.tolist(), strict=True):
        ranges, items, longest = out.get(d, ([], set(), 0))
        a, b = s - int(doc_start[d]), s + n - int(doc_start[d])
        if ranges and a <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(ranges[-1][1], b))
        else:
            ranges.append((a, b))
        items |= wanted.items(k)
        if n == wanted.width:  # one such window at most begins at a word
            last = runs if before == s - 1 else {}
            runs = {q: last.get(q - 1, 0) + 1 for q in wanted.place[wanted.bound[k] : wanted.bound[k + 1]].tolist()}
            before, n = s, n - 1 + max(runs.values())
        out[d] = (ranges, items, max(longest, n))
    return out


def merged(old, new: list[tuple[int, int]]) -> list[dict]:
    """Two lists of ranges as one without overlaps."""
    out: list[list[int]] = []
    for a, b in sorted([*((r["a"], r["b"]) for r in old), *new]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"a": a, "b": b} for a, b in out]


def hits(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", width: int = 13) -> DataFrame:
    """(key, n_words, n_hit, n_items, items, ranges, longest_match) of each row; ranges are the covered words [a, b)."""
    small_batches(docs.sparkSession)
    tests = benchmark.select(F.col(item).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    tests = saved(tests.groupBy("text").agg(F.collect_set("item").alias("items"), F.bool_or(F.col("item").isNull()).alias("unnamed")))
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, text string, n_words long, ranges array<struct<a:int,b:int>>, items array<string>, unnamed boolean, longest_match int"
    rows = docs.select(key, F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<a:int,b:int>>").alias("ranges"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("unnamed"), F.lit(0).alias("longest_match"))
    for b in range(blocks):
        block = tests.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in block.toLocalIterator()])

        def scan(batches: Iterator[pd.DataFrame], shared=shared, mark=uuid.uuid4().hex, last=b == blocks - 1) -> Iterator[pd.DataFrame]:
            store = process_store("windows")
            if mark not in store:
                store.clear()
                store[mark] = Windows(shared.value, width)
            wanted = store[mark]
            for some in batches:
                words, n, first = [], 0, 0
                for i in range(len(some) + 1):
                    if i == len(some) or n >= SHARD_WORDS:
                        part = some.iloc[first:i].copy()
                        found = shard_hits(words, wanted) if len(wanted.length) else {}
                        part["n_words"] = [len(w) for w in words]
                        part["ranges"] = [merged(r, found[j][0]) if j in found else r for j, r in enumerate(part["ranges"])]
                        part["items"] = [sorted({*x, *found[j][1]} - {None}) if j in found else x for j, x in enumerate(part["items"])]
                        part["unnamed"] = [x or j in found and None in found[j][1] for j, x in enumerate(part["unnamed"])]
                        part["longest_match"] = [max(x, found[j][2]) if j in found else x for j, x in enumerate(part["longest_match"])]
                        if last:
                            part["text"] = None
                        yield part
                        words, n, first = [], 0, i
                    if i < len(some):
                        words.append(alnum_words(some["text"].iloc[i]))
                        n += len(words[-1])

        rows = rows.mapInPandas(scan, schema)
        if b < blocks - 1:
            rows = saved(rows)
            shared.destroy()
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + (r.b - r.a))
    return rows.select(key, "n_words", n_hit.alias("n_hit"), (F.size("items") + F.col("unnamed").cast("int")).cast("long").alias("n_items"), F.array_sort("items").alias("items"), "ranges", "longest_match")


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated themselves; all columns stay.

    A row goes by its own text, found again by a hash of its key and text, so rows with a null key, and other texts of the same key, are decided on alone.
    """
    rows = docs.withColumn("_row", row_mark(key, text))
    bad = hits(rows, benchmark, key="_row", text=text, **options).where(contaminated())
    return without(rows, bad, "_row").drop("_row")
