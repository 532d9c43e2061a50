"""Token ids of whole texts in a word-aligned binary file (Simple-8b).

Documents are sorted by key into shards (one for each task), encoded with a public tokenizer and packed into blocks of
whole documents. Each 64-bit word has a selector in its top four bits, which says how many ids of how many bits the
other 60 hold; ids of more than 60 bits are escaped: a word with selector 0, then the id as a raw word, whose place the
block lists. A block carries the offsets needed to decode it alone with numpy: ids and words before it in its shard, and
the keys and id counts of its documents. Blocks are rows of a Parquet table that Spark writes and reads, so that
the file lies wherever Spark can write and a lost task is simply run again.

Defined results: null and empty texts have the end id only. Rows with the same key keep an order by text. An empty
table gives an empty file. Documents without key come first.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import process_store, scratch_path, small_batches

#: Fixed values of the format: (ids, bits of each) by selector; selector 0 is the escape.
SELECTORS = ((1, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
COUNTS = np.array([n for n, _ in SELECTORS], np.int64)
BLOCK_IDS = 1 << 16
#: Strings in a generation that a worker remembers, and ids in it.
REMEMBERED, REMEMBERED_IDS = 150_000, 2_000_000
#: Bytes of text that are encoded at once; a longer text is taken whole.
BATCH_BYTES = 8_000_000


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, places of raw words) of unsigned 64-bit ids; each word takes as many ids as fit, zeros fill the last."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    ids = np.concatenate([ids.astype(np.uint64), np.zeros(60, np.uint64)])
    bits = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)
    big = ids >= np.uint64(1 << 60)
    bits[big] = 64
    bits[(bits > 60) & ~big] = 60  # rounded up by the float
    most, selector = {1: bits}, np.where(big, 0, 14).astype(np.uint8)
    for k in range(13, 0, -1):
        count, width = SELECTORS[k]
        have = max(c for c in most if c < count)
        more = max(c for c in most if c >= count - have)
        most[count] = np.maximum(most[have][: len(most[more]) - (count - more)], most[more][count - more :])[: max(0, len(ids) - count + 1)]
        selector[: len(most[count])][most[count] <= width] = k
    step = COUNTS[selector].tolist()
    at, places = 0, []
    while at < n:
        places.append(at)
        at += step[at]
    places = np.array(places)
    kind = selector[places]
    slot = np.arange(len(places)) + np.concatenate([[0], np.cumsum(kind == 0)[:-1]])
    words = np.zeros(len(places) + int((kind == 0).sum()), np.uint64)
    for k in np.unique(kind):
        here = kind == k
        count, width = SELECTORS[k]
        if k == 0:
            words[slot[here] + 1] = ids[places[here]]
            continue
        shifts = (np.arange(count) * width).astype(np.uint64)
        values = ids[places[here][:, None] + np.arange(count)] << shifts
        words[slot[here]] = np.bitwise_or.reduce(values, axis=1) | (np.uint64(k) << np.uint64(60))
    return words, (slot[kind == 0] + 1).astype(np.int32)


def unpack(words: np.ndarray, raw_at: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a block."""
    coded = np.ones(len(words), bool)
    coded[raw_at] = False
    at = np.flatnonzero(coded)
    kind = (words[at] >> np.uint64(60)).astype(np.int64)
    ends = np.cumsum(COUNTS[kind])
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    begin = ends - COUNTS[kind]
    for k in np.unique(kind):
        here = kind == k
        count, width = SELECTORS[k]
        if k == 0:
            out[begin[here]] = words[at[here] + 1]
            continue
        shifts = (np.arange(count) * width).astype(np.uint64)
        out[begin[here][:, None] + np.arange(count)] = (words[at[here]][:, None] >> shifts) & np.uint64((1 << width) - 1)
    return out[:n]


#: A word of letters that keep their form when normalised, and marks behind it.
_PLAIN = r"^(?P<word>[a-zA-Zß-öø-ÿÀ-ÖØ-Þ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"


def ragged(ids: np.ndarray, at: np.ndarray, size: np.ndarray, part: int = 1 << 18) -> np.ndarray:
    """ids[at[i] : at[i] + size[i]] for all i, one after the other."""
    out, done = np.empty(int(size.sum(dtype=np.int64)), ids.dtype), 0
    for k in range(0, len(at), part):
        a, n = at[k : k + part].astype(np.int64), size[k : k + part].astype(np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1])
        out[done : done + total] = ids[np.repeat(a - ends + n, n) + np.arange(total)]
        done += total
    return out


class Remembered:
    """Id sequences of strings, found by number; what is used stays for this generation and the next.

    ``learn`` gives (ids, first, number of ids) of strings that aren't known.
    """

    def __init__(self, learn):
        self.learn = learn
        self.old: tuple = ({}, *self._none())
        self._fresh()

    @staticmethod
    def _none() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _fresh(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.at, self.size = self._none()

    def _add(self, ids: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        self.at = np.concatenate([self.at, at + len(self.ids)])
        self.ids, self.size = np.concatenate([self.ids, ids]), np.concatenate([self.size, size.astype(np.int32)])

    def numbers(self, strings: pa.Array) -> np.ndarray:
        """Places in ``at`` and ``size`` of different strings; they hold until the next call."""
        if len(self.index) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self.old = self.index, self.ids, self.at, self.size
            self._fresh()
        names, index, before = strings.to_numpy(zero_copy_only=False).tolist(), self.index, self.old[0]
        found = np.fromiter(map(index.get, names, repeat(-1)), np.int64, len(names))
        unknown = np.flatnonzero(found < 0)
        if before and len(unknown):
            was = np.array([before.get(names[i], -1) for i in unknown.tolist()], np.int64)
            again, was = unknown[was >= 0], was[was >= 0]
            unknown = unknown[found[unknown] < 0] if not len(again) else np.setdiff1d(unknown, again, assume_unique=True)
            size = self.old[3][was]
            self._number(found, again, names)
            self._add(ragged(self.old[1], self.old[2][was], size), np.cumsum(size, dtype=np.int64) - size, size)
        if len(unknown):
            self._number(found, unknown, names)
            self._add(*self.learn(strings.take(pa.array(unknown))))
        return found

    def _number(self, found: np.ndarray, which: np.ndarray, names: list[str]) -> None:
        first = len(self.at)
        found[which] = np.arange(first, first + len(which))
        self.index.update(zip([names[i] for i in which.tolist()], range(first, first + len(which)), strict=True))


class Encoder:
    """Ids of whole texts.

    For a tokenizer that lowers case, drops white space and ends its words with a suffix, a text is cut at ASCII white
    space, and the ids of its chunks, one after the other, are the ids of the text. Texts are cut and their different
    chunks found in Arrow; the ids of chunks are remembered for a while, up to a fixed number. Of new chunks, plain words
    are lowered here and encoded many at a time by the same model without its normaliser, apart from the marks behind
    them. Any other tokenizer is given whole texts.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        suffix = spec["model"].get("end_of_word_suffix")
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.by_chunk = bool(suffix) and steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("invert") is True
        if self.by_chunk:
            self.plain = Tokenizer.from_str(tokenizer_json)
            self.plain.normalizer = None
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.ends = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True
            self.chunks, self.words, self.marks = Remembered(self._learn_chunks), Remembered(self._learn_words), Remembered(self._whole)

    def _whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, number of ids) of texts given to the tokenizer as they are."""
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        size = np.fromiter(map(len, coded), np.int64, len(coded))
        return np.fromiter(chain.from_iterable(coded), np.uint32, int(size.sum())), np.cumsum(size) - size, size

    def _learn_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower-case words, many to a call; each ends with the one id that has the suffix."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        coded = self.plain.encode_batch_fast([" ".join(names[i : i + 500]) for i in range(0, len(names), 500)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in coded])
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(names):
            return self._whole(words)
        first = np.concatenate([[0], stop[:-1]])
        return ids, first, stop - first

    def _learn_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = pc.extract_regex(chunks, _PLAIN)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        at, size, ids = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), []
        if plain.any():
            known, places = cut.filter(cut.is_valid()), []
            for store, strings in ((self.words, pc.utf8_lower(known.field("word"))), (self.marks, known.field("marks"))):
                coded = strings.dictionary_encode()
                number = store.numbers(coded.dictionary)[coded.indices.to_numpy()]
                places.append((store.at[number], store.size[number]))
            (word_at, word_size), (mark_at, mark_size) = places
            both = np.column_stack([word_size, mark_size])
            ids.append(ragged(np.concatenate([self.words.ids, self.marks.ids]), np.column_stack([word_at, mark_at + len(self.words.ids)]).ravel(), both.ravel()))
            size[plain] = both.sum(axis=1)
            at[plain] = np.cumsum(size[plain]) - size[plain]
        if not plain.all():
            more, first, n = self._whole(chunks.filter(pa.array(~plain)))
            at[~plain], size[~plain] = first + sum(map(len, ids)), n
            ids.append(more)
        return np.concatenate(ids), at, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); null is an empty text."""
        texts = texts.fill_null("")
        if not self.by_chunk:
            ids, _, size = self._whole(texts)
            return ids, size
        cut = pc.ascii_split_whitespace(texts)
        coded = cut.flatten().dictionary_encode()
        number = self.chunks.numbers(coded.dictionary)[coded.indices.to_numpy()]
        size = self.chunks.size[number]
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[np.cumsum(np.concatenate([[0], cut.value_lengths().to_numpy()]))]
        return ragged(self.chunks.ids, self.chunks.at[number], size), np.diff(ends)


def in_batches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of some bytes together, or of one longer text."""
    size, first, held = pc.binary_length(texts).fill_null(0).to_pylist(), 0, 0
    for i, n in enumerate(size):
        if held and held + n > BATCH_BYTES:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(size):
        yield first, len(size)


BLOCK_SCHEMA = "shard int, block int, id_start long, word_start long, n_ids long, keys array<long>, id_counts array<int>, raw_at binary, words binary"

BLOCK_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("id_start", pa.int64()), ("word_start", pa.int64()), ("n_ids", pa.int64()),
    ("keys", pa.list_(pa.int64())), ("id_counts", pa.list_(pa.int32())), ("raw_at", pa.binary()), ("words", pa.binary()),
])


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, *, key: str = "doc_id", text: str = "text", end_id: int | None = 2, block_ids: int = BLOCK_IDS, order: str | None = None) -> None:
    """Writes the ids of all texts, in ascending key order, or in that of the column ``order``, as blocks under ``path``; rows with equal values stand in order of key and text."""
    small_batches(docs.sparkSession)
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store = process_store("encoders")
        mark = (len(shared.value), hash(shared.value))
        encoder = store[mark] if mark in store else store.setdefault(mark, Encoder(shared.value))
        shard, block, ids_before, words_before = TaskContext.get().partitionId(), 0, 0, 0
        keys: list[int | None] = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal block, ids_before, words_before, keys, counts, held, size
            words, raw = pack(np.concatenate(held))
            row = {
                "shard": shard, "block": block, "id_start": ids_before, "word_start": words_before, "n_ids": size,
                "keys": keys, "id_counts": counts, "raw_at": raw.astype("<i4").tobytes(), "words": words.astype("<u8").tobytes(),
            }
            block, ids_before, words_before = block + 1, ids_before + size, words_before + len(words)
            keys, counts, held, size = [], [], [], 0
            return pa.RecordBatch.from_pylist([row], BLOCK_ARROW)

        for some in batches:
            for first, stop in in_batches(some.column("text")):
                ids, sizes = encoder.encode(some.column("text").slice(first, stop - first))
                at = 0
                for k, n in zip(some.column("key").slice(first, stop - first).to_pylist(), sizes.tolist(), strict=True):
                    keys.append(k)
                    counts.append(n + len(end))
                    held += [ids[at : at + n], end]
                    at, size = at + n, size + counts[-1]
                    if size >= block_ids:
                        yield close()
        if keys:
            yield close()

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), *([F.col(order).alias("order")] if order else []))
    first = ["order"] if order else []
    rows = rows.repartitionByRange(*first, "key").sortWithinPartitions(*first, "key", "text").select("key", "text")
    rows.mapInArrow(blocks, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, *, ids: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of each document in a token file; start counts the ids of all before it.

    The ids in each shard, one number for each, go through the driver to place the shards; all else stays in the tasks.
    """
    blocks = spark.read.parquet(path)
    totals = sorted(tuple(r) for r in blocks.groupBy("shard").agg(F.sum("n_ids")).collect())
    base = dict(zip([s for s, _ in totals], accumulate([0] + [n for _, n in totals]), strict=False))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for row in some.itertuples():
                flat = unpack(np.frombuffer(row.words, "<u8"), np.frombuffer(row.raw_at, "<i4"), row.n_ids).astype("<u4")
                counts = np.asarray(row.id_counts, np.int64)
                ends = np.cumsum(counts)
                data = flat.tobytes()
                out = pd.DataFrame({
                    key: pd.array(row.keys, "Int64"), "start": base[row.shard] + row.id_start + ends - counts, "n_tokens": counts,
                    "ids_crc32": [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)],
                })
                if ids:
                    out["ids"] = [flat[e - c : e].astype(np.int64) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield out

    return blocks.mapInPandas(documents, f"`{key}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)


def token_digest(docs: DataFrame, tokenizer_file: str, *, key: str = "doc_id", text: str = "text", end_id: int | None = 2, path: str | None = None, order: str | None = None) -> DataFrame:
    """Writes docs as a token file (in the shared folder unless ``path`` is given) and reads it back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_file, key=key, text=text, end_id=end_id, order=order)
    return read_tokens(docs.sparkSession, path, key=key)
