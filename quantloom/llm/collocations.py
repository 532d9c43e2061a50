"""Collocations: phrases of two to four words that stand together more often than their parts.

Every n-gram of a text is hashed by Rabin-Karp fingerprints: prefix polynomials over the bytes of the canonical text (words
with one space between) modulo two primes, in numpy, so that the fingerprint of any run of words is a difference of two
prefixes times an inverse power. Tasks count fingerprints and send them as packed ascending blocks, one for each range of
fingerprints; the ranges add them up. A phrase can't be frequent
unless its parts are, so words are counted first, then pairs of frequent words, then runs of three and four whose pairs are
frequent; what is frequent so far is known to the tasks as a table of bits of fixed size (it may take a rare
fingerprint for a frequent one, which costs a row, and never the other way round). Counts of fingerprints are upper
bounds: texts that collide add up. A last pass therefore sends the frequent fingerprints with occurrence
pointers and the text found there; tasks and ranges compare every occurrence with the first one byte for byte and count texts, not
fingerprints. Only texts of frequent fingerprints are ever materialised. Scores, cuts and containments are joins and sums over the frequent phrases.

Texts are hashed in stretches of about STRETCH bytes that end at a word, with the next three words for the runs that begin before the end, so
memory depends neither on the length of a text nor on the size of a partition, but for single words of many megabytes.

Defined results: null and empty texts have no words; null languages are ``und``. Repeated rows count each time. An empty
table gives an empty result. Other columns than text, language and key aren't read; a key that is no number is a null in pointers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, scratch_path, small_batches

C = F.col
#: A-Z in lower case, tab as space, what splits pieces as a line feed; all other bytes stay.
CANON = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))
STRETCH = 1 << 19
#: Two primes below 2^31 and bases for them.
FIELDS = ((2_147_483_647, 1_000_003), (2_147_483_629, 770_999))
#: Different fingerprints that a task holds before it sends them on.
HELD = 1 << 21
#: Word occurrences for each range of fingerprints; a task of a range adds up its different fingerprints.
RANGE_WORDS = 1 << 23
#: The table of frequent fingerprints has 2^TABLE_BITS bits (32 MB), whatever is frequent.
TABLE_BITS = 28
LOOKAHEAD = re.compile(rb"(?:[ \n]*[^ \n]+){0,3}")
SEPARATOR = re.compile(rb"[ \n]")


def stretches(raw: bytes, size: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, own): pieces of a canonical text; runs that begin before ``own`` belong to the piece, the three words behind it only continue them."""
    at = 0
    while len(raw) - at > size:
        cut = SEPARATOR.search(raw, at + size)
        if cut is None:
            break
        end = LOOKAHEAD.match(raw, cut.start()).end()
        yield raw[at:end], cut.start() - at
        at = cut.start()
    yield raw[at:], len(raw) - at


class Powers:
    """Powers of a base and of its inverse modulo a prime, made longer when needed."""

    def __init__(self):
        self.tables = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in FIELDS]

    def upto(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        while len(self.tables[0][0]) < n:
            size = len(self.tables[0][0])
            longer = []
            for (p, base), pair in zip(FIELDS, self.tables, strict=True):
                steps = (pow(base, size, p), pow(pow(base, -1, p), size, p))
                longer.append(tuple(np.concatenate([t, t * np.uint64(s) % np.uint64(p)]) for t, s in zip(pair, steps, strict=True)))
            self.tables = longer
        return self.tables


class Stretch:
    """Words and fingerprints of texts put one behind the other; ``documents`` has for each part its bytes, what is its own, a code of its language, its row and its word number."""

    def __init__(self, parts: list[tuple[bytes, int, int, int, int]], powers: Powers):
        joined = b"\n".join(p[0] for p in parts) + b"\n"
        raw = np.frombuffer(joined, np.uint8)
        inside = (raw != 32) & (raw != 10)
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        piece = np.cumsum(raw == 10, dtype=np.int64)[starts] if len(starts) else starts
        lengths = np.array([len(p[0]) + 1 for p in parts], np.int64)
        begins = np.cumsum(lengths) - lengths
        part = np.searchsorted(begins, starts, side="right") - 1
        self.own = starts - begins[part] < np.array([p[1] for p in parts], np.int64)[part]
        self.lang = np.array([p[2] for p in parts], np.int64)[part]
        self.row = np.array([p[3] for p in parts], np.int64)[part]
        first = np.searchsorted(starts, begins)
        self.number = np.array([p[4] for p in parts], np.int64)[part] + np.arange(len(starts)) - first[part]
        keep = inside.copy()
        keep[ends] = True  # one space behind each word
        self.text = np.where(inside, raw, 32)[keep].tobytes()
        place = np.cumsum(keep) - 1
        self.starts, self.ends = place[starts], place[ends]
        follows = np.append(piece[1:] == piece[:-1], False) if len(piece) else np.zeros(0, bool)
        self.runs = {1: np.ones(len(starts), bool)}
        for n in (2, 3, 4):
            longer = np.zeros(len(starts), bool)
            longer[: max(0, len(starts) - n + 1)] = self.runs[n - 1][: max(0, len(starts) - n + 1)] & follows[n - 2 :][: max(0, len(starts) - n + 1)]
            self.runs[n] = longer
        self.prefix = []
        tables = powers.upto(len(self.text) + 1)
        for (p, _), (power, _) in zip(FIELDS, tables, strict=True):
            terms = np.frombuffer(self.text, np.uint8).astype(np.uint64) * power[: len(self.text)] % np.uint64(p)
            self.prefix.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)]))  # below 2^63 up to 2^32 bytes
        self.tables = tables

    def fingerprints(self, n: int, at: np.ndarray) -> np.ndarray:
        """Of the runs of n words that begin at the words ``at``: 62 bits, mixed with the language."""
        s, e = self.starts[at], self.ends[at + n - 1]
        both = [(h[e] - h[s]) % np.uint64(p) * inverse[s] % np.uint64(p) for (p, _), (_, inverse), h in zip(FIELDS, self.tables, self.prefix, strict=True)]
        mixed = (both[0] << np.uint64(31) | both[1]) + self.lang[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        return (mixed * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)

    def frequent(self, n: int, known: dict[int, Table]) -> np.ndarray:
        """The words at which a run of n words begins whose parts are all in the tables known."""
        at = np.flatnonzero(self.runs[n])
        base = 1 if n == 2 else 2
        if n > 1 and len(at):
            good = np.zeros(len(self.starts) + 4, bool)
            some = np.flatnonzero(self.runs[base])
            good[some] = known[base].has(self.fingerprints(base, some))
            for k in range(n - base + 1):
                at = at[good[at + k]]
        return at


class Table:
    """A set of longs as bits of a table of fixed size; it may hold more than it was given, never less."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        bit = keys.view(np.uint64) >> np.uint64(64 - TABLE_BITS)
        return (self.words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)


def frequent_table(keys: DataFrame, key: str = "_f"):
    """The keys as a broadcast table; at most 2^(TABLE_BITS - 6) words reach the driver, whatever the number of keys."""
    spark = keys.sparkSession
    place = F.shiftrightunsigned(C(key), 64 - TABLE_BITS)
    words = keys.groupBy(F.shiftright(place, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("b")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(table)


def _rows(docs: DataFrame, text: str, lang: str, key: str) -> DataFrame:
    return docs.select(C(text).cast("string").alias("_text"), F.coalesce(C(lang).cast("string"), F.lit("und")).alias("_lang"), C(key).try_cast("long").alias("_key"))


def _code(lang: str) -> int:
    import zlib

    return zlib.crc32(lang.encode("utf-8", "surrogatepass")) + 1


def _stretches_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list, list]]:
    """(parts, languages, keys): texts of a task together up to about ``size`` bytes."""
    parts, langs, keys, held = [], [], [], 0
    for batch in batches:
        for raw, lang, key in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if not raw:
                continue
            keys.append(key)
            langs.append(lang)
            word = 0
            for piece, own in stretches(raw.translate(CANON), size):
                parts.append((piece, own, _code(lang), len(keys) - 1, word))
                held += len(piece) + 64
                if own < len(piece):
                    word += len(piece[:own].split())
                if held >= size:
                    yield parts, langs, keys
                    parts, held = [], 0
                    langs, keys = [lang], [key]
    if parts:
        yield parts, langs, keys


def pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers as zstd over their bytes by significance; the first array ascends and goes as differences."""
    codec, parts = pa.Codec("zstd"), []
    for i, x in enumerate(arrays):
        x = np.diff(x, prepend=x.dtype.type(0)) if i == 0 else x
        planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
        parts.append(codec.compress(planes.tobytes(), asbytes=True))
    return b"".join([len(arrays[0]).to_bytes(4, "little"), *[y for z in parts for y in (len(z).to_bytes(4, "little"), z)]])


def unpack(block: bytes, *types) -> list[np.ndarray]:
    codec, n, at, out = pa.Codec("zstd"), int.from_bytes(block[:4], "little"), 4, []
    for i, t in enumerate(types):
        size, item = int.from_bytes(block[at : at + 4], "little"), np.dtype(t).itemsize
        planes = np.frombuffer(codec.decompress(block[at + 4 : at + 4 + size], n * item, asbytes=True), np.uint8)
        x = np.ascontiguousarray(planes.reshape(item, n).T).reshape(-1).view(t)
        out.append(np.cumsum(x, dtype=t) if i == 0 else x)
        at += 4 + size
    return out


def ranges_of(f: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the even ranges of fingerprints begins among ascending ones."""
    limits = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(f, limits), [len(f)]]).astype(np.int64)


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different fingerprints, ascending, with added counts."""
    f, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(f, kind="stable")
    f, n = f[order], n[order]
    first = np.flatnonzero(np.append(True, f[1:] != f[:-1])) if len(f) else np.zeros(0, np.int64)
    return f[first], np.add.reduceat(n, first) if len(f) else n


def counted_fingerprints(rows: DataFrame, sizes: tuple[int, ...], known: dict, least: int, size: int, ranges: int) -> DataFrame:
    """(_f, n) of the runs of these sizes that occur ``least`` times or more, by fingerprint, whose parts are known as frequent.

    A task sends one block of ascending fingerprints with counts to each range of fingerprints; a range adds them up.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, total = Powers(), [], 0
        tables = {n: Table(t.value) for n, t in known.items()}

        def out():
            f, n = _added(held)
            cuts = ranges_of(f, ranges)
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                cut = slice(cuts[r], cuts[r + 1])
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([pack(f[cut], n[cut].astype(np.uint32))], pa.binary())], ["_r", "_b"])

        for parts, _, _ in _stretches_of(batches, size):
            made = Stretch(parts, powers)
            for n in sizes:
                at = made.frequent(n, tables)
                f, counts = np.unique(made.fingerprints(n, at[made.own[at]]).view(np.uint64), return_counts=True)
                held.append((f, counts))
                total += len(f)
            if total > HELD:
                held = [_added(held)]
                total = len(held[0][0])
                if total > HELD // 2:
                    yield from out()
                    held, total = [], 0
        if held:
            yield from out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for block in batch.column(1).to_pylist():
                f, n = unpack(block, np.uint64, np.uint32)
                held.append((f, n.astype(np.int64)))
                total += len(f)
                if total > 2 * HELD:
                    held = [_added(held)]
                    total = 0  # what is left is different, and as much as the range has
        if held:
            f, n = _added(held)
            f, n = f[n >= least].view(np.int64), n[n >= least]
            for at in range(0, len(f), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(f[at : at + 100_000]), pa.array(n[at : at + 100_000])], ["_f", "n"])

    blocks = rows.mapInArrow(count, "_r int, _b binary")
    return saved(blocks.repartitionById(ranges, "_r").mapInArrow(add, "_f long, n long"))


class Texts:
    """Fingerprints with counts, pointers (key, word) and the text at the pointer: language, line feed, phrase."""

    def __init__(self, f, n, key, word, length, text: bytes):
        self.f, self.n, self.key, self.word, self.length, self.text = f, n, key, word, length, text
        self.start = np.cumsum(length) - length

    @classmethod
    def joined(cls, some: list[Texts]) -> Texts:
        return cls(*[np.concatenate([getattr(x, c) for x in some]) for c in ("f", "n", "key", "word", "length")], b"".join(x.text for x in some))

    def taken(self, at: np.ndarray, n: np.ndarray) -> Texts:
        size = self.length[at]
        begin = np.cumsum(size) - size
        raw = np.frombuffer(self.text, np.uint8)[np.repeat(self.start[at] - begin, size) + np.arange(int(size.sum()))]
        return Texts(self.f[at], n, self.key[at], self.word[at], size, raw.tobytes())

    def added(self) -> Texts:
        """One row for each different text: rows of one fingerprint are compared with its first one byte for byte, and those that differ among themselves."""
        order, counts, out = np.argsort(self.f, kind="stable"), self.n.copy(), []
        while len(order):
            f = self.f[order]
            head = np.append(True, f[1:] != f[:-1])
            first = order[head]
            same = equal_texts(self.text, self.start, self.length, order, first[np.cumsum(head) - 1])
            sums = np.add.reduceat(np.where(same, counts[order], 0), np.flatnonzero(head))
            out.append((first, sums))
            order = order[~same]
        return self.taken(*[np.concatenate(x) for x in zip(*out, strict=True)]).sorted() if len(out) > 1 else self.taken(*out[0]) if out else self

    def sorted(self) -> Texts:
        order = np.argsort(self.f, kind="stable")
        return self.taken(order, self.n[order])

    def cut(self, a: int, b: int) -> bytes:
        text = self.text[self.start[a] : self.start[b - 1] + self.length[b - 1]]
        numbers = pack(self.f[a:b], self.n[a:b].astype(np.int64), self.key[a:b], self.word[a:b].astype(np.int32), self.length[a:b].astype(np.int32))
        return len(numbers).to_bytes(4, "little") + len(text).to_bytes(4, "little") + numbers + pa.Codec("zstd").compress(text, asbytes=True)

    @classmethod
    def of(cls, block: bytes) -> Texts:
        numbers, size = int.from_bytes(block[:4], "little"), int.from_bytes(block[4:8], "little")
        f, n, key, word, length = unpack(block[8 : 8 + numbers], np.uint64, np.int64, np.int64, np.int32, np.int32)
        return cls(f, n, key, word, length.astype(np.int64), pa.Codec("zstd").decompress(block[8 + numbers :], size, asbytes=True))


def equal_texts(text: bytes, start: np.ndarray, length: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Whether the texts a[i] and b[i] are equal, byte by byte."""
    raw = np.frombuffer(text, np.uint8)
    same = length[a] == length[b]
    same &= (a == b) | (length[a] > 0)
    for k in range(0, len(a), step):
        some = np.flatnonzero(same[k : k + step] & (a != b)[k : k + step]) + k
        if len(some):
            size = length[a[some]]
            begin = np.cumsum(size) - size
            within = np.arange(int(size.sum())) - np.repeat(begin, size)
            equal = raw[np.repeat(start[a[some]], size) + within] == raw[np.repeat(start[b[some]], size) + within]
            same[some] = np.logical_and.reduceat(equal, begin)
    return same


def texts_of(made: Stretch, n: int, at: np.ndarray, f: np.ndarray, langs: list[str], keys: np.ndarray) -> Texts:
    """The runs of n words that begin at the words ``at``, one row each different text."""
    start, length = made.starts[at], made.ends[at + n - 1] - made.starts[at]
    every = Texts(f, np.ones(len(at), np.int64), keys[made.row[at]], made.number[at], length, made.text)
    every.start = start
    one = every.added()
    names = [name.encode("utf-8", "surrogatepass") + b"\n" for name in langs]
    row = dict(zip((_code(x) for x in langs), range(len(langs)), strict=True))
    # a fingerprint is mixed with the language, so rows of one text in two languages stay apart
    where = np.searchsorted(f, one.f, sorter=(order := np.argsort(f, kind="stable")))
    codes = made.lang[at[order[where]]].tolist()
    pieces = [names[row[c]] + one.text[s : s + m] for c, s, m in zip(codes, one.start.tolist(), one.length.tolist(), strict=True)]
    return Texts(one.f, one.n, one.key, one.word, np.array([len(x) for x in pieces], np.int64), b"".join(pieces))


def counted_texts(rows: DataFrame, known: dict, least: int, size: int, ranges: int) -> DataFrame:
    """(lang, phrase, words, n, first) of the runs of up to four words whose fingerprint is known and that occur ``least`` times, by text: whatever collides is told apart here."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, tables, held, total = Powers(), {n: Table(t.value) for n, t in known.items()}, [], 0

        def out(all_: Texts):
            cuts = ranges_of(all_.f, ranges)
            for r in np.flatnonzero(np.diff(cuts)).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([all_.cut(cuts[r], cuts[r + 1])], pa.binary())], ["_r", "_b"])

        for parts, langs, keys in _stretches_of(batches, size):
            made = Stretch(parts, powers)
            names = np.array([-1 if k is None else k for k in keys], np.int64)
            for n in (1, 2, 3, 4):
                at = made.frequent(n, tables)
                at = at[made.own[at]]
                f = made.fingerprints(n, at)
                good = tables[min(n, 3)].has(f)
                if good.any():
                    held.append(texts_of(made, n, at[good], f[good].view(np.uint64), list(dict.fromkeys(langs)), names))
                    total += len(held[-1].f)
            if total > HELD // 2:
                held = [Texts.joined(held).added()]
                total = len(held[0].f)
                if total > HELD // 4:
                    yield from out(held[0])
                    held, total = [], 0
        if held:
            yield from out(Texts.joined(held).added())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for block in batch.column(1).to_pylist():
                held.append(Texts.of(block))
                total += len(held[-1].f)
                if total > HELD:
                    held = [Texts.joined(held).added()]
                    total = 0
        if not held:
            return
        got = Texts.joined(held).added()
        at = np.flatnonzero(got.n >= least)
        for k in range(0, len(at), 100_000):
            some = at[k : k + 100_000]
            named = [got.text[s : s + m].rsplit(b"\n", 1) for s, m in zip(got.start[some].tolist(), got.length[some].tolist(), strict=True)]
            phrases = [x[1] for x in named]
            columns = [pa.array([x[0] for x in named], pa.binary()).cast(pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array([x.count(b" ") + 1 for x in phrases], pa.int32()), pa.array(got.n[some])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got.key[some]), pa.array(got.word[some].astype(np.int32))], ["lang", "phrase", "words", "n", "key", "word"])

    blocks = rows.mapInArrow(count, "_r int, _b binary")
    got = blocks.repartitionById(ranges, "_r").mapInArrow(add, "lang string, phrase string, words int, n long, key long, word int")
    return got.select("lang", "phrase", "words", "n", F.struct("key", "word").alias("first"))


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, least: int = 30, size: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n, first) of all phrases of one to four words that occur ``least`` times in a language, and (lang, total words); both read back from the shared folder."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    rows, totals = _rows(docs, text, lang, key), saved(word_totals(_rows(docs, text, lang, key)))
    total = totals.agg(F.sum("total")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_WORDS))
    known = {}
    for level, sizes in ((1, (1,)), (2, (2,)), (3, (3, 4))):
        known[level] = frequent_table(counted_fingerprints(rows, sizes, known, least, size, ranges))
    path = scratch_path(spark, "phrases")
    counted_texts(rows, known, least, size, ranges).write.parquet(path)
    return spark.read.parquet(path), totals


def word_totals(rows: DataFrame) -> DataFrame:
    """(lang, total): all word occurrences of each language, counted without Python."""
    words = F.size(F.filter(F.split(F.coalesce("_text", F.lit("")), "[\\t .,;:!?\\n\\u000B\\u000C\\r]+"), lambda w: w != ""))
    return rows.groupBy(C("_lang").alias("lang")).agg(F.sum(words.cast("long")).alias("total"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *, least: int = 30, contained: int = 80, top: int | None = 2000, size: int = STRETCH) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, first) of the collocations of each language.

    a, l and r are the occurrences of the phrase and of the two parts at the cut where floor(2000000 a / (l + r)) is least (of
    equal ones the first). A phrase within a longer one that has ``contained`` per cent of its occurrences is left out.
    """
    counts, totals = frequent_phrases(docs, text, lang, key, least=least, size=size)
    longer = counts.where("words > 1").select("lang", "phrase", "words", C("n").alias("a"), "first")
    tokens = F.split("phrase", " ", -1)
    joined = lambda xs: F.array_join(xs, " ")
    cuts = longer.withColumn("k", F.explode(F.sequence(F.lit(1), C("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "first", "k", joined(F.slice(tokens, 1, C("k"))).alias("p1"), joined(F.slice(tokens, C("k") + 1, C("words"))).alias("p2"))
    part = lambda name, n: counts.select("lang", C("phrase").alias(name), C("n").alias(n))
    cuts = cuts.join(part("p1", "l"), ["lang", "p1"]).join(part("p2", "r"), ["lang", "p2"])
    exact = F.expr("(cast(a as decimal(19,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = F.min(F.struct(C("score"), C("k"), C("l"), C("r"))).alias("b")
    scored = cuts.withColumn("score", exact).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("first").alias("first"), best)
    inner = longer.where("words > 2").withColumn("m", F.explode(F.sequence(F.lit(2), C("words") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), C("words") - C("m") + 1)))
    holders = inner.groupBy("lang", joined(F.slice(tokens, C("i"), C("m"))).alias("phrase")).agg(F.max("a").alias("held"))
    free = scored.join(holders, ["lang", "phrase"], "left").where(~F.coalesce(F.lit(100).cast("decimal(3,0)") * C("held").cast("decimal(19,0)") >= F.lit(contained).cast("decimal(3,0)") * C("a").cast("decimal(19,0)"), F.lit(False)))
    order = Window.partitionBy("lang").orderBy(C("b.score").desc(), C("a").desc(), "phrase")
    ranked = free.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(C("rank") <= top)
    found = ranked.join(totals, "lang")
    return found.select("lang", "rank", "phrase", "a", C("b.l").alias("l"), C("b.r").alias("r"), C("total").alias("n"), C("b.score").alias("score"), "first")
