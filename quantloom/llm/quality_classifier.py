"""Quality classifier by co-training: a text-content view and a page-metadata view teach each other.

A bounded sample of labelled rows and a bounded pool of unlabelled rows (both the smallest by hash of their key;
the bounds are parameters) are turned into features by the executors. The text view sees how often words and word
beginnings of a learned vocabulary occur, and how far words and 3-word shingles repeat. The vocabulary has the tokens
that tell most of a toxic label and those that tell most of a quality label, found apart from each other so that neither
crowds out the other; it is looked up in whole texts by one Aho-Corasick pass; the metadata view sees source, language, stored length
and layout (lines, marks, capitals, digits). Each round fits both views, lets each label the pool rows it is sure
about, by its probabilities as calibrated on labelled rows held back, and hands these to the other. At the end the
calibrated views are combined on labelled rows held back, and every
whole document is scored in Arrow batches.

A document is bad if its quality label is 0 or its toxic label is 1, so that toxic documents are rejected too.

Defined results: null and empty texts have no words and are scored on what is left, usually as the prior; rows with
null metadata use a value of its own. A toxic label of 1 counts without a quality label. Without labels of both classes every row has score 1 and is kept. Repeated rows
get equal scores. Of repeated labels of a key the worst counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import log1p

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, process_store, saved, small_batches

N_SOURCE, N_LANG = 32, 8
#: Rows whose features are held at once as Python objects.
ROWS = 512


def _text_stats(text: str, words: list[bytes]) -> list[float]:
    n = max(1, len(words))
    shingles = len(words) - 2
    repeated = 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / shingles if shingles > 0 else 0.0
    return [repeated, 1.0 if repeated > 0.3 else 0.0, sum(map(len, words)) / n / 10, min(1.0, n / 50)]


def _meta(text: str, lang, source, n_chars) -> list[float]:
    one = lambda x, n: [float(i == (n - 1 if x is None or x != x else zlib.crc32(str(x).encode()) % (n - 1))) for i in range(n)]
    n = max(1, len(text))
    lines = text.count("\n") + 1
    marks = sum(map(text.count, "#*$%&|<>"))
    upper = len(text) - len(text.translate(_NO_UPPER))
    length = 0.0 if n_chars is None or n_chars != n_chars else float(n_chars)
    return [
        *one(lang, N_LANG), *one(source, N_SOURCE), np.log1p(max(0.0, length)) / 10, min(4.0, lines / (n / 200 + 1)), min(1.0, 20 * marks / n), float(marks > 2),
        min(1.0, 3 * upper / n), float(upper * 5 > n), min(1.0, 10 * sum(map(text.count, "0123456789")) / n), min(1.0, 20 * text.count("!") / n),
    ]


_NO_UPPER = dict.fromkeys(range(65, 91))


#: Bytes of the word beginnings that count as tokens, for stems that take many endings.
BEGINNINGS = (4, 5, 6, 7)


def tokens(words: list[bytes]) -> set[bytes]:
    """Different words of a text, and their beginnings."""
    different = set(words)
    return different.union(*({w[:k] + b"*" for w in different if len(w) >= k} for k in BEGINNINGS))


class Vocabulary:
    """Finds which tokens occur in a text; a word stands between blanks, a beginning after one."""

    def __init__(self, words: list[bytes]):
        self.words = words

    def __len__(self) -> int:
        return len(self.words)

    def _automaton(self):
        import ahocorasick

        store, mark = process_store("vocabularies"), hash(tuple(self.words))
        if mark not in store:
            a = ahocorasick.Automaton()
            for i, w in enumerate(self.words):
                a.add_word((b" " + w[:-1] if w.endswith(b"*") else b" " + w + b" ").decode("latin-1"), i)
            a.make_automaton()
            store[mark] = a
        return store[mark]

    def counts(self, words: list[bytes]) -> dict[int, int]:
        """How often each token that occurs does."""
        if not self.words or not words:
            return {}
        return Counter(i for _, i in self._automaton().iter((b" " + b" ".join(words) + b" ").decode("latin-1")))


def features(vocabulary: Vocabulary, text, lang, source, n_chars) -> tuple[dict[int, float], list[float], list[float]]:
    """(logarithmic counts of vocabulary tokens, text statistics, metadata features) of one whole document."""
    text = text or ""
    words = alnum_words(text)
    return {i: log1p(n) for i, n in vocabulary.counts(words).items()}, _text_stats(text, words), _meta(text, lang, source, n_chars)


def text_matrix(counts: list[dict[int, float]], stats, n_words: int) -> np.ndarray:
    stats = np.asarray(stats, np.float64).reshape(len(counts), -1)
    out = np.zeros((len(counts), n_words + stats.shape[1]), np.float32)
    for i, some in enumerate(counts):
        out[i, list(some)] = list(some.values())
    out[:, n_words:] = stats
    return out


class Logistic:
    """Ridge logistic regression by Newton steps over (rows, marks, weight) parts, a block of rows at a time."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, float]], ridge: float = 0.3, block: int = 1024):
        n = parts[0][0].shape[1] + 1
        w, penalty = np.zeros(n), np.full(n, ridge)
        penalty[0] = 1e-6
        for _ in range(25):
            gradient, curve = penalty * w, np.diag(penalty)
            for x, y, weight in parts:
                for at in range(0, len(x), block):
                    some = np.column_stack([np.ones(len(x[at : at + block])), x[at : at + block]])
                    p = sigmoid(np.clip(some @ w, -30, 30))
                    gradient += some.T @ (weight * (p - y[at : at + block]))
                    curve += (some * (weight * p * (1 - p) + 1e-9)[:, None]).T @ some
            step = np.linalg.solve(curve, gradient)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.w[0] + x @ self.w[1:], -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class CoTrained:
    """Both views, their calibration and combination; ``bad`` gives the probability of being bad."""

    def __init__(self, vocabulary, text_l, meta_l, y, text_u, meta_u, held, rounds: int, sure: float):
        self.vocabulary = vocabulary
        fit = ~held
        views = [(text_l[fit], text_u), (meta_l[fit], meta_u)]
        given: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0))] * 2
        self.taught = []
        for _ in range(rounds):
            models = [Logistic([(x, y[fit], 1.0), (u[rows], marks, 0.5)]) for (x, u), (rows, marks) in zip(views, given, strict=True)]
            z = [m.logit(x[held]) for m, x in zip(models, (text_l, meta_l), strict=True)]
            self.scale = [Logistic([(v[:, None], y[held], 1.0)], ridge=0.1).w for v in z]
            if not len(text_u):
                break
            said = [sigmoid(s[0] + s[1] * m.logit(u)) for s, m, (_, u) in zip(self.scale, models, views, strict=True)]
            rows = [np.flatnonzero((p >= sure) | (p <= 1 - sure)) for p in said]
            given = [(rows[1], (said[1][rows[1]] > 0.5).astype(float)), (rows[0], (said[0][rows[0]] > 0.5).astype(float))]
            self.taught.append((len(rows[0]), len(rows[1])))
        self.models = models
        calibrated = np.column_stack([s[0] + s[1] * v for s, v in zip(self.scale, z, strict=True)])
        self.mix = Logistic([(calibrated, y[held], 1.0)], ridge=0.1)

    def bad(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text view, metadata view) probabilities of being bad."""
        z = [s[0] + s[1] * m.logit(x) for s, m, x in zip(self.scale, self.models, (text, meta), strict=True)]
        return sigmoid(self.mix.logit(np.column_stack(z))), sigmoid(z[0]), sigmoid(z[1])


def train(docs: DataFrame, labels: DataFrame, *, key="doc_id", text="text", meta=("lang", "source", "n_chars"), max_labelled=12000, max_pool=6000, max_words=200, min_docs=4, rounds=4, sure=0.98, seed=42) -> CoTrained | None:
    """Fits the views; only the sample's and the pool's features (bounded) and vocabulary counts reach the driver.

    ``max_words`` bounds the tokens chosen for each of the two labels, of those in ``min_docs`` sampled documents at least.
    """
    known = labels.where(F.col(key).isNotNull() & (F.col("quality").isNotNull() | (F.col("toxic") == 1))).groupBy(key).agg(
        F.max(((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("_bad"), F.max("toxic").alias("_toxic"), F.min("quality").alias("_quality"))
    order = [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
    marked = saved(known.orderBy(*order).limit(max_labelled))
    pool = docs.select(key).where(F.col(key).isNotNull()).join(marked, key, "left_anti").orderBy(*order).limit(max_pool).distinct()
    chosen = saved(marked.unionByName(pool, allowMissingColumns=True))
    rows = saved(docs.select(key, F.col(text).alias("text"), *[F.col(c).alias(f"m{i}") for i, c in enumerate(meta)]).join(F.broadcast(chosen), key))
    counts = {r["_bad"]: r["n"] for r in rows.where("_bad is not null").groupBy("_bad").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for t, toxic, quality in zip(some["text"], some["_toxic"], some["_quality"], strict=True):
                yield pd.DataFrame({"word": sorted(tokens(alnum_words(t)))}).assign(toxic=toxic == 1, poor=quality == 0, said=quality == quality and quality is not None)

    held = F.pmod(F.xxhash64(F.lit(seed + 1), key), F.lit(4)) == 0
    fitted = rows.where(F.col("_bad").isNotNull() & ~held)
    one = lambda c: F.sum(F.col(c).cast("long"))
    found = fitted.select("text", "_toxic", "_quality").mapInPandas(words_of, "word binary, toxic boolean, poor boolean, said boolean")
    found = saved(found.groupBy("word").agg(F.count("*").alias("n"), one("toxic").alias("toxic"), one("poor").alias("poor"), one("said").alias("said")).where(F.col("n") >= min_docs))
    total = fitted.agg(F.count("*").alias("n"), F.sum((F.coalesce("_toxic", F.lit(0)) == 1).cast("int")).alias("toxic"), F.count("_quality").alias("said"), F.sum((F.col("_quality") == 0).cast("int")).alias("poor")).first()
    chosen_words: dict[bytes, None] = {}
    for label, of in (("toxic", "n"), ("poor", "said")):
        share = (total[label] or 0) / max(1, total[of])
        if not 0 < share < 1:
            continue
        z = F.abs(F.col(label) - F.col(of) * share) / F.sqrt((F.col(of) + 1) * share * (1 - share))
        counted = {bytes(r["word"]): (r[of], r[label]) for r in found.orderBy(z.desc(), F.length("word"), "word").limit(6 * max_words).collect()}
        some: list[bytes] = []
        for word, has in counted.items():  # a token that adds nothing to its beginnings is left out
            stem = word[:-1] if word.endswith(b"*") else word
            if len(some) < max_words and not any(counted.get(stem[:k] + b"*") == has for k in BEGINNINGS if stem[:k] + b"*" != word and len(stem) >= k):
                some.append(word)
        chosen_words |= dict.fromkeys(some)
    vocabulary = Vocabulary(list(chosen_words))

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in (whole.iloc[at : at + ROWS] for whole in batches for at in range(0, len(whole), ROWS)):
            got = [features(vocabulary, *r) for r in zip(some["text"], some["m0"], some["m1"], some["m2"], strict=True)]
            yield pd.DataFrame({"key": some[key].astype(str), "bad": some["_bad"].astype("float64").astype("Float64"), "held": some["_held"],
                                "p": [list(g[0]) for g in got], "c": [list(g[0].values()) for g in got], "s": [g[1] for g in got], "m": [g[2] for g in got]})

    got = rows.withColumn("_held", held).mapInPandas(featured, "key string, bad double, held boolean, p array<int>, c array<double>, s array<double>, m array<double>").toArrow().sort_by("key").combine_chunks()
    flat = lambda name: got[name].combine_chunks().flatten().to_numpy()
    stats, m = flat("s").reshape(len(got), -1), flat("m").reshape(len(got), -1).astype(np.float32)
    x = np.zeros((len(got), len(vocabulary) + stats.shape[1]), np.float32)
    x[np.repeat(np.arange(len(got)), pc.list_value_length(got["p"]).to_numpy()), flat("p")] = flat("c")
    x[:, len(vocabulary) :] = stats
    has = got["bad"].is_valid().to_numpy()
    y, held_rows = got["bad"].to_numpy()[has], got["held"].to_numpy()[has].copy()
    del got, stats
    if min(len(set(y[held_rows])), len(set(y[~held_rows]))) < 2:
        held_rows = np.zeros(len(y), bool)
        held_rows[::4] = True
        if min(len(set(y[held_rows])), len(set(y[~held_rows]))) < 2:
            return None
    return CoTrained(vocabulary, x[has], m[has], y, x[~has], m[~has], held_rows, rounds, sure)


def classify(docs: DataFrame, labels: DataFrame, *, key="doc_id", text="text", meta=("lang", "source", "n_chars"), threshold=0.6, **options) -> DataFrame:
    """All columns of ``docs`` with score (probability of being good), score_text, score_meta and kept (score >= threshold)."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, key=key, text=text, meta=meta, **options)
    if model is None:
        return docs.withColumns({"score": F.lit(1.0), "score_text": F.lit(1.0), "score_meta": F.lit(1.0), "kept": F.lit(True)})

    @F.pandas_udf("score double, score_text double, score_meta double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for some in parts:
            bad = np.ones((len(some[0]), 3))
            for at in range(0, len(bad), ROWS):
                got = [features(model.vocabulary, *r) for r in zip(*[c.iloc[at : at + ROWS] for c in some], strict=True)]
                x = text_matrix([g[0] for g in got], [g[1] for g in got], len(model.vocabulary))
                bad[at : at + ROWS] = np.column_stack(model.bad(x, np.array([g[2] for g in got])))
            yield pd.DataFrame(1 - bad, columns=["score", "score_text", "score_meta"])

    out = docs.drop("score", "score_text", "score_meta", "kept").withColumn("_s", score(F.col(text), *[F.col(c) for c in meta]))
    return out.select(*[c for c in out.columns if c != "_s"], "_s.*").withColumn("kept", F.col("score") >= threshold)
