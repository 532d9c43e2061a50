"""Language identification with string kernels.

The kernel of two texts is the share of 1-, 2- and 3-grams of letters that both have, normalised as a cosine of
presence vectors (a blended spectrum kernel). A few texts of each language are landmarks; by the Nyström method
every text is described by its kernels with the landmarks, and one-versus-rest kernel ridge regression is fitted on that
description. As all steps after the presence vector are linear, they are folded into one matrix: scoring
a batch is one matrix product of presence rows and that matrix. Landmarks and training rows are bounded samples of
the labelled rows; every whole text is scored, in Arrow batches without shuffle.

Defined results: null texts and texts without letters are ``und`` with score 0; with no labelled rows all texts are.
Rows without key are never learned from and count as not held out. Letters other than a to z share 101 classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import process_store, saved, small_batches

BASE = 128
SIZE = BASE + BASE**2 + BASE**3


def letter_classes() -> np.ndarray:
    """Class by code point: 0 for what is no letter, 1 to 26 for a to z, 27 to 127 by hash for other letters."""
    store = process_store("letter_classes")
    if "table" not in store:
        letters = np.array([chr(c).isalpha() for c in range(0x110000)])
        code = np.arange(0x110000, dtype=np.uint64)
        table = np.where(letters, 27 + (code * np.uint64(2654435761) % np.uint64(1 << 32)) * np.uint64(101) // np.uint64(1 << 32), 0).astype(np.int32)
        table[97:123] = np.arange(1, 27)
        store["table"] = table
    return store["table"]


def grams(text: str | None, part: int = 1 << 20) -> np.ndarray:
    """Codes of the different 1-, 2- and 3-grams of a whole text; words are set apart by one blank.

    The text is read in parts; the last two classes of a part go before the next one, so the parts make no difference.
    """
    table, found, text = letter_classes(), [], (text or "").lower()
    last = np.zeros(1, np.int32)
    for at in range(0, max(len(text), 1), part):
        code = table[np.frombuffer(text[at : at + part].encode("utf-32-le", "surrogatepass"), np.uint32)]
        code = np.concatenate([last, code, np.zeros(int(at + part >= len(text)), np.int32)])
        new, before = code[len(last) :], code[len(last) - 1 : -1]
        code = np.concatenate([last, new[(new > 0) | (before > 0)]])
        pair = code[:-1] * BASE + code[1:]
        found.append(np.unique(np.concatenate([code[code > 0], BASE + pair[pair > 0], BASE + BASE**2 + pair[:-1] * BASE + code[2:]])))
        last = code[-2:]
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


class Presence:
    """Presence rows over the grams of the landmarks."""

    def __init__(self, landmarks: list[np.ndarray]):
        self.grams = np.unique(np.concatenate(landmarks)) if landmarks else np.zeros(0, np.int64)
        self.column = None

    def rows(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(presence, number of different grams) of each text; no grams where a text has no letter."""
        if self.column is None:
            self.column = np.full(SIZE, -1, np.int32)
            self.column[self.grams] = np.arange(len(self.grams))
        out, sizes = np.zeros((len(texts), len(self.grams)), np.float32), np.zeros(len(texts))
        for i, t in enumerate(texts):
            g = grams(t)
            if len(g) and g[0] < BASE:
                at = self.column[g]
                out[i, at[at >= 0]] = 1.0
                sizes[i] = len(g)
        return out, sizes


def held_out(key: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


class KernelModel:
    """The folded matrix: scores of a text are presence @ weights / sqrt(its grams) + bias."""

    def __init__(self, presence: Presence, weights: np.ndarray, bias: np.ndarray, languages: list[str]):
        self.presence, self.weights, self.bias, self.languages = presence, weights.astype(np.float32), bias, languages

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        x, n = self.presence.rows(texts)
        scores = (x @ self.weights) / np.sqrt(np.maximum(n, 1))[:, None] + self.bias
        best = scores.argmax(axis=1) if scores.shape[1] else np.zeros(len(scores), int)
        top = scores[np.arange(len(scores)), best] if scores.shape[1] else np.zeros(len(scores))
        names = [self.languages[b] if k else "und" for b, k in zip(best, n, strict=True)]
        return names, np.where(n > 0, np.clip((top + 1) / 2, 0, 1), 0.0)


def train(docs: DataFrame, *, key="doc_id", text="text", lang="lang", max_rows=4000, max_landmarks=160, ridge=1e-2, seed=42) -> KernelModel | None:
    """Fits on at most ``max_rows`` labelled rows with text that are not held out, as many of each language as there are (those with the smallest hashes) up to an
    even share, so a rare language is a class like any other; landmarks are as many from each language."""
    order = [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)]
    small_batches(docs.sparkSession)
    usable = docs.where(~held_out(key) & F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    ids = usable.select(key, F.col(lang).alias("_lang"))
    share = max(1, max_rows // max(1, ids.select("_lang").distinct().count()))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy(*order))
    chosen = saved(ids.withColumn("_rank", rank).where(F.col("_rank") <= share).groupBy(key).agg(F.min(F.struct("_lang", "_rank")).alias("_x")).select(key, "_x.*"))
    rows = saved(usable.select(key, F.col(text).alias("text"), F.col(lang).alias("_l")).join(F.broadcast(chosen), key).where("_l = _lang").drop("_l"))
    languages = sorted(r[0] for r in rows.select("_lang").distinct().collect())
    if not languages:
        return None
    each = max(1, max_landmarks // len(languages))

    @F.pandas_udf("array<int>")
    def grams_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: grams(t).tolist())

    picked = rows.where(F.col("_rank") <= each).select(key, grams_of("text").alias("g")).orderBy(*order).collect()
    landmarks = [np.array(r["g"], np.int64) for r in picked if r["g"]]
    if not landmarks:
        return None
    presence = Presence(landmarks)
    marks = np.zeros((len(landmarks), len(presence.grams)))
    for i, g in enumerate(landmarks):
        marks[i, np.searchsorted(presence.grams, g)] = 1 / np.sqrt(len(g))

    def kernels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            for at in range(0, len(some), 256):
                part = some.iloc[at : at + 256]
                x, n = presence.rows(part["text"].tolist())
                k = (x @ marks.T) / np.sqrt(np.maximum(n, 1))[:, None]
                out = pd.DataFrame({"key": part[key].astype(str), "lang": part["_lang"], "k": list(k)})
                yield out[n > 0]

    got = rows.mapInPandas(kernels, "key string, lang string, k array<double>").toPandas().sort_values(["key", "lang"], kind="stable")
    if got.empty:
        return None
    k_xm, y = np.array(got["k"].tolist()), np.where(got["lang"].to_numpy()[:, None] == np.array(languages), 1.0, -1.0)
    value, vector = np.linalg.eigh(marks @ marks.T)
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = np.column_stack([k_xm @ root, np.ones(len(k_xm))])
    balance = 1 / np.maximum(1, (y > 0).sum(axis=0))[(y > 0).argmax(axis=1)]
    balance *= len(y) / balance.sum()
    w = np.linalg.solve((phi * balance[:, None]).T @ phi + ridge * np.eye(phi.shape[1]), (phi * balance[:, None]).T @ y)
    return KernelModel(presence, marks.T @ (root @ w[:-1]), w[-1], languages)


def identify(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """(key, held_out, lang_pred, score) of each whole text."""
    small_batches(docs.sparkSession)
    model = train(docs, key=key, text=text, lang=lang, **options)
    rows = docs.select(F.col(key), held_out(key).alias("held_out"), F.col(text).alias("_text"))
    if model is None:
        return rows.select(key, "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in parts:
            names, scores = [], []
            for at in range(0, len(some), 256):
                a, b = model.predict(some.iloc[at : at + 256].tolist())
                names += a
                scores += b.tolist()
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return rows.select(key, "held_out", predict("_text").alias("_p")).select(key, "held_out", "_p.lang_pred", "_p.score")
