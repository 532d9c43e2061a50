"""Point-in-time fits: a fold learns from labels that were known before its first test time, and from nothing else.

Each row carries the time at which its label is known (``known``: that of the last bar the label looks at, null while it
isn't). A row belongs to the training of a contiguous run of folds, so it is stored once with the first and the last of them:
sums for all folds come from one pass that adds a row at its first fold and takes it off behind its last, and
are then added up over folds. Logits are fitted for all folds together by iteratively reweighted least squares; the sums of
an iteration are made in the tasks, and only folds x columns^2 numbers reach the driver.
"""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
DAY_MS = 86_400_000


def month_start(month: int) -> int:
    """Milliseconds of the first instant of a month ordinal (12 * year + month - 1)."""
    return (datetime.date(month // 12, month % 12 + 1, 1) - datetime.date(1970, 1, 1)).days * DAY_MS


def with_folds(rows: DataFrame, folds: list[tuple[int, int, int]], *, time: str = "t", known: str = "known_t", month: str = "month", purge_ms: int = 0, embargo_ms: int = 0) -> DataFrame:
    """rows with _first and _last, the folds that may learn from the row (none where _first > _last or null), and _test, the fold that scores it.

    folds are (from, test_from, test_to) in month ordinals, ascending. A fold learns from rows of the months from ``from`` on whose label
    is known more than ``purge_ms`` before its first test instant; it scores rows of its test months from ``embargo_ms`` after that instant on.
    """
    none = F.lit(None).cast("int")
    if not folds:
        return rows.withColumns({"_first": none, "_last": none, "_test": none})
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    starts = [month_start(b) for _, b, _ in folds]
    upto = lambda xs, limit: F.size(F.filter(longs(xs), lambda x: x <= limit))
    test = upto([b for _, b, _ in folds], C(month)) - 1
    inside = (test >= 0) & (C(month) < F.get(longs([c for *_, c in folds]), test)) & (C(time) >= F.get(longs(starts), test) + embargo_ms)
    return rows.withColumns({"_first": F.when(C(known).isNotNull(), upto(starts, C(known) + purge_ms)), "_last": upto([a for a, *_ in folds], C(month)) - 1, "_test": F.when(inside, test)})


def trained() -> Column:
    return C("_first") <= C("_last")


def fold_sums(rows: DataFrame, terms: dict[str, Column], n_folds: int) -> dict[str, np.ndarray]:
    """The sum of each term over the training rows of each fold, for all folds in one pass."""
    edge = F.array(F.struct(C("_first").alias("fold"), F.lit(1.0).alias("sign")), F.struct((C("_last") + 1).alias("fold"), F.lit(-1.0).alias("sign")))
    x = rows.where(trained()).select(F.explode(edge).alias("_e"), *[v.cast("double").alias(k) for k, v in terms.items()])
    got = x.groupBy("_e.fold").agg(*[F.sum(C("_e.sign") * C(k)).alias(k) for k in terms]).collect()  # folds + 1 rows at most
    out = {k: np.zeros(n_folds + 1) for k in terms}
    for r in got:
        for k in terms:
            out[k][r["fold"]] += r[k] or 0.0
    return {k: np.cumsum(v)[:n_folds] for k, v in out.items()}


def _moments(rows: DataFrame, features: list[str], label: str, n_folds: int):
    ones = [F.lit(1.0), *[C(f) for f in features]]
    k = len(ones)
    terms = {f"g{i}_{j}": ones[i] * ones[j] for i in range(k) for j in range(i, k)} | {f"b{i}": ones[i] * C(label) for i in range(k)}
    sums = fold_sums(rows, terms, n_folds)
    gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]).transpose(2, 0, 1)
    return gram, np.array([sums[f"b{i}"] for i in range(k)]).T


def fold_ridge(rows: DataFrame, features: list[str], label: str, n_folds: int, *, ridge: float = 1e-8, min_rows: int = 3) -> list[tuple[int, int, list[float]]]:
    """(fold, rows, coefficients, the intercept first and not penalised) of least squares; all folds are solved as one stack."""
    if not n_folds:
        return []
    gram, right = _moments(rows.dropna(subset=[*features, label]), features, label, n_folds)
    fit = np.flatnonzero(gram[:, 0, 0] >= min_rows)
    beta = np.linalg.solve(gram[fit] + np.diag([0.0] + [ridge] * len(features)), right[fit][:, :, None])[:, :, 0] if len(fit) else []
    return [(int(k), int(round(gram[k, 0, 0])), b.tolist()) for k, b in zip(fit, beta, strict=True)]


def fold_logit(rows: DataFrame, features: list[str], label: str, n_folds: int, *, year: str | None = None, ridge: float = 1.0, iterations: int = 25, tol: float = 1e-9) -> list[dict]:
    """Logits of a 0/1 label for every fold: dicts of fold, n, mean, sd (both of the training rows), years and beta (intercept, standardised features, effects of all years but the first).

    A year without training rows has effect 0. Folds whose training rows have one class only are left out. All coefficients are penalised.
    """
    ready = rows.where(trained()).dropna(subset=[*features, label]).select("_first", "_last", *[C(f).cast("double") for f in features], C(label).cast("double").alias("_y"), (C(year) if year else F.lit(0)).cast("int").alias("_year")).persist()
    try:
        return _logits(ready, features, n_folds, ridge, iterations, tol) if n_folds else []
    finally:
        ready.unpersist()


def _logits(ready: DataFrame, features: list[str], n_folds: int, ridge: float, iterations: int, tol: float) -> list[dict]:
    gram, right = _moments(ready, features, "_y", n_folds)
    n, positive = gram[:, 0, 0], right[:, 0]
    k = len(features)
    mean = gram[:, 0, 1:] / np.maximum(n, 1)[:, None]
    sd = np.sqrt(np.maximum(gram[:, range(1, k + 1), range(1, k + 1)] / np.maximum(n, 1)[:, None] - mean**2, 0))
    sd[sd < 1e-12] = 1.0
    years = sorted(r[0] for r in ready.select("_year").distinct().collect())[1:]
    p = 1 + k + len(years)
    beta, open_ = np.zeros((n_folds, p)), (positive > 0.5) & (positive < n - 0.5)
    fitted = np.flatnonzero(open_)

    for _ in range(iterations):
        if not open_.any():
            break
        now, which = beta.copy(), np.flatnonzero(open_)

        def sums(batches, now=now, which=which):
            total = np.zeros((len(which), p * p + p))
            for some in batches:
                x, y, effects = some[features].to_numpy(), some["_y"].to_numpy(), (some["_year"].to_numpy()[:, None] == np.array(years)[None, :]).astype(float)
                first, last = some["_first"].to_numpy(), some["_last"].to_numpy()
                for at, fold in enumerate(which):
                    own = (first <= fold) & (fold <= last)
                    if own.any():
                        d = np.hstack([np.ones((own.sum(), 1)), (x[own] - mean[fold]) / sd[fold], effects[own].reshape(own.sum(), -1)])
                        mu = 1 / (1 + np.exp(-np.clip(d @ now[fold], -30, 30)))
                        w = np.maximum(mu * (1 - mu), 1e-9)
                        total[at, : p * p] += ((d * w[:, None]).T @ d).ravel()
                        total[at, p * p :] += d.T @ (y[own] - mu)
            at, i = np.nonzero(total)
            yield pd.DataFrame({"fold": which[at].astype(np.int32), "i": i.astype(np.int32), "v": total[at, i]})

        total = np.zeros((n_folds, p * p + p))
        for r in ready.mapInPandas(sums, "fold int, i int, v double").groupBy("fold", "i").agg(F.sum("v").alias("v")).collect():
            total[r["fold"], r["i"]] = r["v"]
        hess = total[which, : p * p].reshape(-1, p, p) + ridge * np.eye(p)
        step = np.linalg.solve(hess, (total[which, p * p :] - ridge * beta[which])[:, :, None])[:, :, 0]
        beta[which] += step
        open_[which] = np.abs(step).max(axis=1) >= tol
    return [{"fold": int(f), "n": int(round(n[f])), "mean": mean[f].tolist(), "sd": sd[f].tolist(), "years": years, "beta": beta[f].tolist()} for f in fitted]


def scored_by_logit(rows: DataFrame, fits: list[dict], features: list[str], *, year: str | None = None, out: str = "p") -> DataFrame:
    """The rows that a fitted fold scores, with its number as fold, its training rows as n_train and the probability; only figures of the training rows are used."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(f["fold"], f["n"], f["mean"], f["sd"], [int(y) for y in f["years"]], f["beta"]) for f in fits], "_test int, n_train long, _mean array<double>, _sd array<double>, _years array<int>, _beta array<double>")
    x = rows.where("_test is not null").join(F.broadcast(table), "_test")  # one row a fold
    z = F.get("_beta", F.lit(0))
    for i, f in enumerate(features):
        z = z + F.get("_beta", F.lit(i + 1)) * (C(f) - F.get("_mean", F.lit(i))) / F.get("_sd", F.lit(i))
    if year:
        at = F.array_position("_years", C(year).cast("int")).cast("int")
        z = z + F.when(at > 0, F.get("_beta", at + len(features))).otherwise(0.0)
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))
    return x.withColumns({out: 1 / (1 + F.exp(-z)), "fold": C("_test").cast("long")}).drop("_mean", "_sd", "_years", "_beta")
