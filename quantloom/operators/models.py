"""Model fits: grouped least squares from Gram sums, and walk-forward Spark ML."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

C = F.col


def grouped_ols(rows: DataFrame, key: str, y: str, xs: list[str], *, ridge: float = 1e-8, min_rows: int = 3) -> DataFrame:
    """(key, n, coef) with coef = intercept then slopes; the intercept isn't penalised; null below ``min_rows``.

    Gram sums are plain aggregates, so only one small matrix a key meets the solver.
    """
    ones = [F.lit(1.0), *[C(x) for x in xs]]
    k = len(ones)
    good = rows.dropna(subset=[y, *xs])
    sums = [F.sum(ones[i] * ones[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(ones[i] * C(y)).alias(f"b{i}") for i in range(k)]
    grams = good.groupBy(key).agg(F.count("*").alias("n"), *sums)

    def solve(batches):
        for some in batches:
            g = np.array([[some[f"g{min(i, j)}_{max(i, j)}"].to_numpy(float) for j in range(k)] for i in range(k)]).transpose(2, 0, 1) + np.diag([0.0] + [ridge] * (k - 1))
            right = np.array([some[f"b{i}"].to_numpy(float) for i in range(k)]).T
            good = (some["n"].to_numpy() >= min_rows) & (np.linalg.matrix_rank(g) == k) if len(some) else np.zeros(0, bool)
            coef = [None] * len(some)
            for i, x in zip(np.flatnonzero(good), np.linalg.solve(g[good], right[good][:, :, None])[:, :, 0].tolist(), strict=True):
                coef[i] = x
            yield pd.DataFrame({key: some[key], "n": some["n"], "coef": coef})

    return grams.mapInPandas(solve, f"`{key}` {rows.schema[key].dataType.simpleString()}, n long, coef array<double>")


#: Names of model fitters; each makes a Spark ML estimator from a seed.
FITTERS: dict[str, Callable[[int], object]] = {}


def fitter(name: str):
    def put(make):
        FITTERS[name] = make
        return make

    return put


@fitter("logit")
def _logit(seed: int):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(featuresCol="features", labelCol="label", regParam=0.01, maxIter=25)


@fitter("forest")
def _forest(seed: int):
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=20, maxDepth=4, seed=seed)


@fitter("boosted")
def _boosted(seed: int):
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(featuresCol="features", labelCol="label", maxIter=10, maxDepth=3, seed=seed)


def folds_to_end(first: int, last: int, train: int, step: int, *, expanding: bool = False) -> list[tuple[int, int, int]]:
    """Folds (from, test_from, test_to) whose tests cover every month from ``first + train`` to ``last``; the last test may be shorter."""
    return [(first if expanding else k, k + train, min(k + train + step, last + 1)) for k in range(first, last - train + 1, step)]


#: Rows of a partition that trees are fitted on.
PER_TASK = 50_000


def _learnable(ready: DataFrame, n_folds: int) -> list[int]:
    """Folds whose training rows have more than one label, for all folds in one pass."""
    from .pointintime import trained

    rows = ready.where(trained() & C("label").isNotNull()).select(F.explode(F.sequence("_first", F.least("_last", F.lit(n_folds - 1)))).alias("fold"), "label")
    return [r["fold"] for r in rows.groupBy("fold").agg((F.min("label") != F.max("label")).alias("many")).where("many").orderBy("fold").collect()]  # a row a fold


def walk_forward(rows: DataFrame, features: list[str], label: str, folds: list[tuple[int, int, int]], name: str, *, known: str = "known_t", month: str = "month", purge_ms: int = 0, embargo_ms: int = 0, seed: int = 42, spread: bool = False, at_once: int = 8) -> DataFrame:
    """Rows of the test months with predictions of models that learned only from labels known before (see :mod:`pointintime`); folds are (from, test_from, test_to).

    Trees can't be fitted for several folds in one pass, so the driver asks for one fit a fold, a few at a time; fits and predictions
    run on the executors. A fit is some forty short jobs, so the rows are kept in as few partitions as their number asks for
    (``PER_TASK``), not in those of the last shuffle. Classifiers give the probability of class 1 as ``score``. With ``spread``
    predictions come with ``spread``, the standard deviation of the model's predictions of its own training rows.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from .orderstats import saved
    from .pointintime import trained, with_folds

    whole = saved(with_folds(rows.withColumn("label", C(label).cast("double")), folds, known=known, month=month, purge_ms=purge_ms, embargo_ms=embargo_ms))
    few = whole.coalesce(max(1, -(-whole.count() // PER_TASK)))
    ready = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(few).persist()

    def one(k: int) -> DataFrame:
        train, test = ready.where(trained() & (C("_first") <= k) & (k <= C("_last")) & C("label").isNotNull()), ready.where(C("_test") == k)
        model = FITTERS[name](seed).fit(train)
        got = model.transform(test)
        got = got.withColumn("score", vector_to_array("probability")[1] if "probability" in got.columns else C("prediction"))
        got = got.drop("features", "rawPrediction", "probability").withColumn("fold", F.lit(k).cast("long"))
        if spread:
            sd = model.transform(train).agg(F.stddev_pop("prediction")).first()[0]
            got = got.withColumn("spread", F.lit(float(sd or 0.0)))
        return got

    with ThreadPool(at_once) as pool:
        found = pool.map(one, _learnable(ready, len(folds)))  # a fold with one label only isn't fitted
    if not found:
        extra = {"prediction": "double", "score": "double", "fold": "long"} | ({"spread": "double"} if spread else {})
        return ready.drop("features").withColumns({n: F.lit(None).cast(t) for n, t in extra.items()}).limit(0)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out
