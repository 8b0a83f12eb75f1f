"""Cross-validation and learning curves of linear models from one scan.

A linear fit and its squared errors need only the cross products of a part. These are added up per fold and step of
the training share; every training set is a sum of them, solved on the small matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.config import KEY
from ratebook.functions.columns import hash_key
from ratebook.operators.quantiles import order_statistics
from ratebook.operators.sums import elastic_solution, grams


def _fit(g: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """Intercept and coefficients from the products of (1, inputs, target); penalties are on inputs of unit deviation."""
    k, n = len(g) - 1, g[0, 0]
    if n <= 0:
        return np.full(k, np.nan)
    mean = g[0, :k] / n
    centred = g[1:k, 1:k] / n - np.outer(mean[1:], mean[1:])
    pull = g[1:k, k] / n - mean[1:] * g[0, k] / n
    scale = np.sqrt(np.maximum(np.diag(centred), 0))
    varies = scale > 1e-9 * np.maximum(1.0, np.abs(mean[1:]))
    s = np.where(varies, scale, 1.0)
    some = np.flatnonzero(varies)
    b = np.zeros(k - 1)
    b[some] = elastic_solution((centred / np.outer(s, s))[np.ix_(some, some)], (pull / s)[some], np.full(len(some), l1), np.full(len(some), l2)) / s[some]
    return np.r_[g[0, k] / n - b @ mean[1:], b]


def _squares(g: np.ndarray, b: np.ndarray) -> float:
    """Sum of squared errors of a fit over the rows behind the products."""
    k = len(b)
    return max(0.0, float(g[k, k] - 2 * b @ g[:k, k] + b @ g[:k, :k] @ b))


def fold_scores(df: DataFrame, inputs: Sequence[str], target: str = "label", fold: str = "fold", fractions: Sequence[float] = (1.0,),
                penalties: Sequence[tuple[float, float]] = ((0.0, 0.0),), key: str = KEY, seed: int = 7) -> DataFrame:
    """(fraction, l1, l2, fold, n_train, n_val, train_rmse, val_rmse) for every fold, training share and penalty.

    A share is the rows below an exact threshold of a hash of the key, so larger shares contain the smaller ones; the
    seed must differ from that of the folds. Penalties are (l1, l2) per row. Rows with a null input, target or fold
    are left out. Sums of squares lose digits where the error is a millionth of the target or less.
    """
    rows = df.select(key, F.col(fold).cast("int").alias("_fold"), F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in inputs]).dropna()
    steps = sorted(set(fractions))
    h = hash_key(key, seed)
    if steps == [1.0]:
        step = F.lit(0)
    else:
        wanted = lambda n: [max(1, int(n * f)) for f in steps]
        n, cuts = order_statistics(rows, h, wanted).get((), (0, {}))
        step = F.lit(0)
        for k in wanted(n) if n else []:
            step = step + (h > F.lit(cuts[k])).cast("int")
    # Products about the target's mean keep more digits.
    centre = rows.agg(F.avg("_y")).first()[0] or 0.0
    found = grams(rows.withColumn("_one", F.lit(1.0)), ["_one", *inputs, F.col("_y") - F.lit(centre)], [F.col("_fold"), step])
    folds = sorted({g[0] for g in found})
    size = len(inputs) + 2
    zero = np.zeros((size, size))
    upto = {(j, i): sum((found.get((j, s), zero) for s in range(i + 1)), zero) for j in folds for i in range(len(steps))}
    whole = {j: sum((g for (k, _), g in found.items() if k == j), zero) for j in folds}
    out = []
    for i, f in enumerate(steps):
        for l1, l2 in penalties:
            for j in folds:
                train = sum((upto[k, i] for k in folds if k != j), zero)
                b = _fit(train, l1, l2)
                n, m = float(train[0, 0]), float(whole[j][0, 0])
                rmse = [float(np.sqrt(_squares(g, b) / c)) if c > 0 and n > 0 else None for g, c in ((train, n), (whole[j], m))]
                out.append((float(f), float(l1), float(l2), int(j), int(n), int(m), *rmse))
    return df.sparkSession.createDataFrame(out, "fraction double, l1 double, l2 double, fold int, n_train long, n_val long, train_rmse double, val_rmse double")


def curve(scores: DataFrame) -> DataFrame:
    """Mean and deviation over the folds, per share and penalty."""
    return scores.groupBy("fraction", "l1", "l2").agg(
        F.avg("train_rmse").alias("train_rmse"), F.avg("val_rmse").alias("val_rmse"), F.stddev_pop("val_rmse").alias("val_std"), F.sum("n_val").alias("n"))
