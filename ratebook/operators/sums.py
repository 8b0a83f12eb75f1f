"""Cross products of many columns from one scan."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratebook.functions.columns import col


def grams(df: DataFrame, columns: Sequence, by: Sequence[Column] = (), weight: Column | None = None) -> dict[tuple, np.ndarray]:
    """``{group: X'WX}`` over the rows of each group, for the matrix X of ``columns``; rows with a null are left out.

    Every task adds up one matrix per group it meets, and only those are shuffled. The groups must be few (folds,
    steps, tiers); a row with a null group key belongs to the group None.
    """
    k, keys = len(columns), [f"_g{i}" for i in range(len(by))]
    w = F.lit(1.0) if weight is None else weight.cast("double")
    narrow = df.select(*[b.alias(n) for b, n in zip(by, keys)], w.alias("_w"),
                       *[col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    names = ["_w", *[f"_x{i}" for i in range(k)]]
    narrow = narrow.dropna(subset=names)
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in narrow.schema.fields[:len(by)])
    i, j = (x.ravel() for x in np.indices((k, k)))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            for group, rows in groups:
                x, rw = rows[names[1:]].to_numpy(), rows["_w"].to_numpy()
                held[group] = held.get(group, 0) + (x * rw[:, None]).T @ x
        for group, total in held.items():
            own = {n: [None if pd.isna(v) else v] * (k * k) for n, v in zip(keys, group)}
            yield pd.DataFrame({**own, "i": i, "j": j, "v": total.ravel()})

    sums = narrow.mapInPandas(partial, f"{kinds}i int, j int, v double").groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))
    out: dict[tuple, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(tuple(r[n] for n in keys), np.zeros((k, k)))[r["i"], r["j"]] = r["v"]
    return out


def elastic_solution(gram: np.ndarray, target: np.ndarray, l1: np.ndarray, l2: np.ndarray, start: np.ndarray | None = None,
                     rounds: int = 10_000, tolerance: float = 1e-12) -> np.ndarray:
    """Minimum of b'Gb/2 - c'b + sum(l1 |b|) + sum(l2 b^2)/2 by coordinate descent; without l1 by solving directly.

    A column without variation (a zero on the diagonal) keeps the coefficient 0.
    """
    k = len(target)
    if not l1.any():
        return np.linalg.lstsq(gram + np.diag(l2), target, rcond=None)[0]
    b = np.zeros(k) if start is None else start.astype(float).copy()
    diagonal = np.diag(gram) + l2
    scale = max(1e-300, float(np.abs(b).max(initial=0)), float(np.abs(target / np.where(diagonal > 0, diagonal, 1)).max(initial=0)))
    for _ in range(rounds):
        moved = 0.0
        for j in range(k):
            if diagonal[j] <= 0:
                continue
            pull = target[j] - gram[j] @ b + gram[j, j] * b[j]
            new = np.sign(pull) * max(0.0, abs(pull) - l1[j]) / diagonal[j]
            moved, b[j] = max(moved, abs(new - b[j])), new
        if moved <= tolerance * scale:
            break
    return b
