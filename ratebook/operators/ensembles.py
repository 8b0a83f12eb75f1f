"""Boosted trees judged round by round, and forests judged by the trees that have not seen a row."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratebook.config import KEY
from ratebook.functions import moments as m
from ratebook.functions.columns import hash_key
from ratebook.operators import learners


def tree_predictions(trees: Sequence, df: DataFrame, inputs: Sequence[str], output: str = "_trees") -> DataFrame:
    """Adds an array with each tree's own prediction: one projection, nothing is exploded or shuffled."""
    rows, names = learners.assembled(df, inputs), []
    for i, tree in enumerate(trees):
        names.append(f"_t{i}")
        rows = tree.copy({tree.predictionCol: names[-1]}).transform(rows)
    return rows.withColumn(output, F.array(*names)).drop(*names, "features")


def staged_losses(model, df: DataFrame, inputs: Sequence[str] = learners.INPUTS, alpha: float | None = None, weight: str | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    """(by, round, n, loss) of the first 1, 2, ... trees of a boosted model, all from one pass over the rows.

    A row's tree predictions are added up along the rounds; tasks sum the losses per round, and only those sums are
    shuffled. The loss is the squared error, or the pinball loss at ``alpha``; ``n`` is the sum of the weights.
    Rows without a label are left out.
    """
    shares = np.array(model.treeWeights)
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = tree_predictions(model.trees, df.where("label IS NOT NULL"), inputs).select(*by, "label", w.alias("_w"), "_trees")
    keys = list(by)
    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            e = pdf["label"].to_numpy()[:, None] - np.cumsum(np.stack(pdf["_trees"].to_numpy()) * shares, axis=1)
            loss = e * e if alpha is None else np.where(e >= 0, alpha * e, (alpha - 1) * e)
            for group, at in (pdf.groupby(keys, dropna=False, sort=False).indices.items() if keys else [((), np.arange(len(pdf)))]):
                group, rw = group if isinstance(group, tuple) else (group,), pdf["_w"].to_numpy()[at]
                sums = np.vstack([rw @ loss[at], np.full(len(shares), rw.sum())])
                held[group] = held.get(group, 0) + sums
        for group, sums in held.items():
            yield pd.DataFrame({**{c: v for c, v in zip(keys, group)}, "round": np.arange(1, len(shares) + 1), "loss": sums[0], "n": sums[1]})

    sums = rows.mapInPandas(partial, f"{kinds}round int, loss double, n double").groupBy(*keys, "round").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    return sums.withColumn("loss", F.try_divide("loss", "n"))


def best_round(losses: Sequence[float], patience: int) -> int:
    """The 1-based round that stopping by patience keeps: the best one before ``patience`` rounds brought nothing better."""
    best, at = math.inf, 0
    for i, loss in enumerate(losses, 1):
        if loss < best:
            best, at = loss, i
        elif i - at >= patience:
            break
    return at


@dataclass(frozen=True)
class StoppedTrees:
    """A boosted model cut behind its best round on rows apart."""

    model: object
    rounds: int
    losses: tuple
    inputs: tuple

    @classmethod
    def fit(cls, train: DataFrame, validation: DataFrame, patience: int = 50, inputs: Sequence[str] = learners.INPUTS, weight: str | None = None,
            alpha: float | None = None, **params) -> "StoppedTrees":
        """All rounds are grown; then the losses of every prefix on the validation rows decide. ``alpha`` judges by pinball."""
        if weight:
            params["weightCol"] = weight
        model = learners.BUILDERS["boosted"](featuresCol="features", labelCol="label", **params).fit(learners.assembled(train, inputs))
        rows = staged_losses(model, validation, inputs, alpha).orderBy("round").collect()
        if not rows:
            raise ValueError("no validation rows")
        losses = tuple(r["loss"] for r in rows)
        return cls(model, best_round(losses, patience), losses, tuple(inputs))

    def transform(self, df: DataFrame, output: str = "prediction") -> DataFrame:
        trees, shares = self.model.trees[:self.rounds], self.model.treeWeights[:self.rounds]
        rows = tree_predictions(trees, df, self.inputs)
        total = F.lit(0.0)
        for i, share in enumerate(shares):
            total = total + F.col("_trees")[i] * F.lit(float(share))
        return rows.withColumn(output, total).drop("_trees")


def draws(tree: int, key: str = KEY, seed: int = 42) -> Column:
    """How often a row is in a tree's bag: a Poisson draw of mean 1 from a hash of (key, tree), the same whenever asked."""
    u = hash_key(key, seed * 100_003 + tree).cast("double") / F.lit(2.0**60)
    out, upto, share = F.lit(0), 0.0, math.exp(-1)
    for k in range(1, 9):
        upto += share
        share /= k
        out = out + (u >= F.lit(upto)).cast("int")
    return out


@dataclass(frozen=True)
class BaggedForest:
    """Trees grown on bags that the rows' keys decide, so that at any time it is known which trees have seen a row."""

    trees: tuple
    inputs: tuple
    key: str
    seed: int

    @classmethod
    def fit(cls, df: DataFrame, trees: int = 20, inputs: Sequence[str] = learners.INPUTS, key: str = KEY, seed: int = 42, **params) -> "BaggedForest":
        rows = learners.assembled(df.where("label IS NOT NULL"), inputs)
        grown = []
        for t in range(trees):
            one = RandomForestRegressor(**{"maxDepth": 8, "featureSubsetStrategy": "onethird", **params}, numTrees=1, bootstrap=False, subsamplingRate=1.0,
                                        seed=seed + t, featuresCol="features", labelCol="label", weightCol="_draws")
            bag = rows.withColumn("_draws", draws(t, key, seed).cast("double")).where("_draws > 0")
            grown.append(one.fit(bag).trees[0])
        return cls(tuple(grown), tuple(inputs), key, seed)

    def votes(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` of all trees, ``out_of_bag`` of those that have not seen the row (null if all have) and
        their number ``n_trees``. The rows' keys must be those of the fit."""
        rows = tree_predictions(self.trees, df, self.inputs)
        unseen = F.array(*[draws(t, self.key, self.seed) == 0 for t in range(len(self.trees))])
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
        rows = rows.withColumn("_free", F.transform(F.filter(F.arrays_zip(F.col("_trees").alias("p"), unseen.alias("u")), lambda z: z["u"]), lambda z: z["p"]))
        return rows.withColumns({"prediction": total("_trees") / len(self.trees), "n_trees": F.size("_free"),
                                 "out_of_bag": F.when(F.size("_free") > 0, total("_free") / F.size("_free"))}).drop("_trees", "_free")

    def score(self, df: DataFrame) -> DataFrame:
        """(n, n_judged, rmse, r2, mean_trees) over the rows that some tree has not seen: the forest's own holdout."""
        rows = self.votes(df.where("label IS NOT NULL"))
        judged = F.when(F.col("out_of_bag").isNotNull(), F.col("label"))
        return rows.withColumn("_y", judged).agg(
            F.count("label").alias("n"), F.count("_y").alias("n_judged"), m.rmse("_y", "out_of_bag").alias("rmse"),
            m.r2("_y", "out_of_bag").alias("r2"), F.avg("n_trees").alias("mean_trees"))
