"""Isolation forest: trees grown on small samples, scored over the whole table.

Every tree grows on a few hundred rows that a hash picks for it, one group per tree.
The finished trees are a bounded table of nodes; scoring carries it to the tasks and
walks all rows of an Arrow batch through each tree at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.config import KEY
from ratebook.operators.quantiles import quantiles

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


def average_path(n):
    """Expected depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        long_ = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, long_, np.where(n == 2, 1.0, 0.0))


def grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes (feature, threshold, left, right, size, depth) of one random tree."""
    nodes: list[list] = []
    todo = [(np.arange(len(points)), 0, None, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        index = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(rows), depth])
        if parent is not None:
            nodes[parent][2 + side] = index
        part = points[rows]
        spread = part.max(axis=0) - part.min(axis=0) if len(rows) else np.zeros(points.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        nodes[index][:2] = [f, cut]
        goes_left = part[:, f] < cut
        todo.append((rows[~goes_left], depth + 1, index, 1))
        todo.append((rows[goes_left], depth + 1, index, 0))
    return [tuple(n) for n in nodes]


@dataclass(frozen=True)
class IsolationForest:
    columns: tuple
    nodes: dict
    sample: int
    cut: float | None = None

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], trees: int = 100, sample: int = 256, contamination: float = 0.02,
            key: str = KEY, seed: int = 42) -> "IsolationForest":
        columns = list(columns)
        n = df.count()
        size = min(sample, n)
        # Half as many again are drawn, and each tree keeps the first by hash.
        chance = min(1.0, 1.5 * size / max(n, 1))
        limit = int(chance * (2**31 - 1))
        mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)),
                        lambda t: F.pmod(F.xxhash64(F.lit(seed), F.col(key), t), F.lit(2**31 - 1)) < limit)
        drawn = df.select(F.explode(mine).alias("tree"), F.xxhash64(F.lit(seed + 1), F.col(key)).alias("h"),
                          *[F.col(c).cast("double").alias(c) for c in columns])
        depth = max(1, math.ceil(math.log2(max(size, 2))))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            points = pdf.sort_values(["h", *columns]).head(size)[columns].to_numpy()
            made = grow(points, np.random.default_rng([seed, tree]), depth)
            out = pd.DataFrame(made, columns=["feature", "threshold", "left", "right", "size", "depth"])
            out.insert(0, "node", range(len(out)))
            out.insert(0, "tree", tree)
            return out

        grown = drawn.groupBy("tree").applyInPandas(one, NODE_SCHEMA).orderBy("tree", "node").toPandas()
        nodes = {int(t): g.drop(columns=["tree", "node"]).to_numpy(dtype=float) for t, g in grown.groupby("tree")}
        fitted = cls(tuple(columns), nodes, size)
        cut = quantiles(fitted.score(df, key), "score", [1 - contamination])[0]
        return cls(tuple(columns), nodes, size, cut)

    def score(self, df: DataFrame, key: str = KEY) -> DataFrame:
        """(key, score): near one for rows that few cuts set apart."""
        columns, nodes = list(self.columns), self.nodes
        norm = float(average_path(self.sample)) or 1.0

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = pdf[columns].to_numpy(dtype=float)
                total = np.zeros(len(x))
                for tree in nodes.values():
                    at = np.zeros(len(x), dtype=int)
                    for _ in range(int(tree[:, 5].max()) + 1):
                        f = tree[at, 0].astype(int)
                        inner = f >= 0
                        left = x[np.arange(len(x)), np.maximum(f, 0)] < tree[at, 1]
                        at = np.where(inner, np.where(left, tree[at, 2], tree[at, 3]).astype(int), at)
                    total += tree[at, 5] + average_path(tree[at, 4])
                yield pd.DataFrame({key: pdf[key], "score": 2.0 ** (-(total / max(len(nodes), 1)) / norm)})

        kind = dict(df.dtypes)[key]
        return df.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(walk, f"{key} {kind}, score double")

    def flag(self, df: DataFrame, key: str = KEY) -> DataFrame:
        return self.score(df, key).withColumn("outlier", F.col("score") > F.lit(self.cut))

    def keep_normal(self, df: DataFrame, key: str = KEY) -> DataFrame:
        return df.join(self.flag(df, key).where(~F.col("outlier")).select(key), key, "left_semi")
