"""Reproducible stratified splits, folds and sample weights.

A split is a set of hash thresholds: within each stratum the row with the k-th
smallest hash marks the border, found exactly by ``order_statistics``. Assigning a
row is then a comparison with a literal, so there is no window over a stratum and
strata may hold any share of the table. Sizes are exact per stratum.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratebook.config import KEY, SPLIT_QUANTILES, WEIGHT_QUANTILES, WEIGHT_TIERS
from ratebook.functions.columns import col, flag, hash_key, lookup
from ratebook.operators.quantiles import kept, order_statistics, quantiles
from ratebook.session import work_path


def quantile_bin(df: DataFrame, target: str, probs: Sequence[float], among: Column | None = None) -> Column:
    """0-based right-closed quantile bin; equal edges collapse into one.

    ``among`` limits the rows that set the edges. It blanks the value instead of
    filtering, as a filter would be pushed below everything computed so far.
    """
    value = col(target) if among is None else F.when(among, col(target))
    edges = sorted({e for e in quantiles(df, value, probs) if e is not None})
    out = F.lit(0)
    for e in edges:
        out = out + flag(col(target) > F.lit(e))
    return out


def _take(n: int, share: float) -> int:
    return math.floor(n * share + 0.5)


def _borders(df: DataFrame, stratum: str, ranks, key: str, seed: int, among: Column | None = None) -> dict:
    value = hash_key(key, seed)
    return order_statistics(df, value if among is None else F.when(among, value), ranks, by=[stratum])


def split_off(df: DataFrame, stratum: str, share: float, key: str = KEY, seed: int = 42, among: Column | None = None) -> Column:
    """Condition that holds for exactly the rounded share of each stratum's rows."""
    found = _borders(df, stratum, lambda n: [_take(n, share)] if _take(n, share) else [], key, seed, among)
    limits = {g: v[_take(n, share)] for g, (n, v) in found.items() if v}
    return F.coalesce(hash_key(key, seed) <= lookup([stratum], limits).cast("long"), F.lit(False))


def train_val_test(df: DataFrame, target: str = "charges", key: str = KEY, seed: int = 42, test: float = 0.15,
                   val: float = 0.20, probs: Sequence[float] = SPLIT_QUANTILES) -> DataFrame:
    """Adds ``split``: test drawn per target band, then validation per fifth of the rest.

    The borders are found on the key and the target alone, read once.
    """
    with kept(df.select(key, target)) as narrow:
        stratum = quantile_bin(narrow, target, probs)
        rows = narrow.withColumn("stratum", stratum)
        is_test = split_off(rows, "stratum", test, key, seed)
        rows = rows.withColumn("is_test", is_test)
        rest = ~F.col("is_test")
        fifth = quantile_bin(rows, target, [0.2, 0.4, 0.6, 0.8], rest)
        in_val = split_off(rows.withColumn("fifth", fifth), "fifth", val, key, seed + 1, rest)
    out = df.withColumn("stratum", stratum).withColumn("is_test", is_test).withColumn("fifth", fifth)
    split = F.when(F.col("is_test"), "test").when(in_val, "val").otherwise("train")
    return out.withColumn("split", split).drop("is_test", "fifth")


def holdout(df: DataFrame, target: str, key: str = KEY, seed: int = 42, share: float = 0.4, bins: int = 7) -> DataFrame:
    """Calibration and holdout rows, stratified on equal-count bins of the target."""
    with kept(df.select(key, target)) as narrow:
        stratum = quantile_bin(narrow, target, [i / bins for i in range(1, bins)])
        held = split_off(narrow.withColumn("stratum", stratum), "stratum", share, key, seed)
    return df.withColumn("stratum", stratum).withColumn("part", F.when(held, "holdout").otherwise("calibration"))


def folds(df: DataFrame, target: str, k: int = 5, key: str = KEY, seed: int = 42,
          probs: Sequence[float] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Adds ``fold``: within each quantile bin the folds differ by one row at most."""

    def ranks(n):
        return [j * n // k for j in range(1, k) if j * n // k]

    with kept(df.select(key, target)) as narrow:
        stratum = quantile_bin(narrow, target, probs)
        found = _borders(narrow.withColumn("stratum", stratum), "stratum", ranks, key, seed)
    fold = F.lit(0)
    for j in range(1, k):
        limits = {g: v[j * n // k] if j * n // k else -1 for g, (n, v) in found.items()}
        fold = fold + flag(hash_key(key, seed) > lookup(["stratum"], limits).cast("long"))
    return df.withColumn("stratum", stratum).withColumn("fold", fold)


def stored(df: DataFrame, name: str = "splits") -> DataFrame:
    """Write a split table to the shared folder and read it back: later runs replay it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def disjointness(splits: DataFrame, key: str = KEY, split: str = "split") -> DataFrame:
    """Rows, ids and ids that occur in more than one split."""
    per_id = splits.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.min(split).alias("a"), F.max(split).alias("b"))
    return per_id.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"),
        F.count_if(F.col("a") != F.col("b")).alias("n_overlapping")).withColumn(
        "disjoint", F.col("n_overlapping") == 0)


def overlap(splits: DataFrame, a: str, b: str, key: str = KEY, split: str = "split") -> DataFrame:
    """Ids that two splits share."""
    return splits.where(F.col(split) == a).select(key).intersect(splits.where(F.col(split) == b).select(key))


def replay(df: DataFrame, held: DataFrame, key: str = KEY) -> DataFrame:
    """The rows of a stored list of held-out ids."""
    return df.join(held.select(key), key, "left_semi")


def vanished(df: DataFrame, held: DataFrame, key: str = KEY) -> DataFrame:
    """Stored ids that the table no longer has."""
    return held.select(key).join(df.select(key), key, "left_anti")


def replay_strict(df: DataFrame, held: DataFrame, key: str = KEY) -> DataFrame:
    lost = vanished(df, held, key).limit(20).collect()
    if lost:
        raise ValueError(f"held-out ids are gone: {[r[key] for r in lost]}")
    return replay(df, held, key)


def sample_weight(df: DataFrame, target: str = "charges") -> Column:
    """Weight by target quantile tier; small or flat tables are not weighted."""
    row = df.agg(F.count(target).alias("n"), F.stddev_samp(target).alias("s")).first()
    if row["n"] < 20 or not row["s"]:
        return F.lit(1.0)
    edges = quantiles(df, target, WEIGHT_QUANTILES)
    y = col(target)
    if len(set(edges)) < 3:
        return F.when(y > F.lit(edges[1]), 2.0).otherwise(1.0)
    out = F.when(y <= F.lit(edges[0]), F.lit(WEIGHT_TIERS[0]))
    for e, w in zip(edges[1:], WEIGHT_TIERS[1:]):
        out = out.when(y <= F.lit(e), F.lit(w))
    return out.otherwise(F.lit(WEIGHT_TIERS[-1]))


def weight_check(df: DataFrame, weight: str = "weight", max_ratio: float = 100.0) -> DataFrame:
    w = F.col(weight)
    strange = w.isNull() | F.isnan(w) | (F.abs(w) == float("inf"))
    out = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(strange).alias("n_not_finite"), F.count_if(w < 0).alias("n_negative"),
        F.min(w).alias("min"), F.max(w).alias("max"), F.avg(w).alias("mean"))
    c = F.col
    ratio_ok = F.when(c("min") > 0, F.try_divide(c("max"), c("min")) <= max_ratio).otherwise(True)
    return out.withColumn("valid", (c("n_not_finite") == 0) & (c("n_negative") == 0) & ratio_ok & ~((c("min") == 0) & (c("max") == 0)))
