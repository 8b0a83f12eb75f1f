"""Data drift against a stored baseline, and performance over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratebook.functions import moments as m
from ratebook.functions.columns import col, lookup
from ratebook.operators.quantiles import column_quantiles, melt
from ratebook.operators.validation import CATEGORIES, NUMERIC, value_counts

Z_LIMIT = 2.0
TVD_LIMIT = 0.05


def numeric_baseline(df: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """One row per feature: mean, sample deviation, extremes and quartiles."""
    cuts = column_quantiles(df, columns, (0.25, 0.5, 0.75))
    stats = melt(df, columns).groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.select("*", *[
        lookup("feature", {c: cuts[c][i] for c in columns}).alias(q) for i, q in enumerate(("q25", "q50", "q75"))])


def category_baseline(df: DataFrame, columns: Sequence[str] = CATEGORIES) -> DataFrame:
    counts = value_counts(df, columns).where(F.col("value").isNotNull())
    total = F.sum("n").over(Window.partitionBy("feature"))  # one row per category
    return counts.select("feature", F.col("value").alias("category"), (F.col("n") / total).alias("share"))


def numeric_drift(new: DataFrame, baseline: DataFrame, columns: Sequence[str] = NUMERIC, limit: float = Z_LIMIT) -> DataFrame:
    """Shift of the mean in standard errors of the baseline; fewer than two rows report nothing."""
    present = [c for c in columns if c in new.columns]
    now = melt(new, present).groupBy("feature").agg(F.avg("value").alias("new_mean"), F.count("value").alias("n_new"))
    z = F.abs(F.col("new_mean") - F.col("mean")) / (F.col("std") / F.sqrt(F.col("n_new").cast("double")) + 1e-10)
    out = now.where(F.col("n_new") >= 2).join(baseline.select("feature", "mean", "std"), "feature")
    return out.select("feature", "n_new", "new_mean", F.col("mean").alias("base_mean"), z.alias("z"), (z > limit).alias("drifted"))


def category_drift(new: DataFrame, baseline: DataFrame, columns: Sequence[str] = CATEGORIES, limit: float = TVD_LIMIT) -> DataFrame:
    """Total variation distance over the union of old and new categories."""
    present = [c for c in columns if c in new.columns]
    now = category_baseline(new, present).withColumnRenamed("share", "new_share")
    base = baseline.where(F.col("feature").isin(*present))
    both = base.join(now, ["feature", "category"], "full_outer")
    gap = F.abs(F.coalesce("share", F.lit(0.0)) - F.coalesce("new_share", F.lit(0.0)))
    return both.groupBy("feature").agg((F.sum(gap) * 0.5).alias("tvd"), F.count(F.lit(1)).alias("n_categories")).withColumn(
        "drifted", F.col("tvd") > limit)


def missing_features(new: DataFrame, columns: Sequence[str] = (*NUMERIC, *CATEGORIES)) -> list[str]:
    """Baseline features that a delivery lacks: reported, not failed."""
    return [c for c in columns if c not in new.columns]


def compare_batches(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two deliveries against each other, without a stored baseline."""
    base = melt(old, NUMERIC).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    numbers = numeric_drift(new, base).select("feature", F.lit("z").alias("measure"), F.col("z").alias("value"), "drifted")
    texts = category_drift(new, category_baseline(old)).select("feature", F.lit("tvd").alias("measure"), F.col("tvd").alias("value"), "drifted")
    return numbers.unionByName(texts)


def snapshots(df: DataFrame, batch: str, y="y_true", p="price") -> DataFrame:
    """Performance per batch. MAPE is null as soon as one true value is zero."""
    e = col(y) - col(p)
    spread = F.var_pop(col(y)) * F.count(col(y))
    return df.groupBy(batch).agg(
        F.count(col(y)).alias("n"), m.mae(y, p).alias("mae"), m.rmse(y, p).alias("rmse"),
        F.when(F.count_if(col(y) == 0) == 0, F.avg(F.abs(F.try_divide(e, col(y)))) * 100.0).alias("mape"),
        (1.0 - F.sum(e * e) / (spread + 1e-10)).alias("r2"), F.avg(p).alias("mean_pred"), F.stddev_pop(p).alias("std_pred"))


def degradation(history: DataFrame, order: str, max_mae: float | None = None, max_rmse: float | None = None,
                min_r2: float | None = None) -> DataFrame:
    """Verdict on the newest snapshot against whichever thresholds are given."""
    newest = history.agg(F.max_by(F.struct("mae", "rmse", "r2"), order).alias("s"), F.max(order).alias(order)).select(order, "s.*")
    checks = [("mae", max_mae, lambda c, v: c > v), ("rmse", max_rmse, lambda c, v: c > v), ("r2", min_r2, lambda c, v: c < v)]
    reasons = F.concat_ws("|", *[F.when(f(F.col(k), v), F.lit(k)) for k, v, f in checks if v is not None])
    return newest.withColumn("reasons", reasons).withColumn("degraded", F.col("reasons") != "")


def request_metrics(log: DataFrame, window: int = 1000) -> DataFrame:
    """Totals over all requests and latency figures over the newest ones.

    The latency part first takes a top-n, so its percentiles see at most ``window`` rows.
    """
    served = ~F.col("rejected")
    totals = log.agg(
        F.count_if(served).alias("total"), F.count_if(served & ~F.col("ok")).alias("errors"),
        F.count_if("rejected").alias("rejected")).first()
    last = log.where(served).select("ts", "event_id", "latency").orderBy(F.desc("ts"), F.desc("event_id")).limit(window)
    out = last.agg(
        F.count("latency").alias("samples"), F.avg("latency").alias("mean"),
        *[F.percentile("latency", p).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
    total = totals["total"]
    return out.select(
        F.lit(total).alias("total"), F.lit(total - totals["errors"]).alias("successful"), F.lit(totals["errors"]).alias("errors"),
        F.lit(totals["errors"] / total * 100.0 if total else 0.0).alias("error_pct"), F.lit(totals["rejected"]).alias("rejected"), "*")
