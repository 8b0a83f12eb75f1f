"""Choosing among candidates: ranked sweeps and the best model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratebook.functions import moments as m
from ratebook.functions.columns import col
from ratebook.operators import gates, metrics


def ranked_sweep(df: DataFrame, configs: list[dict] | None = None) -> DataFrame:
    """Blend settings ranked by their RMSE gap to the learned premium alone, with gate flags."""
    sweep = metrics.config_sweep(df, configs, overpricing=True)
    whole = Window.partitionBy(F.lit(0))  # one row per setting
    base = F.max(F.when(F.col("position") == 0, F.col("rmse"))).over(whole)
    rows = sweep.withColumn("gap", F.try_divide(F.abs(F.col("rmse") - base), base)).where(F.col("position") > 0)
    limits = gates.RELEASE_LIMITS
    rows = rows.withColumns({
        "gap_ok": F.col("gap") <= limits["gap"], "r2_ok": F.col("r2") >= limits["r2"],
        "overpricing_ok": F.col("overpricing_rate") <= limits["overpriced"]})
    rank = F.row_number().over(whole.orderBy(F.round("gap", 8), "position"))
    return rows.select(
        rank.alias("rank"), "name", "gap", "r2", "overpricing_rate", "gap_ok", "r2_ok", "overpricing_ok",
        (F.col("gap_ok") & F.col("r2_ok") & F.col("overpricing_ok")).alias("passed"))


def best_candidate(ranked: DataFrame) -> DataFrame:
    return ranked.where("passed").orderBy("rank").limit(1)


def model_scores(df: DataFrame, models: dict[str, str], y="y_true") -> DataFrame:
    """Validation RMSE and R² per model in one scan."""
    return metrics.stacked(df, models, keep=[y]).groupBy("model").agg(
        m.rmse(y, "price").alias("val_rmse"), m.r2(y, "price").alias("val_r2"))


def best_model(scores: DataFrame, fallback: Sequence[str] = ()) -> DataFrame:
    """Smallest validation RMSE; models without one follow in the given order, then by name."""
    order = F.array_position(F.array(*[F.lit(x) for x in fallback]), F.col("model")) if fallback else F.lit(0)
    return scores.orderBy(
        F.col("val_rmse").asc_nulls_last(), F.when(order == 0, len(fallback) + 1).otherwise(order), "model").limit(1)
