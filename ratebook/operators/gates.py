"""Deployment gates: verdicts over metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.config import GATE_TIERS, Tiers
from ratebook.functions import moments as m
from ratebook.functions.columns import col
from ratebook.operators import metrics

VETO_R2 = -1.0
VETO_ROWS = 30
VETO_STD = 2000.0


def weighted_r2_gate(df: DataFrame, tiers: Tiers = GATE_TIERS, y="y_true", p="price", minimum: float = 0.75) -> DataFrame:
    """Revenue-weighted R² with a hard veto for broad tiers that are far worse than their mean."""
    table = metrics.tier_table(df, tiers, y, p)
    bad = F.col("r2") < VETO_R2
    firm = bad & (F.col("n") >= VETO_ROWS) & (F.col("std_true") >= VETO_STD)

    def listed(test):
        names = F.collect_list(F.when(test, F.struct("position", "segment")))  # one entry per tier
        return F.concat_ws("|", F.transform(F.array_sort(names), lambda s: s["segment"]))

    verdict = table.agg(
        listed(firm).alias("veto_segments"), listed(bad & ~firm).alias("advisory_segments"),
        listed(F.col("r2") < 0).alias("critical_segments"),
        listed((F.col("r2") >= 0) & (F.col("r2") < 0.5)).alias("warning_segments"))
    score = metrics.weighted_r2(df, tiers, y, p).first()
    value = score["weighted_r2"] if score else None
    return verdict.select(
        F.lit(value).cast("double").alias("weighted_r2"), "*",
        (F.coalesce(F.lit(value) >= minimum, F.lit(False)) & (F.col("veto_segments") == "")).alias("passed"))


def overpricing_gate(df: DataFrame, y="y_true", p="price", alpha: float | None = None, limit: float = 0.62) -> DataFrame:
    """Symmetric models may overprice up to a limit; quantile models must stay near their level."""
    rate = m.share(col(p) > col(y))
    ok = rate <= limit if alpha is None else F.abs(rate - F.lit(alpha)) <= 0.10
    loss = F.avg(metrics.pinball(y, p, alpha)) if alpha is not None else F.lit(None).cast("double")
    return df.agg(rate.alias("overpricing_rate"), m.rmse(y, p).alias("rmse"), loss.alias("pinball"), ok.alias("passed"))


# Limits of the release check.
RELEASE_LIMITS = {"r2": 0.70, "overpriced": 0.62, "gap": 0.20, "rmse": 7000.0}


def release_gates(splits: DataFrame, y="y_true", p="price", split="split") -> DataFrame:
    """Six checks of the test split, one row each."""
    is_test, is_train = F.col(split) == "test", F.col(split) == "train"
    ty, tp = F.when(is_test, col(y)), F.when(is_test, col(p))
    e = tp - ty
    train_e = F.when(is_train, col(p) - col(y))
    n = F.count(ty)
    one = splits.agg(
        (1.0 - F.try_divide(F.sum(e * e), F.var_pop(ty) * n)).alias("r2"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.avg(train_e * train_e)).alias("train_rmse"),
        F.try_divide(F.count_if(F.try_divide(e, ty) > 0.10), n).alias("overpriced"),
        F.count_if(F.isnan(tp) | (is_test & col(p).isNull())).alias("n_nan"), F.count_if(tp < 0).alias("n_negative"))
    one = one.withColumn("gap", F.coalesce(F.try_divide(F.col("rmse") - F.col("train_rmse"), F.col("train_rmse")), F.lit(0.0)))
    c = F.col
    checks = {
        "r2_above_minimum": (c("r2"), c("r2") >= RELEASE_LIMITS["r2"]),
        "overpricing_rate": (c("overpriced"), c("overpriced") <= RELEASE_LIMITS["overpriced"]),
        "train_test_gap": (c("gap"), c("gap") <= RELEASE_LIMITS["gap"]),
        "rmse_cap": (c("rmse"), c("rmse") <= RELEASE_LIMITS["rmse"]),
        "no_nan": (c("n_nan").cast("double"), c("n_nan") == 0),
        "no_negative": (c("n_negative").cast("double"), c("n_negative") == 0),
    }
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("gate"), v.alias("value"), ok.alias("passed")) for k, (v, ok) in checks.items()])))


def routing_guard(df: DataFrame, y="y_true", base="base", routed="routed", tolerance: float = 0.005) -> DataFrame:
    """Keep a routing unless it costs R²."""
    out = df.agg(m.r2(y, base).alias("r2_base"), m.r2(y, routed).alias("r2_routed"))
    return out.withColumn("accepted", F.col("r2_routed") >= F.col("r2_base") - tolerance)
