"""Profit of one policy: what a premium earns against the true charge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratebook.config import Economics
from ratebook.functions.columns import col

MEASURES = (
    "revenue", "gross_profit", "churn_probability", "churn_cost",
    "underpricing_penalty", "accuracy_bonus", "net_profit",
)


def policy_economics(true="y_true", price="price", e: Economics | None = None) -> dict[str, Column]:
    e = e or Economics()
    y, p = col(true), col(price)
    error = p - y
    share = F.when(y > 0, error / y).otherwise(0.0)
    revenue = p * F.lit(1.0 + e.margin)
    gross = p - y + F.lit(e.margin) * p - F.lit(e.admin)
    churn = F.when(
        error > 0,
        F.least(F.greatest(share - F.lit(e.churn_threshold), F.lit(0.0)) * F.lit(e.churn_sensitivity),
                F.lit(e.churn_cap)),
    ).otherwise(0.0)
    churn_cost = churn * (y * F.lit(e.lifetime_multiplier) + F.lit(e.acquisition_cost))
    gap = F.least(F.abs(error) * F.lit(e.underpricing_share), revenue * F.lit(e.underpricing_cap))
    severe = F.when(F.abs(share) > F.lit(e.severe_share), F.lit(e.severe_penalty)).otherwise(0.0)
    penalty = F.when(error < 0, gap + severe).otherwise(0.0)
    bonus = (
        F.when(F.abs(share) <= F.lit(e.error_band / 2), F.lit(e.accuracy_bonus))
        .when(F.abs(share) <= F.lit(e.error_band), F.lit(e.accuracy_bonus * 0.5))
        .otherwise(0.0))
    return {
        "error": error,
        "error_share": share,
        "revenue": revenue,
        "gross_profit": gross,
        "churn_probability": churn,
        "churn_cost": churn_cost,
        "underpricing_penalty": penalty,
        "accuracy_bonus": bonus,
        "net_profit": gross - churn_cost - penalty + bonus,
        "accurate": F.abs(share) <= F.lit(e.error_band),
    }


def business_score(profit_per_policy: Column, churn_rate: Column, accuracy_rate: Column,
                   e: Economics | None = None) -> Column:
    """0-100: profitability up to 50, retention up to 30, accuracy up to 20."""
    e = e or Economics()
    ratio = profit_per_policy / F.lit(e.profit_target)
    profit = (
        F.when(ratio >= 1, F.lit(50.0))
        .when(ratio >= 0, F.lit(25.0) + ratio * F.lit(25.0))
        .otherwise(F.greatest(F.lit(-50.0), ratio * F.lit(25.0))))
    retention = (
        F.when(churn_rate <= e.churn_low,
               F.lit(e.retention_max) * (F.lit(1.0) - F.lit(0.5) * churn_rate / F.lit(e.churn_low)))
        .when(churn_rate <= e.churn_high,
              F.lit(e.retention_max * 0.5)
              * (F.lit(1.0) - (churn_rate - F.lit(e.churn_low)) / F.lit(e.churn_high - e.churn_low)))
        .otherwise(0.0))
    return profit + retention + accuracy_rate * F.lit(e.quality_weight)
