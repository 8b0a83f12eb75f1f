"""Executive figures of a blended against a learned premium."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratebook.config import SEGMENTS, Blend
from ratebook.functions import moments as m
from ratebook.functions.pricing import blend
from ratebook.operators import metrics


def kpis(df: DataFrame, y="y_true", ml="ml_pred", hybrid="hybrid_pred", act="act_pred", rule: Blend | None = None) -> DataFrame:
    rule = rule or Blend()
    keys = ("total_net_profit", "profit_per_policy", "n_underpriced", "total_underpricing_penalty", "churn_rate_pct")
    a, b = m.portfolio(y, ml, only=keys), m.portfolio(y, hybrid, only=keys)
    n = F.count(y)
    weight = F.avg(blend(ml, act, rule).weight)
    gain = F.try_divide(b["profit_per_policy"] - a["profit_per_policy"], F.abs(a["profit_per_policy"])) * 100.0
    return df.agg(
        (b["total_net_profit"] - a["total_net_profit"]).alias("profit_delta"),
        F.coalesce(gain, F.lit(0.0)).alias("profit_delta_pct"),
        (a["n_underpriced"] * 100.0 / n).alias("underpriced_pct_ml"),
        (b["n_underpriced"] * 100.0 / n).alias("underpriced_pct_hybrid"),
        (a["total_underpricing_penalty"] - b["total_underpricing_penalty"]).alias("penalty_saved"),
        (b["churn_rate_pct"] - a["churn_rate_pct"]).alias("churn_delta"),
        (m.rmse(y, hybrid) - m.rmse(y, ml)).alias("rmse_delta"), (m.male(y, hybrid) - m.male(y, ml)).alias("male_delta"),
        (m.smape(y, hybrid) - m.smape(y, ml)).alias("smape_delta"), weight.alias("effective_weight"),
        (F.abs(weight - F.lit(rule.ml_ratio)) > 0.15).alias("weight_gap_alarm"),
        (m.r2(y, ml) < 0).alias("negative_r2_alarm"))


def segment_alarms(df: DataFrame, limit: float = 80.0, y="y_true", p="price") -> DataFrame:
    segments = df.withColumn("segment", metrics.tier(y, SEGMENTS)).groupBy("segment").agg(
        F.count("segment").alias("n"), m.smape(y, p).alias("smape"), F.try_divide(F.avg(p), F.avg(y)).alias("mean_ratio"))
    worst_first = Window.partitionBy(F.lit(0)).orderBy(F.desc("smape"))  # one row per segment
    return segments.where((F.col("n") > 0) & (F.col("smape") > limit)).select(
        F.row_number().over(worst_first).alias("rank"), "segment", "n", "smape", "mean_ratio")
