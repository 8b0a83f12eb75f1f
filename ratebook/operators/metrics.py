"""Metric reports: overall, per band, per model, and the comparison of models.

Rows outside every band form a group of their own whose count of bands is zero; it is
dropped on the finished groups. The same test on the band itself would be pushed down
into the scan, where the whole premium formula would be computed once more per row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratebook.config import FOUR_TIERS, GATE_TIERS, PREDICTION_BINS, SEGMENTS, Blend, Economics, Tiers
from ratebook.functions import moments as m
from ratebook.functions.columns import band, col, flag, hash_key, lookup
from ratebook.functions.economics import MEASURES, business_score, policy_economics
from ratebook.functions.pricing import blend
from ratebook.operators.quantiles import exact_quantiles, kept, melt, quantiles

LOW_VALUE = 4500.0


def stacked(df: DataFrame, models: dict[str, str], keep: Sequence[str] = ("policy_id", "y_true")) -> DataFrame:
    """Long form (model, price), expanded inside the scan stage."""
    pairs = F.array(*[
        F.struct(F.lit(name).alias("model"), F.col(c).alias("price")) for name, c in models.items()])
    return df.select(*keep, F.inline(pairs))


def tier(x, tiers: Tiers) -> Column:
    return band(x, tiers.edges, tiers.labels, include_lowest=True)


def medians(df: DataFrame, value, by: Sequence[str] = (), prob: float = 0.5) -> Column:
    """The exact group median of a value, as a literal lookup over the grouping columns."""
    found = exact_quantiles(df, value, [prob], by)
    if not by:
        return F.lit(found.get((), [None])[0])
    return lookup(list(by), {g: v[0] for g, v in found.items()})


def accuracy_report(df: DataFrame, y="y_true", p="price", by: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*by).agg(*m.named(m.accuracy(y, p)))
    return out.withColumn("median_error", medians(df, col(p) - col(y), by))


def training_metrics(df: DataFrame, y="y_true", p="price", n_features: int = 1) -> DataFrame:
    e = col(y) - col(p)
    n = F.count(col(y))
    fit = m.r2(y, p)
    adjusted = F.when(n > n_features + 1, 1.0 - (1.0 - fit) * (n - 1) / (n - n_features - 1)).otherwise(fit)
    return df.agg(
        n.alias("n"), F.avg(e * e).alias("mse"), m.rmse(y, p).alias("rmse"), m.mae(y, p).alias("mae"),
        m.mape(y, p, 1.0).alias("mape"), fit.alias("r2"), adjusted.alias("adjusted_r2"),
        F.avg(e).alias("residual_mean"), F.stddev_pop(e).alias("residual_std"),
        m.skew_sample(e).alias("residual_skewness"), m.kurt_sample(e).alias("residual_kurtosis"))


def economics(df: DataFrame, y="y_true", p="price", e: Economics | None = None) -> DataFrame:
    row = policy_economics(y, p, e)
    return df.select("*", *[row[name].alias(name) for name in MEASURES])


def portfolio_report(df: DataFrame, y="y_true", p="price", by: Sequence[str] = (), e: Economics | None = None) -> DataFrame:
    return df.groupBy(*by).agg(F.count(col(y)).alias("n"), *m.named(m.portfolio(y, p, e)))


def segment_report(df: DataFrame, tiers: Tiers = SEGMENTS, y="y_true", p="price") -> DataFrame:
    """Accuracy and economics per band of the true charge."""
    rows = df.withColumn("segment", tier(y, tiers))
    keep = m.portfolio(y, p, only=("total_net_profit", "profit_per_policy", "churn_rate_pct"))
    out = rows.groupBy("segment").agg(*m.named({**m.accuracy(y, p), **keep, "n": F.count("segment")})).where("n > 0")
    return _with_share(out).withColumn("median_error", medians(rows, col(p) - col(y), ["segment"]))


def _with_share(segments: DataFrame) -> DataFrame:
    """Share of each segment; the window spans one row per segment."""
    everything = Window.partitionBy(F.lit(0))
    return segments.withColumn("pct_of_total", F.col("n") * 100.0 / F.sum("n").over(everything))


def quantile_tiers(df: DataFrame, y="y_true") -> Tiers:
    q50, q75, q95 = quantiles(df, y, [0.5, 0.75, 0.95])
    return Tiers((float("-inf"), q50, q75, q95, float("inf")), ("low", "mid", "high", "extreme"))


def stored_gate_tiers(q50: float, q75: float) -> Tiers:
    """Gate bands rebuilt from thresholds stored when a model was trained."""
    return Tiers((0.0, q50 / 2, q50, q75, GATE_TIERS.edges[4], float("inf")), GATE_TIERS.labels, GATE_TIERS.weights)


def gate_segment_report(df: DataFrame, tiers: Tiers = GATE_TIERS, y="y_true", p="price") -> DataFrame:
    rows = df.withColumn("segment", tier(y, tiers))
    out = rows.groupBy("segment").agg(
        F.count("segment").alias("n"), m.rmse(y, p).alias("rmse"), m.mae(y, p).alias("mae"), m.r2(y, p).alias("r2"),
        m.share(col(p) > col(y)).alias("overpricing_rate"), F.avg(col(y)).alias("mean_true"),
        F.avg(col(p)).alias("mean_pred"), F.avg(col(p) - col(y)).alias("mean_error")).where("n > 0")
    bad = F.coalesce(F.col("r2") < -1, F.lit(False))
    return _with_share(out).select(
        "*", medians(rows, col(p) - col(y), ["segment"]).alias("median_error"),
        (bad & (F.col("n") < 30)).alias("advisory"), (bad & (F.col("n") >= 30)).alias("veto"))


def comprehensive(df: DataFrame, models: dict[str, str], threshold: float = LOW_VALUE) -> DataFrame:
    """Overall, low and high in one pass with grouping sets over (model) and (model, band)."""
    rows = stacked(df, models).withColumn(
        "band", F.when(F.col("y_true") < threshold, "low_value").otherwise("high_value"))
    out = rows.groupingSets([["model"], ["model", "band"]], "model", "band").agg(
        *m.named({**m.accuracy(), **m.portfolio()}))
    error = F.col("price") - F.col("y_true")
    middle = F.coalesce(medians(rows, error, ["model", "band"]), medians(rows, error, ["model"]))
    return out.withColumn("median_error", middle).withColumn("band", F.coalesce("band", F.lit("overall")))


def asymmetric_cost(df: DataFrame, y="y_true", p="price", under: float = 0.3, over: float = 1.0) -> DataFrame:
    gap = col(p) - col(y)
    short, long_ = F.when(gap < 0, -gap), F.when(gap > 0, gap)
    n = F.count(col(y))
    cost_under = F.coalesce(F.sum(short), F.lit(0.0)) * F.lit(under)
    cost_over = F.coalesce(F.sum(long_), F.lit(0.0)) * F.lit(over)
    return df.agg(
        (cost_under + cost_over).alias("total_cost"), F.try_divide(cost_under + cost_over, n).alias("cost_per_policy"),
        cost_under.alias("underpricing_cost"), cost_over.alias("overpricing_cost"),
        F.count(short).alias("n_underpriced"), F.count(long_).alias("n_overpriced"),
        F.try_divide(F.count(short) * 100.0, n).alias("underpricing_pct"),
        F.coalesce(F.avg(short), F.lit(0.0)).alias("avg_underprice"),
        F.coalesce(F.avg(long_), F.lit(0.0)).alias("avg_overprice"))


def tier_weight(y, tiers: Tiers = GATE_TIERS) -> Column:
    return band(y, tiers.edges, tiers.weights, include_lowest=True)


def weighted_r2(df: DataFrame, tiers: Tiers = GATE_TIERS, y="y_true", p="price", by: Sequence[str] = ()) -> DataFrame:
    """R² with revenue weights, in one pass: the spread around the weighted mean follows
    from the tier means and variances, so no second scan and no cancellation of squares."""
    e = col(p) - col(y)
    per_tier = (
        df.withColumn("w", tier_weight(y, tiers)).groupBy(*by, "w").agg(
            F.count("w").alias("n"), F.avg(col(y)).alias("mean"), F.var_pop(col(y)).alias("var"),
            F.sum(e * e).alias("ss_res")).where("n > 0"))
    weight = F.col("w") * F.col("n")
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    centre = F.sum(weight * F.col("mean")).over(whole) / F.sum(weight).over(whole)
    spread = per_tier.withColumn("centre", centre).groupBy(*by).agg(
        F.sum(weight * (F.col("var") + (F.col("mean") - F.col("centre")) * (F.col("mean") - F.col("centre")))).alias("total"),
        F.sum(F.col("w") * F.col("ss_res")).alias("residual"))
    return spread.select(*by, F.when(F.col("total") >= 1e-10, 1.0 - F.try_divide(F.col("residual"), F.col("total")))
                         .alias("weighted_r2"))


def tier_table(df: DataFrame, tiers: Tiers = FOUR_TIERS, y="y_true", p="price", at_least: int = 5) -> DataFrame:
    """One row per tier, empty tiers included; metrics only from five rows on."""
    spark = df.sparkSession
    names = spark.createDataFrame([(i, t) for i, t in enumerate(tiers.labels)], "position int, segment string")
    found = df.withColumn("segment", tier(y, tiers)).groupBy("segment").agg(
        F.count("segment").alias("n"), m.r2(y, p).alias("r2"), m.rmse(y, p).alias("rmse"), m.mae(y, p).alias("mae"),
        m.share(col(p) > col(y)).alias("overpricing_rate"), F.stddev_pop(col(y)).alias("std_true")).where("n > 0")
    enough = F.col("n") >= at_least
    return names.join(found, "segment", "left").select(
        "position", "segment", F.coalesce("n", F.lit(0)).alias("n"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("r2", "rmse", "mae", "overpricing_rate", "std_true")])


def within_bands(df: DataFrame, y="y_true", p="price", shares=(0.05, 0.10, 0.15, 0.20)) -> DataFrame:
    gap = F.abs(col(p) - col(y))
    relative = F.abs(F.try_divide(col(p) - col(y), col(y)))
    out = df.agg(
        *[m.share(relative <= s).alias(f"within_{round(s * 100)}pct") for s in shares],
        F.avg(gap).alias("mean_abs_error"), F.max(gap).alias("max_abs_error"),
        m.share(col(p) > col(y)).alias("overpriced_share"), m.share(col(p) < col(y)).alias("underpriced_share"))
    return out.withColumn("median_abs_error", medians(df, gap))


def error_by_range(df: DataFrame, tiers: Tiers = FOUR_TIERS, y="y_true", p="price") -> DataFrame:
    return (
        df.withColumn("range", band(p, tiers.edges, tiers.labels)).groupBy("range").agg(
            F.count("range").alias("n"), m.rmse(y, p).alias("rmse"), m.mae(y, p).alias("mae"),
            F.avg(F.abs(F.try_divide(col(y) - col(p), col(y)))).alias("mape")).where("n > 0"))


def prediction_distribution(df: DataFrame, tiers: Tiers = PREDICTION_BINS, y="y_true", p="price") -> DataFrame:
    e = col(y) - col(p)
    bins = df.withColumn("bin", band(p, tiers.edges, tiers.labels)).groupBy("bin").agg(
        F.count("bin").alias("n")).where("n > 0")
    overall = df.agg(F.avg(e).alias("mean"), F.count(F.lit(1)).alias("n")).first()
    return bins.select(
        "bin", "n", (F.col("n") * 100.0 / F.lit(overall["n"])).alias("pct"),
        F.lit(overall["mean"]).alias("mean_residual"), medians(df, e).alias("median_residual"),
        medians(df, F.abs(e), prob=0.95).alias("p95_abs_error"))


def calibration_table(df: DataFrame, bins: int = 10, more_than: int = 5, y="y_true", p="price") -> DataFrame:
    """Equal-width bins of the prediction; the largest prediction belongs to the last bin."""
    ends = df.agg(F.min(p).alias("lo"), F.max(p).alias("hi")).first()
    lo, hi = ends["lo"] or 0.0, ends["hi"] or 0.0
    width = (hi - lo) / bins or 1.0
    index = F.least(F.floor((col(p) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int") + 1
    return (
        df.groupBy(index.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.avg(p).alias("pred_mean"), F.avg(y).alias("actual_mean"))
        .where(F.col("n") > more_than)
        .withColumn("deviation", F.col("pred_mean") - F.col("actual_mean")))


def quantile_calibration(df: DataFrame, bins: int = 15, y="y_true", p="price") -> DataFrame:
    """Mean absolute gap between prediction and truth over quantile bins (left-closed)."""
    edges = quantiles(df, p, [i / bins for i in range(1, bins)])
    index = F.lit(0)
    for e in edges:
        index = index + flag(col(p) >= F.lit(e))
    return df.groupBy(index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("pred_mean"), F.avg(y).alias("actual_mean"))


def calibration_error(df: DataFrame, bins: int = 15, y="y_true", p="price") -> DataFrame:
    return quantile_calibration(df, bins, y, p).agg(
        F.avg(F.abs(F.col("pred_mean") - F.col("actual_mean"))).alias("calibration_error"),
        F.count(F.lit(1)).alias("n_bins"), F.sum("n").alias("n"))


def error_distribution(df: DataFrame, y="y_true", p="price") -> DataFrame:
    gap = F.abs(col(y) - col(p))
    pct = gap / F.greatest(col(y), F.lit(1e-10)) * 100.0
    q50, q90, q95 = quantiles(df, gap, [0.5, 0.9, 0.95])
    return df.agg(
        F.avg(gap).alias("mae"), F.stddev_pop(gap).alias("std_ae"), F.max(gap).alias("max_error"),
        F.avg(pct).alias("mean_pct_error"),
        *[(m.share(pct <= t) * 100.0).alias(f"pct_within_{t}pct") for t in (10, 20, 50)],
    ).withColumns({"median_ae": F.lit(q50), "p90": F.lit(q90), "p95": F.lit(q95),
                   "median_pct_error": medians(df, pct)})


RESIDUAL_QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def residual_diagnostics(df: DataFrame, y="y_true", p="price") -> DataFrame:
    """One row. The source is computed once: its residuals are kept until the last of the passes over them."""
    with kept(df.select((col(y) - col(p)).alias("e"))) as residuals:
        found = _residual_diagnostics(residuals)
        return df.sparkSession.createDataFrame(found.collect(), found.schema)


def _residual_diagnostics(df: DataFrame) -> DataFrame:
    e = F.col("e")
    cuts = dict(zip(RESIDUAL_QUANTILES, quantiles(df, e, list(RESIDUAL_QUANTILES.values()))))
    centre = df.agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std")).first()
    far = F.abs(e - F.lit(centre["mean"]))
    jb = m.jarque_bera(e)
    out = df.agg(
        F.count(e).alias("n"), F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("min"),
        F.max(e).alias("max"), m.skew_pop(e).alias("skewness"), m.kurt_pop(e).alias("kurtosis"),
        F.count_if(far > F.lit(3 * centre["std"])).alias("n_outliers_3sigma"),
        F.count_if(far > F.lit(4 * centre["std"])).alias("n_outliers_4sigma"),
        jb.alias("jarque_bera"), F.exp(-jb / 2.0).alias("normality_p"))
    out = out.withColumns({
        **{k: F.lit(v) for k, v in cuts.items()},
        "outlier_pct": F.col("n_outliers_3sigma") * 100.0 / F.col("n")})
    notes = F.concat_ws(
        "|", F.when(F.col("outlier_pct") > 5, "high_outlier_rate"),
        F.when(F.abs("mean") > 0.1 * F.col("std"), "systematic_bias"),
        F.when(F.abs("skewness") > 1, "heavy_skew"), F.when(F.col("kurtosis") > 3, "heavy_tails"),
        F.when(F.col("normality_p") <= 0.05, "non_normal"))
    return out.withColumn("recommendations", notes)


def durbin_watson(df: DataFrame, order: str | Sequence[str], residual, partitions: int | None = None) -> DataFrame:
    """Serial correlation of residuals in the order of one or more columns, which together are unique.

    Rows are sorted by ranges of the order. A task walks through its range in batches and gives one row; the
    steps between neighbouring ranges come from those. A column with a hot value needs a second one that tells
    its rows apart: then that value is split over ranges as well.
    """
    by = [order] if isinstance(order, str) else list(order)
    rows = df.select(*by, col(residual).cast("double").alias("_e"))
    rows = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)

    def walk(batches):
        n, steps, squares, first, last = 0, 0.0, 0.0, None, None
        for pdf in batches:
            e = pdf["_e"].to_numpy(dtype=float)
            if len(e):
                d = np.diff(e if n == 0 else np.concatenate([[last], e]))
                n, steps, squares = n + len(e), steps + float(np.nansum(d * d)), squares + float(np.nansum(e * e))
                first, last = e[0] if first is None else first, e[-1]
        if n:
            yield pd.DataFrame({"slice": [TaskContext.get().partitionId()], "n": [n], "steps": [steps], "squares": [squares],
                                "first": [first], "last": [last]})

    per_slice = rows.sortWithinPartitions(*by).select("_e").mapInPandas(
        walk, "slice int, n long, steps double, squares double, first double, last double")
    across = Window.partitionBy(F.lit(0)).orderBy("slice")  # one row per task
    jump = F.col("first") - F.lag("last").over(across)
    out = per_slice.withColumn("jump", jump).agg(
        (F.coalesce(F.sum("steps"), F.lit(0.0)) + F.coalesce(F.sum(F.col("jump") * F.col("jump")), F.lit(0.0))).alias("steps"),
        F.sum("squares").alias("squares"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    stat = F.when(F.col("squares") > 1e-10, F.try_divide(F.col("steps"), F.col("squares")))
    return out.select("n", stat.alias("durbin_watson")).withColumn(
        "autocorrelated", F.abs(F.col("durbin_watson") - 2.0) > 0.5)


def paired_t(df: DataFrame, a="ml_pred", b="hybrid_pred", y="y_true") -> DataFrame:
    """Paired t statistics of profit and of absolute error, with the normal p-value of large samples."""
    profit = policy_economics(y, a)["net_profit"] - policy_economics(y, b)["net_profit"]
    error = F.abs(col(a) - col(y)) - F.abs(col(b) - col(y))

    def t(diff: Column) -> Column:
        return F.try_divide(F.avg(diff), F.stddev_samp(diff) / F.sqrt(F.count(diff).cast("double")))

    out = df.agg(F.count(col(y)).alias("n"), t(profit).alias("t_profit"), t(error).alias("t_error"))
    return out.select("*", *[
        (F.abs(F.col(c)) > 1.959963984540054).alias(f"significant_{c[2:]}") for c in ("t_profit", "t_error")])


def profit_distribution(df: DataFrame, y="y_true", p="price") -> DataFrame:
    row = policy_economics(y, p)
    q25, q50, q75 = quantiles(df, row["net_profit"], [0.25, 0.5, 0.75])
    return df.agg(
        F.count_if(row["churn_probability"] > 0.5).alias("high_churn_policies"),
        F.count_if(row["error_share"] < -0.5).alias("severe_underpricing"),
        F.sum(row["churn_cost"]).alias("churn_losses"), F.sum(row["underpricing_penalty"]).alias("underpricing_penalties"),
        F.sum(row["accuracy_bonus"]).alias("accuracy_bonuses"),
    ).withColumns({"profit_q25": F.lit(q25), "profit_q50": F.lit(q50), "profit_q75": F.lit(q75)})


def high_value_segment(df: DataFrame, prob: float = 0.75, baseline: str | None = "ml_pred", y="y_true", p="hybrid_pred") -> DataFrame:
    cut = quantiles(df, y, [prob])[0]
    total = df.count()
    high = df.where(col(y) >= F.lit(cut))
    out = high.agg(
        F.count(col(y)).alias("n"), m.rmse(y, p).alias("rmse"), m.mae(y, p).alias("mae"), m.r2(y, p).alias("r2"),
        (F.avg(F.abs(col(y) - col(p)) / F.greatest(col(y), F.lit(1e-10))) * 100.0).alias("mape"),
        *([m.rmse(y, baseline).alias("baseline_rmse")] if baseline else []))
    out = out.withColumns({"threshold": F.lit(cut), "pct_samples": F.col("n") * 100.0 / F.lit(total)})
    if baseline:
        out = out.withColumn(
            "improvement_pct", F.try_divide(F.col("baseline_rmse") - F.col("rmse"), F.col("baseline_rmse")) * 100.0)
    return out


def sweep_configs() -> list[dict]:
    """The blend settings that are compared with each other."""
    base = dict(threshold=5000.0, ratio=0.75, soft=True, window=1000.0, factor=1.0, ml_only=True)
    rows = [dict(base, name=f"Threshold_{t}", threshold=float(t))
            for t in (3500, 5000, 7000, 9000, 11000, 13000, 15000)]
    rows += [dict(base, name=f"BlendRatio_{r}", ratio=r / 100) for r in (30, 40, 50, 60, 70, 75, 90)]
    rows += [dict(base, name="HardBlending", soft=False)]
    rows += [dict(base, name=f"SoftWindow_{w}", window=float(w)) for w in (250, 500, 750, 1000, 1500)]
    rows += [dict(base, name=f"Calibration_{f}", factor=f / 100) for f in (102, 105, 108, 110, 115, 120)]
    rows += [dict(base, name="CalStrategy_MLOnly"), dict(base, name="CalStrategy_FullHybrid", ml_only=False)]
    return [dict(r, position=i + 1) for i, r in enumerate(rows)]


def config_sweep(df: DataFrame, configs: list[dict] | None = None, y="y_true", ml="ml_pred", act="act_pred",
                 overpricing: bool = False) -> DataFrame:
    """Every setting priced over the whole portfolio in one scan.

    Each row is expanded by the literal list of settings inside its task and
    aggregated there, so only one row per setting and task is shuffled.
    """
    configs = configs or sweep_configs()
    grid = F.array(*[
        F.struct(*[F.lit(c[k]).alias(k) for k in
                   ("position", "name", "threshold", "ratio", "soft", "window", "factor", "ml_only")])
        for c in [dict(position=0, name="ML_Baseline", threshold=0.0, ratio=1.0, soft=False, window=1.0,
                       factor=1.0, ml_only=True), *configs]])
    rows = df.select(col(y).alias("y_true"), col(ml).alias("ml"), col(act).alias("act"), F.inline(grid))
    learned = F.when(F.col("ml_only"), F.col("ml") * F.col("factor")).otherwise(F.col("ml"))
    p = dict(threshold=F.col("threshold"), ml_ratio=F.col("ratio"))
    soft = blend(learned, "act", window=F.col("window"), **p).final
    hard = blend(learned, "act", window=None, **p).final
    mixed = F.when(F.col("position") == 0, F.col("ml")).when(F.col("soft"), soft).otherwise(hard)
    price = F.when(F.col("ml_only"), mixed).otherwise(mixed * F.col("factor"))
    money = m.portfolio(only=("total_net_profit", "profit_per_policy", "churn_rate_pct", "business_score",
                              "expected_churned", "total_underpricing_penalty"))
    return rows.withColumn("price", price).groupBy("position", "name").agg(
        m.mape("y_true", "price").alias("mape"), m.smape("y_true", "price").alias("smape"),
        m.rmse("y_true", "price").alias("rmse"), m.mae("y_true", "price").alias("mae"),
        m.r2("y_true", "price").alias("r2"), *m.named(money),
        *([m.share(F.col("price") > F.col("y_true")).alias("overpricing_rate")] if overpricing else []))


def marked_best(sweep: DataFrame) -> DataFrame:
    """Flags the best setting by business score and by RMSE; ties go to the earlier one."""
    everything = Window.partitionBy(F.lit(0))  # one row per setting
    by_score = F.max_by("name", F.struct(F.round("business_score", 6), -F.col("position"))).over(everything)
    by_rmse = F.min_by("name", F.struct(F.round("rmse", 6), F.col("position"))).over(everything)
    return sweep.select("*", (F.col("name") == by_score).alias("best_business"),
                        (F.col("name") == by_rmse).alias("best_rmse"))


def decision(df: DataFrame, y="y_true", ml="ml_pred", hybrid="hybrid_pred", aggressive: bool = False) -> DataFrame:
    """Five wins of the blended over the learned premium, and the verdict."""
    keys = ("total_net_profit", "churn_rate_pct", "business_score", "total_underpricing_penalty", "profit_per_policy")
    a, b = m.portfolio(y, ml, only=keys), m.portfolio(y, hybrid, only=keys)

    def severe(p):
        return F.count_if(policy_economics(y, p)["error_share"] < -0.5)

    one = df.agg(
        *[a[k].alias(f"ml_{k}") for k in keys], *[b[k].alias(f"hybrid_{k}") for k in keys],
        severe(ml).alias("ml_severe"), severe(hybrid).alias("hybrid_severe"),
        m.rmse(y, ml).alias("ml_rmse"), m.rmse(y, hybrid).alias("hybrid_rmse"),
        m.male(y, ml).alias("ml_male"), m.male(y, hybrid).alias("hybrid_male"))
    c = F.col
    one = one.withColumns({
        "win_profit": c("hybrid_total_net_profit") > c("ml_total_net_profit"),
        "win_churn": c("hybrid_churn_rate_pct") < c("ml_churn_rate_pct"),
        "win_score": c("hybrid_business_score") > c("ml_business_score"),
        "win_tail": c("hybrid_severe") <= c("ml_severe"),
        "win_penalty": c("hybrid_total_underpricing_penalty") < c("ml_total_underpricing_penalty"),
    })
    wins = sum((flag(c(w)) for w in ("win_profit", "win_churn", "win_score", "win_tail", "win_penalty")), F.lit(0))
    one = one.withColumns({
        "wins": wins, "confidence": wins / 5.0,
        "profit_improvement_pct": F.coalesce(F.try_divide(
            c("hybrid_profit_per_policy") - c("ml_profit_per_policy"), F.abs("ml_profit_per_policy")) * 100.0, F.lit(0.0)),
        "risk_reduction": F.when(c("ml_total_underpricing_penalty") > 0, 1.0 - F.try_divide(
            c("hybrid_total_underpricing_penalty"), c("ml_total_underpricing_penalty"))).otherwise(0.0),
    })
    level = F.when(c("confidence") >= 0.8, "HIGH").when(c("confidence") >= 0.6, "MODERATE").otherwise("LOW")
    accurate = (c("hybrid_rmse") < c("ml_rmse")) & (c("hybrid_male") < c("ml_male"))
    verdict = (
        F.when(~c("win_score"), "KEEP_ML_ONLY")
        .when(F.lit(aggressive) & (c("confidence") < 0.6), "BLOCKED")
        .when((c("confidence") >= 0.8) & accurate, "STRONGLY_DEPLOY")
        .when(c("confidence") >= 0.8, "DEPLOY")
        .when(c("confidence") >= 0.6, "CONDITIONAL_DEPLOY")
        .otherwise("DO_NOT_DEPLOY"))
    return one.select(
        "win_profit", "win_churn", "win_score", "win_tail", "win_penalty", "wins", "confidence",
        "profit_improvement_pct", "risk_reduction", level.alias("level"), verdict.alias("verdict"))


def model_comparison(df: DataFrame, a="ml_pred", b="hybrid_pred", y="y_true") -> DataFrame:
    """Improvement of b over a in percent."""
    one = df.agg(*[
        fn(y, p).alias(f"{name}_{side}") for name, fn in (("rmse", m.rmse), ("r2", m.r2), ("mae", m.mae))
        for side, p in (("a", a), ("b", b))])
    c = F.col

    def gain(name, sign):
        return F.coalesce(F.try_divide(sign * (c(f"{name}_a") - c(f"{name}_b")), F.abs(f"{name}_a")) * 100.0, F.lit(0.0))

    out = one.withColumns({
        "rmse_improvement_pct": gain("rmse", 1), "r2_improvement_pct": gain("r2", -1), "mae_improvement_pct": gain("mae", 1)})
    return out.withColumn("is_better", (c("rmse_improvement_pct") > 0) & (c("r2_improvement_pct") >= 0))


def generalisation(splits: DataFrame, y="y_true", p="price", split="split") -> DataFrame:
    """RMSE of train, val and test and the labelled gaps between them."""
    e = col(p) - col(y)

    def of(name):
        return F.sqrt(F.avg(F.when(F.col(split) == name, e * e))).alias(f"{name}_rmse")

    one = splits.agg(of("train"), of("val"), of("test"))
    c = F.col
    gap = F.coalesce(F.try_divide(c("val_rmse") - c("train_rmse"), c("train_rmse")) * 100.0, F.lit(0.0))
    drop = F.coalesce(F.try_divide(c("test_rmse") - c("val_rmse"), c("val_rmse")) * 100.0, F.lit(0.0))
    one = one.withColumns({"train_val_gap_pct": gap, "val_test_gap_pct": drop})
    g, t = c("train_val_gap_pct"), F.abs("val_test_gap_pct")
    return one.withColumns({
        "train_val_status": F.when(g < 10, "minimal").when(g < 20, "moderate").otherwise("severe"),
        "val_test_status": F.when(t < 5, "excellent").when(t < 10, "good").when(t < 15, "moderate").otherwise("poor")})


def overfit_penalty(train: Column, val: Column, critical: float = 20.0, warning: float = 10.0, multiplier: float = 1.5):
    """(penalised score, gap in percent, status)."""
    gap = F.when(train > 1e-10, F.try_divide(val - train, train) * 100.0).otherwise(0.0)
    status = F.when(train <= 1e-10, "no_penalty").when(gap > critical, "critical").when(gap > warning, "warning").otherwise("good")
    factor = F.when(gap > critical, multiplier).when(gap > warning, 1.0 + (multiplier - 1.0) * 0.5).otherwise(1.0)
    return val * factor, gap, status


def pinball(y, p, alpha: float) -> Column:
    e = col(y) - col(p)
    return F.when(e >= 0, e * F.lit(alpha)).otherwise(e * F.lit(alpha - 1.0))


def search_scores(df: DataFrame, alpha: float = 0.65, y="y_true", p="price",
                  mix: Sequence[float] = (0.70, 0.15, 0.15)) -> DataFrame:
    """Losses that a model search minimises: plain, high-value weighted, segment balanced, and their mix."""
    q25, q50, q75, q90 = quantiles(df, y, [0.25, 0.5, 0.75, 0.9])
    w = F.when(col(y) > q90, 1.5 * 1.8).when(col(y) > q75, 1.5).otherwise(1.0)
    quarter = F.when(col(y) <= q25, 0).when(col(y) <= q50, 1).when(col(y) <= q75, 2).otherwise(3)
    e = col(p) - col(y)
    loss = pinball(y, p, alpha)
    per_quarter = df.groupBy(quarter.alias("quarter")).agg(
        F.count(col(y)).alias("n"), F.sum(loss).alias("loss"), F.sum(loss * w).alias("wloss"), F.sum(w).alias("w"),
        F.sum(e * e).alias("sq"), F.sum(e * e * w).alias("wsq"))
    return per_quarter.agg(
        (F.sum("loss") / F.sum("n")).alias("pinball"), (F.sum("wloss") / F.sum("w")).alias("weighted_pinball"),
        F.avg(F.col("loss") / F.col("n")).alias("balanced_pinball"),
        F.sqrt(F.sum("sq") / F.sum("n")).alias("rmse"), F.sqrt(F.sum("wsq") / F.sum("w")).alias("weighted_rmse"),
        F.avg(F.sqrt(F.col("sq") / F.col("n"))).alias("balanced_rmse"),
    ).withColumn("hybrid_score", F.lit(mix[0]) * F.col("pinball") + F.lit(mix[1]) * F.col("weighted_pinball")
                 + F.lit(mix[2]) * F.col("rmse"))


def merged_batches(batches: DataFrame, size: str, means: Sequence[str]) -> DataFrame:
    """One summary of many batch summaries; means are weighted by batch size."""
    n = F.sum(size)
    return batches.agg(
        n.alias("n"), F.count(F.lit(1)).alias("n_batches"),
        *[F.try_divide(F.sum(F.col(c) * F.col(size)), n).alias(c) for c in means])


def range_screen(df: DataFrame, stored_max: Sequence[float | None] = (), y="y_true", ml="ml_pred", hybrid="hybrid_pred",
                 act="act_pred") -> DataFrame:
    """Predictions far above anything seen in training, and drift of the mean."""
    usable = next((v for v in stored_max if v is not None and 0 < v < 2_000_000), None)
    top = usable if usable is not None else df.agg(F.max(y)).first()[0]
    return df.agg(
        F.lit(top).alias("reference_max"), F.count_if(col(hybrid) > F.lit(top * 1.5)).alias("n_out_of_range"),
        F.max(hybrid).alias("max_hybrid"), F.avg(ml).alias("mean_ml"), F.avg(hybrid).alias("mean_hybrid"),
        F.avg(act).alias("mean_actuarial"),
    ).withColumn("ratio", F.coalesce(F.try_divide(F.col("mean_hybrid"), F.col("mean_ml")), F.lit(0.0))).withColumn(
        "divergent", F.col("ratio") > 1.4)


def sample_report(df: DataFrame, n: int = 5, seed: int = 42, key="policy_id", y="y_true", p="price") -> DataFrame:
    """A reproducible sample of predictions: the n smallest row hashes."""
    return (
        df.select(key, col(y).alias("actual"), col(p).alias("predicted"), hash_key(key, seed).alias("h"))
        .orderBy("h", key).limit(n).drop("h")
        .withColumn("error", F.col("actual") - F.col("predicted"))
        .withColumn("error_pct", F.try_divide(F.col("error"), F.col("actual"))))
