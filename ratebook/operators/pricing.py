"""Pricing reports, guards, routing and bias factors over whole portfolios."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratebook.config import HIGH_VALUE, Blend
from ratebook.functions import pricing as price
from ratebook.functions.columns import band, clip, col, lookup
from ratebook.operators.quantiles import exact_quantiles, median, quantiles


def blended(df: DataFrame, rule: Blend | None = None, ml="ml_pred", act="act_pred") -> DataFrame:
    b = price.blend(ml, act, rule)
    return df.select("*", b.zone.alias("zone"), b.weight.alias("weight"), b.final.alias("blended"))


def blend_diagnostics(df: DataFrame, rule: Blend | None = None) -> DataFrame:
    rows = blended(df, rule)
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("zone") == "ml_only").alias("ml_only"),
        F.count_if(F.col("zone") == "actuarial_dominant").alias("actuarial_dominant"),
        F.count_if(F.col("zone") == "transition").alias("transition"), F.avg("weight").alias("avg_weight"))


def ratio_alert(df: DataFrame, act="act_pred", ml="ml_pred", high: float = 1.15, low: float = 0.70) -> DataFrame:
    """Median actuarial to learned ratio over the whole portfolio."""
    value = median(df, col(act) / F.greatest(col(ml), F.lit(1e-8)))
    ratio = F.lit(value)
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        "n", ratio.alias("median_ratio"),
        F.when(ratio > high, "conservative").when(ratio < low, "aggressive").otherwise("normal").alias("verdict"))


def correction_guard(df: DataFrame, final="hybrid_pred", ml="ml_pred", low: float = 0.65, high: float = 1.45) -> DataFrame:
    value = median(df, col(final) / F.greatest(col(ml), F.lit(1e-8)))
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.lit(value).alias("net_factor"), F.lit(value).between(low, high).alias("within_range"))


def tail_risk(df: DataFrame, final="hybrid_pred", ml="ml_pred", severe: float = 0.50) -> DataFrame:
    """Premiums below the floor set by the learned premium; always over all rows at once."""
    floor = col(ml) * F.lit(1.0 - severe)
    low = col(final) < floor
    gap = F.avg(F.when(low, (floor - col(final)) / F.greatest(floor, F.lit(1e-8))))
    n, hit = F.count(F.lit(1)), F.count_if(low)
    share = F.try_divide(hit * 100.0, n)
    return df.agg(
        n.alias("n"), hit.alias("below_floor"), share.alias("below_floor_pct"), gap.alias("mean_gap"),
        F.when(hit == 0, "NONE").when(share > 10, "CRITICAL").when(share > 5, "HIGH").otherwise("MODERATE").alias("severity"))


def routed(df: DataFrame, base="ml_pred", specialist="very_high", threshold: float = HIGH_VALUE) -> DataFrame:
    w = price.router_weight(base, threshold)
    route = F.when(w <= 0, "base").when(w >= 1, "specialist").otherwise("mixed")
    return df.select("*", route.alias("route"), price.mix(base, specialist, w).alias("routed"))


def route_counts(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(
        n.alias("n"), *[F.count_if(F.col("route") == r).alias(f"n_{r}") for r in ("base", "mixed", "specialist")],
        F.try_divide(F.count_if(F.col("route") == "specialist") * 100.0, n).alias("pct_specialist"),
        F.try_divide(F.count_if(F.col("route") == "mixed") * 100.0, n).alias("pct_mixed"))


def specialist_blend(base, specialist, low: float = HIGH_VALUE, high: float = HIGH_VALUE + 5000.0) -> Column:
    w = clip((col(base) - F.lit(low)) / F.lit(high - low), 0.0, 1.0)
    return (F.lit(1.0) - w) * col(base) + w * col(specialist)


# The tiers of the specialists.
SPECIALIST_TIERS = (("low", 0.0, 5000.0), ("mid", 5000.0, 10000.0), ("high_mid", 10000.0, HIGH_VALUE),
                    ("very_high", HIGH_VALUE, float("inf")))


def tier_routed(base="ml_pred", width: float = 500.0, tiers=SPECIALIST_TIERS) -> Column:
    """Each tier takes its specialist, with linear edges; a later tier overrides an earlier one."""
    x, half = col(base), width / 2
    out = x
    for name, lo, hi in tiers:
        special = col(name)
        rise = clip((x - F.lit(lo - half)) / F.lit(half), 0.0, 1.0)
        choice = F.when((x >= lo) & (x < hi if hi != float("inf") else F.lit(True)), special).when(
            (x >= lo - half) & (x < lo), (F.lit(1.0) - rise) * x + rise * special)
        if hi != float("inf"):
            fall = clip(F.lit(1.0) - (x - F.lit(hi)) / F.lit(half), 0.0, 1.0)
            choice = choice.when((x >= hi) & (x < hi + half), (F.lit(1.0) - fall) * x + fall * special)
        out = choice.otherwise(out)
    return out


def fit_variance_bias(df: DataFrame, threshold: float | None = None, y="y_true", p="price") -> dict:
    """Sample variance of log residuals below and above a threshold (default: the median)."""
    cut = threshold if threshold is not None else median(df, y)
    tiny = F.lit(1e-6)
    residual = F.log1p(F.greatest(col(y), tiny)) - F.log1p(F.greatest(col(p), tiny))
    low = col(y) < F.lit(cut)
    row = df.agg(
        F.var_samp(residual).alias("all"), F.var_samp(F.when(low, residual)).alias("low"),
        F.var_samp(F.when(~low, residual)).alias("high"), F.count_if(low).alias("n_low"),
        F.count_if(~low).alias("n_high")).first()
    return {
        "var_low": row["low"] if row["n_low"] > 1 else row["all"],
        "var_high": row["high"] if row["n_high"] > 1 else row["all"],
        "threshold": cut, "n_low": row["n_low"], "n_high": row["n_high"], "var_all": row["all"]}


# Fixed values of the ratio form.
UNCORRECTED = 1e-6
RATIO_CAP = 1.30
RATIO_FLOOR = 0.90
OVERPRICED_FROM = 0.45
TRUE_TIER_ROWS = 30
TIER_ROWS = 10


def fit_ratio_bias(df: DataFrame, low: float = 10000.0, high: float = 14000.0, y="y_true", p="price") -> list[dict]:
    """Median true-to-predicted ratio per prediction tier, as the variance e^(v/2) undoes.

    One aggregate counts every tier; one ranked pass finds the medians of the tiers
    that need a correction.
    """

    def tiers(edges: Sequence[float], labels: Sequence[str]):
        lower = dict(zip(labels, (float("-inf"), *edges)))
        upper = dict(zip(labels, (*edges, float("inf"))))
        return df.select(
            band(p, (float("-inf"), *edges, float("inf")), labels).alias("tier"),
            (col(y) / F.greatest(col(p), F.lit(1e-8))).alias("ratio"), (col(p) > col(y)).alias("over"),
            col(y).alias("y")).withColumn("own", own_of(lower, upper))

    def own_of(lower, upper):
        """The true charge lies in the same tier; only tiers with an upper bound ask for it."""
        test = F.lit(False)
        for name in lower:
            if upper[name] != float("inf"):
                inside = F.col("y") <= upper[name]
                if lower[name] != float("-inf"):
                    inside = inside & (F.col("y") > lower[name])
                test = test | ((F.col("tier") == name) & inside)
        return test

    def counted(rows):
        return {r["tier"]: r for r in rows.groupBy("tier").agg(
            F.count("tier").alias("n"), F.avg(F.col("over").cast("double")).alias("over"),
            F.count_if("own").alias("n_own")).collect() if r["tier"] is not None}

    labels = ("low", "mid", "high")
    rows = tiers((low, high), labels)
    found = counted(rows)
    if any(found[t]["n"] < TIER_ROWS if t in found else True for t in labels):
        labels = ("low", "high")
        rows = tiers((high,), labels)
        found = counted(rows)
    needy = {t: r["n_own"] >= TRUE_TIER_ROWS for t, r in found.items() if r["over"] >= OVERPRICED_FROM}
    use = F.lit(False)
    for t, only_own in needy.items():
        test = F.col("tier") == t
        use = use | ((test & F.col("own")) if only_own else test)
    ratios = exact_quantiles(rows, F.when(use, F.col("ratio")), [0.5], by=["tier"]) if needy else {}
    out = []
    for t in labels:
        r = found.get(t)
        ratio = ratios.get((t,), [None])[0]
        variance = UNCORRECTED
        if ratio is not None and ratio > 0:
            variance = max(2 * math.log(min(ratio, RATIO_CAP)), 2 * math.log(RATIO_FLOOR))
        out.append({
            "tier": t, "n": r["n"] if r else 0, "overpricing": r["over"] if r else None,
            "n_own": r["n_own"] if r else 0, "ratio": ratio, "variance": variance, "factor": math.exp(variance / 2)})
    return out


def prediction_statistics(df: DataFrame, p="hybrid_pred") -> DataFrame:
    q25, q50, q75 = quantiles(df, p, [0.25, 0.5, 0.75])
    n, x = F.count(col(p)), col(p)
    bands_ = {"low": x < 5000, "mid": (x >= 5000) & (x < 15000), "high": x >= 15000}
    out = df.agg(
        n.alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("std"),
        F.try_divide(F.stddev_pop(x), F.avg(x)).alias("cv"),
        *[F.count_if(t).alias(f"n_{k}") for k, t in bands_.items()],
        *[F.try_divide(F.count_if(t) * 100.0, n).alias(f"pct_{k}") for k, t in bands_.items()])
    return out.withColumns({"q25": F.lit(q25), "median": F.lit(q50), "q75": F.lit(q75), "iqr": F.lit(q75) - F.lit(q25)})


def reliability(df: DataFrame, p="hybrid_pred", extreme: float = 100_000.0) -> DataFrame:
    return df.agg(F.count_if(col(p) > extreme).alias("extreme_count"), F.max(p).alias("max_prediction"),
                  (F.max(p) > extreme).alias("has_extreme"))


def clipped(df: DataFrame, p="price") -> DataFrame:
    """Negative premiums become zero; a flag marks them."""
    return df.withColumns({"was_negative": col(p) < 0, p: F.greatest(col(p), F.lit(0.0))})


# Grids of the sensitivity sweeps.
SWEEP_GRIDS = {
    "age": (18, 21, 26, 30, 40, 50, 55, 60, 65, 70, 75, 80),
    "bmi": (15.0, 17.0, 18.5, 22.0, 25.0, 27.5, 30.0, 35.0, 40.0, 45.0, 50.0, 55.0),
    "children": (0, 1, 2, 3, 4, 5, 6, 7, 10),
}


def sweep(df: DataFrame, field: str, grid: Sequence | None = None, key: str = "policy_id", by_smoker: bool = False) -> DataFrame:
    """Actuarial premium of every policy along a grid of one field.

    The grid is a literal array exploded next to each row: no join and no shuffle.
    """
    values = grid or SWEEP_GRIDS[field]
    smokers = F.array(F.lit("no"), F.lit("yes")) if by_smoker else F.array(F.col("smoker"))
    rows = df.select(
        "*", price.actuarial_premium().alias("base_premium"),
        F.explode(F.array(*[F.lit(v).cast("double") for v in values])).alias("grid_value"))
    rows = rows.select(
        key, "grid_value", "base_premium", *[
            (F.col("grid_value") if c == field else F.col(c)).alias(c) for c in ("age", "bmi", "children", "region")],
        F.explode(smokers).alias("smoker"))
    return rows.select(
        key, "grid_value", "smoker", "base_premium", price.actuarial_premium().alias("premium")).withColumn(
        "change_pct", F.try_divide(F.col("premium") - F.col("base_premium"), F.col("base_premium")) * 100.0)


def sweep_curve(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("premium").alias("mean_premium"), F.min("premium").alias("min_premium"),
        F.max("premium").alias("max_premium"), F.avg("change_pct").alias("mean_change_pct"))


def last_scenarios(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The newest n rows of every group. The rank filter lets Spark keep n rows per group and
    task before the shuffle, so a hot group does not travel."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return df.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def level_histogram(df: DataFrame, levels: Sequence[str], level="risk_level") -> DataFrame:
    spark = df.sparkSession
    names = spark.createDataFrame([(i, x) for i, x in enumerate(levels)], f"position int, {level} string")
    counts = df.groupBy(level).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, level, "left").select("position", level, F.coalesce("n", F.lit(0)).alias("n"))
