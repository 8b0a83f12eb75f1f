"""Learned and fitted models: Spark ML estimators, calibrators and table models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.config import AGE_EDGES, AGE_LABELS, BMI_EDGES, BMI_LABELS
from ratebook.functions import moments as m
from ratebook.functions.columns import band, col, lookup
from ratebook.operators.quantiles import grouped_quantiles, kept


@dataclass(frozen=True)
class QuantileTable:
    """Conditional quantile of the charge per (age group, bmi category, smoker).

    A cell with few rows backs off to (age group, smoker), then to smoker alone. There
    are at most 50 cells, so the fitted table is a literal lookup inside the scan stage.
    """

    alpha: float
    cells: dict
    groups: dict
    smokers: dict

    @classmethod
    def fit(cls, df: DataFrame, alpha: float = 0.30, target="charges", at_least: int = 20) -> "QuantileTable":
        rows = cls._placed(df).select("age_group", "bmi_category", "smoker", col(target).alias("target"))

        def table(*by):
            found = grouped_quantiles(rows, "target", [alpha], by)
            return {k: v[0] for k, (n, v) in found.items() if n >= at_least or by == ("smoker",)}

        with kept(rows):
            return cls(alpha, table("age_group", "bmi_category", "smoker"), table("age_group", "smoker"), table("smoker"))

    @staticmethod
    def _placed(df: DataFrame) -> DataFrame:
        return df.withColumns({"bmi_category": band("bmi", BMI_EDGES, BMI_LABELS), "age_group": band("age", AGE_EDGES, AGE_LABELS)})

    def transform(self, df: DataFrame) -> DataFrame:
        fine = lookup(["age_group", "bmi_category", "smoker"], self.cells).cast("double")
        middle = lookup(["age_group", "smoker"], self.groups).cast("double")
        coarse = lookup(["smoker"], self.smokers).cast("double")
        level = F.when(fine.isNotNull(), 3).when(middle.isNotNull(), 2).otherwise(1)
        return self._placed(df).withColumns({"risk_premium": F.coalesce(fine, middle, coarse), "level": level})


@dataclass(frozen=True)
class LinearCalibrator:
    """y = slope * prediction + intercept; the slope stays within [0, 2]."""

    slope: float
    intercept: float
    n: int
    prediction: str

    @classmethod
    def fit(cls, df: DataFrame, prediction: str, target="y_true", at_least: int = 50) -> "LinearCalibrator":
        row = df.agg(
            F.regr_slope(col(target), col(prediction)).alias("a"), F.regr_intercept(col(target), col(prediction)).alias("b"),
            F.count(F.when(col(target).isNotNull() & col(prediction).isNotNull(), 1)).alias("n")).first()
        if row["n"] < at_least:
            raise ValueError(f"a calibrator needs {at_least} rows, got {row['n']}")
        if row["a"] is None:
            return cls(1.0, 0.0, row["n"], prediction)
        return cls(min(max(row["a"], 0.0), 2.0), row["b"], row["n"], prediction)

    def transform(self, df: DataFrame, output: str) -> DataFrame:
        return df.withColumn(output, F.lit(self.slope) * col(self.prediction) + F.lit(self.intercept))


def adoption(df: DataFrame, before: str, after: str, y="y_true") -> DataFrame:
    """Whether a calibrated prediction is clearly better than the plain one on a holdout."""
    one = df.agg(*[
        fn(y, p).alias(f"{name}_{side}") for name, fn in (("rmse", m.rmse), ("r2", m.r2), ("mae", m.mae))
        for side, p in (("before", before), ("after", after))])
    c = F.col
    one = one.withColumns({
        "rmse_gain": c("rmse_after") < c("rmse_before") * 0.99, "r2_kept": c("r2_after") >= c("r2_before"),
        "mae_kept": c("mae_after") <= c("mae_before") * 1.02})
    return one.withColumn("adopt", c("rmse_gain") & c("r2_kept") & c("mae_kept"))
