"""Conformal and heuristic prediction intervals, and their checks."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratebook.config import Z_VALUES
from ratebook.functions.columns import clip, col
from ratebook.operators.quantiles import interpolated, kept, median, order_statistics, planned_order_statistics, quantile_ranks
from ratebook.operators.transforms import TargetTransform


def conformal_rank(n: int, alpha: float, level_of: int | None = None) -> int:
    """1-based rank of the conformal quantile: the next higher order statistic at the
    level min(1, ceil((m+1)(1-alpha))/m). The level may come from another sample size m."""
    m = level_of or n
    level = min(1.0, math.ceil((m + 1) * (1 - alpha)) / m)
    return min(math.ceil((n - 1) * level) + 1, n)


def conformal_half_width(df: DataFrame, residual, alpha: float = 0.10, at_least: int = 30) -> tuple[int, float | None]:
    """(calibration rows, absolute residual at the conformal rank); no width below 30 rows."""
    found = order_statistics(df, F.abs(col(residual)), lambda n: [conformal_rank(n, alpha)])
    n, values = found.get((), (0, {}))
    return (n, values[conformal_rank(n, alpha)]) if n >= at_least else (n, None)


@dataclass(frozen=True)
class ConformalBins:
    """Width per prediction bin, with separate factors above and below."""

    edges: tuple
    widths: tuple
    cap: float
    overall: float
    up: float
    down: float
    n: int
    alpha: float

    @classmethod
    def fit(cls, df: DataFrame, prediction: str, residual: str, alpha: float = 0.10, bins: int = 10,
            rows_per_bin: int = 30, winsor: float = 0.95) -> "ConformalBins | None":
        with kept(df.select(prediction, residual)) as narrow:
            return cls._fit(narrow, prediction, residual, alpha, bins, rows_per_bin, winsor)

    @classmethod
    def _fit(cls, df, prediction, residual, alpha, bins, rows_per_bin, winsor) -> "ConformalBins | None":
        size = F.abs(col(residual)).cast("double")
        side = F.when(col(residual) > 0, "up").when(col(residual) < 0, "down")
        parts = {"all": (F.lit("all"), size), "side": (side, size), "prediction": (F.lit("prediction"), col(prediction).cast("double"))}
        melted = df.select(F.inline(F.array(*(F.struct(k.alias("part"), v.alias("value")) for k, v in parts.values()))))
        cut_at = []

        def plan(sizes):
            n = sizes.get(("all",), 0)
            if n < 50:
                return {}
            count = max(1, min(bins, n // rows_per_bin))
            cut_at.extend(i / count for i in range(1, count + 1))
            return {("all",): [conformal_rank(n, alpha), *quantile_ranks(n, [winsor])],
                    ("prediction",): quantile_ranks(sizes.get(("prediction",), 0), cut_at),
                    **{(s,): [conformal_rank(sizes[s,], alpha, n)] for s in ("up", "down") if (s,) in sizes}}

        ranked = planned_order_statistics(melted, "value", plan, by=["part"])
        n, values = ranked.get(("all",), (0, {}))
        if not cut_at or ("prediction",) not in ranked:
            return None
        width, cap = float(values[conformal_rank(n, alpha)]), interpolated(n, values, winsor)

        def ratio(side):
            k, values = ranked.get((side,), (0, {}))
            return float(values[conformal_rank(k, alpha, n)]) / width if k >= 10 and width > 0 else 1.0

        cuts = sorted({interpolated(*ranked["prediction",], p) for p in cut_at})
        index = cls._index(prediction, cuts)
        local = order_statistics(df.withColumn("bin", index), size, lambda k: [conformal_rank(k, alpha)], by=["bin"])
        widths = []
        for i in range(len(cuts)):
            k, found = local.get((i,), (0, {}))
            q = float(found[conformal_rank(k, alpha)]) if k >= 5 else width
            widths.append(min(q, cap))
        return cls(tuple(cuts), tuple(widths), cap, width, ratio("up"), ratio("down"), n, alpha)

    @staticmethod
    def _index(prediction, cuts) -> Column:
        x = col(prediction)
        out = None
        for i, edge in enumerate(cuts):
            test = x <= F.lit(edge)
            out = F.when(test, i) if out is None else out.when(test, i)
        return out.otherwise(len(cuts) - 1)

    def width(self, prediction) -> Column:
        """Right-closed bins; the last one also serves everything above it."""
        x = col(prediction)
        out = F.when(x <= F.lit(self.edges[0]), F.lit(self.widths[0]))
        for edge, w in zip(self.edges[1:], self.widths[1:]):
            out = out.when(x <= F.lit(edge), F.lit(w))
        return out.otherwise(F.lit(self.widths[-1]))

    def transform(self, df: DataFrame, prediction_z: str, final: str, shape: TargetTransform, top: float = 3.0) -> DataFrame:
        """Adds lower and upper around the final premium.

        Widths apply on the transformed scale. The bounds are inverted without clipping,
        limited to [0, top x safe maximum] and moved by the ratio of the final to the
        plain premium, itself held within [0.5, 2].
        """
        z, q = col(prediction_z), self.width(prediction_z)
        shift = clip(col(final) / F.greatest(shape.invert(z), F.lit(1e-8)), 0.5, 2.0)
        low = F.greatest(shape.invert(z - q * F.lit(self.down), safe=False), F.lit(0.0))
        high = F.least(shape.invert(z + q * F.lit(self.up), safe=False), F.lit(shape.safe_max * top))
        return df.withColumns({"lower": low * shift, "upper": high * shift})


@dataclass(frozen=True)
class ConformalBounds:
    """Two quantile bounds moved outwards (or inwards) until they cover what they promise on rows apart.

    A row's score is how far its target lies beyond the nearer bound, negative inside. The shift of both bounds is
    the score at the conformal rank; ``per_side`` takes one for each bound, at half the error each.
    """

    below: float
    above: float
    n: int
    alpha: float

    @classmethod
    def fit(cls, df: DataFrame, y, lower, upper, alpha: float = 0.10, per_side: bool = False, at_least: int = 30) -> "ConformalBounds":
        low, high = cls._ordered(lower, upper)
        scores = [low - col(y), col(y) - high] if per_side else [F.greatest(low - col(y), col(y) - high)]
        error = alpha / len(scores)
        shifts, n = [], 0
        for score in scores:
            n, found = order_statistics(df, score, lambda m: [conformal_rank(m, error)]).get((), (0, {}))
            if n < at_least:
                raise ValueError(f"conformal bounds need {at_least} rows, got {n}")
            shifts.append(float(found[conformal_rank(n, error)]))
        return cls(shifts[0], shifts[-1], n, alpha)

    @staticmethod
    def _ordered(lower, upper) -> tuple[Column, Column]:
        """Quantiles fitted one by one may cross."""
        return F.least(col(lower), col(upper)), F.greatest(col(lower), col(upper))

    def transform(self, df: DataFrame, lower: str, upper: str, floor: float | None = 0.0) -> DataFrame:
        """The bounds moved; where they would pass each other both are their middle."""
        low, high = self._ordered(lower, upper)
        low, high = low - F.lit(self.below), high + F.lit(self.above)
        middle = (low + high) / 2
        low, high = F.least(low, middle), F.greatest(high, middle)
        if floor is not None:
            low, high = F.greatest(low, F.lit(floor)), F.greatest(high, F.lit(floor))
        return df.withColumns({lower: low, upper: high})


def normal_quantile(level: float) -> float:
    return Z_VALUES.get(level) or NormalDist().inv_cdf((1 + level) / 2)


def gaussian_half_width(df: DataFrame, residual, level: float = 0.90) -> float:
    return normal_quantile(level) * df.agg(F.stddev_pop(col(residual)).alias("s")).first()["s"]


def heuristic(df: DataFrame, prediction: str, family: str, level: float = 0.90) -> DataFrame:
    """Intervals by model family when no calibration exists; the lower bound is never negative."""
    s = df.agg(F.avg(prediction).alias("mean"), F.max(prediction).alias("max"), F.stddev_pop(prediction).alias("std")).first()
    p = col(prediction)
    if family == "boosted":
        spread = p * F.lit(0.20 if s["mean"] < 50 and s["max"] < 20 else 0.15)
    elif family == "linear":
        spread = F.lit(s["std"] * 0.1)
    elif family == "residual":
        spread = p * F.lit(0.2)
    else:
        raise ValueError(f"unknown model family {family}")
    half = spread * F.lit(normal_quantile(level))
    return df.withColumns({"lower": F.greatest(p - half, F.lit(0.0)), "upper": p + half})


def coverage(df: DataFrame, y="y_true", lower="lower", upper="upper", nominal: float = 0.90) -> DataFrame:
    width = col(upper) - col(lower)
    inside = (col(y) >= col(lower)) & (col(y) <= col(upper))
    middle = median(df, width)
    out = df.agg(
        F.count(col(y)).alias("n"), F.count_if(inside).alias("n_covered"),
        F.avg(F.when(inside, 1.0).otherwise(0.0)).alias("empirical"), F.avg(width).alias("mean_width"))
    c = F.col("empirical")
    label = (
        F.when(c.between(nominal * 0.98, nominal * 1.02), "on_target")
        .when(c.between(nominal * 0.95, nominal * 1.05), "near_target")
        .when(c < nominal * 0.95, "under").otherwise("over"))
    return out.withColumns({
        "median_width": F.lit(middle), "gap": c - F.lit(nominal), "valid": c >= nominal - 0.02, "label": label})


def width_guardrail(df: DataFrame, prediction: str, lower="lower", upper="upper", target: float = 1.5, cap: float = 2.0) -> DataFrame:
    middle = median(df, prediction)
    out = df.agg(F.avg(col(upper) - col(lower)).alias("mean_width")).withColumn("median_prediction", F.lit(middle))
    ratio = F.when(F.col("median_prediction") > 0, F.try_divide(F.col("mean_width"), F.col("median_prediction")))
    out = out.withColumn("width_ratio", ratio)
    return out.withColumns({"passed": F.col("width_ratio") <= target, "within_cap": F.col("width_ratio") <= cap})


def rescaled(df: DataFrame, ml: str, final: str, lower="lower", upper="upper", unreliable: float = 80.0) -> DataFrame:
    """Bounds moved with the blended premium, their width in percent, and a warning flag."""
    ratio = F.when(col(ml) > 1e-8, col(final) / col(ml)).otherwise(1.0)
    out = df.withColumns({lower: col(lower) * ratio, upper: col(upper) * ratio})
    pct = F.when(col(final) > 1e-8, (col(upper) - col(lower)) / col(final) * 100.0)
    return out.withColumn("width_pct", pct).withColumn("unreliable", F.col("width_pct") > unreliable)


def student_quantile(p: float, dof: int) -> float:
    """Inverse Student t by bisection on its distribution (Simpson's rule after t = tan)."""
    if dof > 2000:
        z = NormalDist().inv_cdf(p)
        return z + (z**3 + z) / (4 * dof) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * dof**2)

    def mass(t: float) -> float:
        """Share between 0 and t: the integral of cos^(dof-1) up to atan(t / sqrt(dof))."""
        end, steps = math.atan(t / math.sqrt(dof)), 2000
        step = end / steps
        total = sum((1 if i in (0, steps) else 4 if i % 2 else 2) * math.cos(i * step) ** (dof - 1) for i in range(steps + 1))
        norm = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)
        return norm * total * step / 3

    low, high = 0.0, 1e4
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mass(mid) < p - 0.5 else (low, mid)
    return (low + high) / 2


def mean_interval(df: DataFrame, column, level: float = 0.95) -> DataFrame:
    """Student t interval of a mean."""
    s = df.agg(F.avg(col(column)).alias("mean"), F.stddev_samp(col(column)).alias("std"), F.count(col(column)).alias("n"))
    n = s.first()["n"]
    if n < 2:
        raise ValueError("an interval needs two rows")
    margin = F.lit(student_quantile((1 + level) / 2, n - 1)) * F.col("std") / F.sqrt(F.col("n").cast("double"))
    return s.select("n", "mean", (F.col("mean") - margin).alias("lower"), (F.col("mean") + margin).alias("upper"))
