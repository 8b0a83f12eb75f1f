"""Fitted transforms: each ``fit`` runs a few aggregates and returns an immutable
set of parameters; each ``transform`` is a lazy projection over literals."""

from __future__ import annotations

import math
from itertools import combinations
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.functions import targets
from ratebook.functions.columns import clip, col, lookup
from ratebook.operators.quantiles import column_quantiles, kept, quantiles
from ratebook.operators.sums import grams

NUMERIC_KINDS = ("int", "bigint", "double", "float", "smallint", "tinyint")
RAW_NUMERIC = ("age", "bmi", "children")
EXPRESSIONS_PER_PASS = 40


def numeric_columns(df: DataFrame, leave_out: Sequence[str] = ("policy_id", "charges")) -> list[str]:
    return [n for n, k in df.dtypes if k in NUMERIC_KINDS and n not in leave_out]


def text_columns(df: DataFrame) -> list[str]:
    return [n for n, k in df.dtypes if k == "string"]


def aggregate(df: DataFrame, columns: dict) -> dict:
    """Many aggregates with a bounded number of expressions per generated stage."""
    items = list(columns.items())
    out = {}
    for i in range(0, len(items), EXPRESSIONS_PER_PASS):
        part = items[i:i + EXPRESSIONS_PER_PASS]
        row = df.agg(*[c.alias(f"c{j}") for j, (_, c) in enumerate(part)]).first()
        out.update({name: row[f"c{j}"] for j, (name, _) in enumerate(part)})
    return out


#: Most classes that an encoder holds as literals; with more they stay a table (``encoders``).
MOST_CLASSES = 10_000


def _counted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def category_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    """Counts of the values of category columns, whose number the caller has bounded (``many_classes``)."""
    rows = _counted(df, columns).collect()
    out: dict[str, dict] = {c: {} for c in columns}
    for r in rows:
        out[r["feature"]][r["value"]] = r["n"]
    return out


def many_classes(df: DataFrame, columns: Sequence[str], most: int) -> bool:
    return _counted(df, columns).limit(most + 1).count() > most


def modes(df: DataFrame, columns: Sequence[str]) -> dict:
    """The commonest value of each column, the smallest one on a tie; columns of any number of values."""
    rows = _counted(df, columns).groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
    return {r["feature"]: r["value"] for r in rows.collect()}


def most_frequent(counts: dict):
    """The commonest value; the smallest one on a tie."""
    return min(counts, key=lambda v: (-counts[v], v)) if counts else None


@dataclass(frozen=True)
class Imputer:
    """Median for age, bmi and children, mean for derived numbers, mode for categories."""

    values: dict

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str] | None = None) -> "Imputer":
        numeric = [c for c in numeric_columns(df) if columns is None or c in columns]
        text = [c for c in text_columns(df) if columns is None or c in columns]
        raw = [c for c in numeric if c in RAW_NUMERIC]
        values: dict = {}
        if raw:
            values.update({c: q[0] for c, q in column_quantiles(df, raw, [0.5]).items()})
        derived = [c for c in numeric if c not in RAW_NUMERIC]
        if derived:
            values.update(aggregate(df, {c: F.avg(c) for c in derived}))
        if text:
            values.update(modes(df, text))
        return cls({k: v for k, v in values.items() if v is not None})

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c, kind in df.dtypes:
            if c not in self.values:
                out.append(F.col(c))
            elif kind in NUMERIC_KINDS:
                out.append(F.coalesce(F.col(c).cast("double"), F.lit(float(self.values[c]))).alias(c))
            else:
                out.append(F.coalesce(F.col(c), F.lit(self.values[c])).alias(c))
        return df.select(*out)


@dataclass(frozen=True)
class VarianceFilter:
    variances: dict
    threshold: float = 1e-6

    @classmethod
    def fit(cls, df: DataFrame, threshold: float = 1e-6) -> "VarianceFilter":
        return cls(aggregate(df, {c: F.var_pop(c) for c in numeric_columns(df)}), threshold)

    @property
    def dropped(self) -> list[str]:
        return [c for c, v in self.variances.items() if v is None or v <= self.threshold]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)


@dataclass(frozen=True)
class LabelEncoder:
    """Position of a value among the sorted classes; unseen values take the commonest class."""

    classes: dict
    defaults: dict

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str] = ("sex", "smoker"), most: int = MOST_CLASSES):
        """With more than ``most`` classes the result is a TableEncoder, which gives the same numbers."""
        if many_classes(df, columns, most):
            from ratebook.operators.encoders import TableEncoder

            return TableEncoder.fit(df, columns)
        counts = category_counts(df, columns)
        return cls({c: sorted(n) for c, n in counts.items()}, {c: most_frequent(n) for c, n in counts.items()})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: lookup(c, {v: i for i, v in enumerate(known)}, known.index(self.defaults[c]) if known else None)
            for c, known in self.classes.items()})


@dataclass(frozen=True)
class OneHot:
    """One 0/1 column per category but the alphabetically first; unseen values give zeros."""

    categories: dict

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str] = ("region", "bmi_category", "age_group"), most: int = MOST_CLASSES):
        """With more than ``most`` categories the result is a TableOneHot: where the one is, not a column each."""
        if many_classes(df, columns, most):
            from ratebook.operators.encoders import TableOneHot

            return TableOneHot.fit(df, columns)
        return cls({c: sorted(n)[1:] for c, n in category_counts(df, columns).items()})

    @property
    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.categories.items() for v in vs]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {f"{c}_{v}": F.when(F.col(c) == v, 1).otherwise(0) for c, vs in self.categories.items() for v in vs}
        return df.withColumns(new).drop(*self.categories)


def encoding_guard(before: DataFrame, after: DataFrame, keep: Sequence[str] = ("policy_id",)) -> DataFrame:
    """After encoding: same number of rows, no nulls, only numeric columns; raises otherwise."""
    text = [c for c in text_columns(after) if c not in keep]
    if text:
        raise ValueError(f"columns are not numeric: {', '.join(text)}")
    columns = [c for c in after.columns if c not in keep]
    nulls = F.lit(0)
    for c in columns:
        nulls = nulls + F.col(c).isNull().cast("int")
    report = after.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("n_nulls"))
    found = report.first()
    expected = before.count()
    if found["n_rows"] != expected:
        raise ValueError(f"row count changed from {expected} to {found['n_rows']}")
    if found["n_nulls"]:
        raise ValueError(f"{found['n_nulls']} null values after encoding")
    return report


@dataclass(frozen=True)
class Products:
    """Pairwise products (and squares) of columns, the most varying ones kept."""

    pairs: tuple
    variances: dict

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], keep: int = 50, interaction_only: bool = True,
            budget: int = 100) -> "Products":
        columns = list(columns)
        pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + (1 if interaction_only else 0):]]
        allowed = min(keep, budget - len(columns))
        if allowed <= 0 or not pairs:
            return cls((), {})
        variances = aggregate(df, {p: F.var_pop(F.col(p[0]).cast("double") * F.col(p[1])) for p in pairs})
        ranked = sorted(pairs, key=lambda p: -(variances[p] or 0.0))[:allowed]
        chosen = tuple(p for p in pairs if p in set(ranked))
        return cls(chosen, {cls.name(p): variances[p] for p in pairs})

    @staticmethod
    def name(pair) -> str:
        a, b = pair
        return f"{a}_squared_product" if a == b else f"{a}_x_{b}"

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({self.name(p): F.col(p[0]).cast("double") * F.col(p[1]) for p in self.pairs})


def moments_matrix(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(correlation, mean, population deviation, known rows) of many columns; null and NaN are unknown.

    A correlation is over the rows where both columns are known, undefined without variation. One pass finds mean and
    deviation, a second adds up the products of the standardised columns, of their squares and of which are known.
    """
    known = df.select(*(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns))
    stats = aggregate(known, {(c, k): f(c) for c in columns for k, f in (("n", F.count), ("mean", F.avg), ("std", F.stddev_pop))})
    n, mean, std = (np.array([stats[c, k] if stats[c, k] is not None else np.nan for c in columns], float) for k in ("n", "mean", "std"))
    unit = [(F.col(c) - F.lit(float(m))) / F.lit(float(s) if s > 0 else 1.0) for c, m, s in zip(columns, mean, std)]
    z = [F.coalesce(u, F.lit(0.0)) for u in unit]
    there = [F.col(c).isNotNull().cast("double") for c in columns]
    k = len(columns)
    if len(set(n)) == 1 and n[0] == known.count():  # nothing is unknown: one column of ones stands for all
        g = grams(known, [*z, F.lit(1.0)]).get((), np.zeros((k + 1, k + 1)))
        both, one = np.full((k, k), g[k, k]), np.repeat(g[:k, k:], k, axis=1)
        two, products = np.repeat(np.diag(g)[:k, None], k, axis=1), g[:k, :k]
    else:
        g = grams(known, [*z, *there, *[v * v for v in z]]).get((), np.zeros((3 * k, 3 * k)))
        both, one, two, products = g[k:2 * k, k:2 * k], g[:k, k:2 * k], g[2 * k:, k:2 * k], g[:k, :k]
    with np.errstate(divide="ignore", invalid="ignore"):
        centre = one / both  # the mean of the line's column where the other one is known
        spread = two / both - centre**2
        spread[spread <= 1e-14] = np.nan
        corr = (products / both - centre * centre.T) / np.sqrt(spread * spread.T)
    return np.clip(corr, -1, 1), mean, std, n


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All pairwise correlations as rows (a, b, correlation), each over the rows where both are known."""
    corr = moments_matrix(df, columns)[0]
    rows = [(columns[i], columns[j], None if math.isnan(corr[i, j]) else float(corr[i, j])) for i, j in combinations(range(len(columns)), 2)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, correlation double")


# Features that pruning must keep.
PROTECTED = ("smoker", "age", "bmi", "sex", "smoker_extreme_bmi_age", "smoker_children",
             "age_severity_interaction", "smoker_adjusted_bmi", "age_bmi_stress")


def correlated_drops(names: Sequence[str], corr: np.ndarray, target: Sequence[float] | None,
                     variance: Sequence[float], threshold: float = 0.90) -> list[str]:
    """Of each pair above the threshold the one that says less about the target goes."""
    score = [abs(t) if t == t else 0.0 for t in target] if target is not None else list(variance)
    gone: list[str] = []
    for j, second in enumerate(names):
        for i, first in enumerate(names[:j]):
            if abs(corr[i, j]) > threshold and first not in gone and second not in gone:
                gone.append(first if score[j] >= score[i] else second)
    return gone


def inflation(corr: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    """Variance inflation: regression without intercept, judged against the centred spread."""
    gram = corr * np.outer(std, std) + np.outer(mean, mean)
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    inverse = np.linalg.pinv(gram / np.outer(scale, scale), rcond=1e-12)
    residual = scale**2 / np.maximum(np.diag(inverse), 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = 1.0 - residual / std**2
    return np.where(r2 >= 0.9999, np.inf, np.where(r2 < 0, 1.0, 1.0 / (1.0 - r2)))


@dataclass(frozen=True)
class CollinearityFilter:
    dropped: tuple
    correlation_drops: tuple
    inflation_drops: tuple

    @classmethod
    def fit(cls, df: DataFrame, target: str | None = None, threshold: float = 0.90, vif_limit: float = 10.0,
            rounds: int = 10, exempt: Sequence[str] = ()) -> "CollinearityFilter":
        columns = [c for c in numeric_columns(df, ("policy_id", target)) if c not in PROTECTED]
        first = ["children"] if "children" in columns and "family_size" in columns else []
        columns = [c for c in columns if c not in first]
        with_target = [*columns, *([target] if target else [])]
        corr, mean, std, _ = moments_matrix(df, with_target)
        corr, mean, std = np.nan_to_num(corr), np.nan_to_num(mean), np.nan_to_num(std)
        np.fill_diagonal(corr, 1.0)
        k = len(columns)
        pruned = correlated_drops(columns, corr[:k, :k], corr[:k, k] if target else None, std[:k] ** 2, threshold)
        many = distinct_over_two(df, columns)
        left = [i for i, c in enumerate(columns) if c not in pruned and c not in exempt and c in many]
        removed = []
        for _ in range(rounds):
            if len(left) <= 1:
                break
            vif = inflation(corr[np.ix_(left, left)], mean[left], std[left])
            worst = int(np.argmax(vif))
            if not vif[worst] > vif_limit:
                break
            removed.append(columns[left.pop(worst)])
        return cls((*first, *pruned, *removed), (*first, *pruned), tuple(removed))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped)


def distinct_over_two(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Columns with more than two values: some value lies strictly between the extremes."""
    ends = aggregate(df, {(c, k): f(c) for c in columns for k, f in (("lo", F.min), ("hi", F.max))})
    known = [c for c in columns if ends[c, "lo"] is not None]
    inner = aggregate(df, {c: F.max((F.col(c) > F.lit(ends[c, "lo"])) & (F.col(c) < F.lit(ends[c, "hi"]))) for c in known})
    return {c for c in known if inner[c]}


@dataclass(frozen=True)
class Scaler:
    """(x - mean) / population deviation of every column with more than two values."""

    params: dict

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str] | None = None) -> "Scaler":
        columns = list(columns or numeric_columns(df))
        bad = aggregate(df, {c: F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
                                           | (F.abs(F.col(c).cast("double")) == float("inf"))) for c in columns})
        broken = [c for c, n in bad.items() if n]
        if broken:
            raise ValueError(f"null or infinite values in: {', '.join(broken)}")
        many = distinct_over_two(df, columns)
        columns = [c for c in columns if c in many]
        stats = aggregate(df, {(c, k): f(c) for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_pop))})
        return cls({c: (stats[c, "mean"], stats[c, "std"] or 1.0) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in self.params.items() if c in df.columns})


def iqr_bounds(df: DataFrame, column: str, multiplier: float = 1.5) -> tuple[float, float]:
    q1, q3 = quantiles(df, column, [0.25, 0.75])
    return q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)


def iqr_outliers(df: DataFrame, column: str, multiplier: float = 1.5) -> DataFrame:
    low, high = iqr_bounds(df, column, multiplier)
    return df.withColumn("outlier", (F.col(column) < F.lit(low)) | (F.col(column) > F.lit(high)))


@dataclass(frozen=True)
class TargetTransform:
    """Method, shape parameter and the ranges seen when it was fitted."""

    method: str
    lam: float | None
    min: float
    max: float
    safe_min: float
    safe_max: float
    z_min: float
    z_max: float
    z_mean: float
    z_std: float

    @classmethod
    def fit(cls, df: DataFrame, target="charges", method: str = "yeo-johnson", buffer: float = 0.40) -> "TargetTransform":
        with kept(df.select(col(target).cast("double").alias("y"))) as narrow:
            return cls._fit(narrow, method, buffer)

    @classmethod
    def _fit(cls, df: DataFrame, method: str, buffer: float) -> "TargetTransform":
        y = F.col("y")
        ends = df.agg(F.min(y).alias("lo"), F.max(y).alias("hi")).first()
        if method == "boxcox" and ends["lo"] <= 0:
            raise ValueError("a Box-Cox transform needs positive values")
        lam = best_lambda(df, y, method) if method in ("yeo-johnson", "boxcox") else None
        z = targets.forward(y, method, lam)
        spread = F.stddev_samp(z) if method == "log1p" else F.stddev_pop(z)
        s = df.agg(F.min(z).alias("lo"), F.max(z).alias("hi"), F.avg(z).alias("mean"), spread.alias("std")).first()
        return cls(method, lam, ends["lo"], ends["hi"], ends["lo"] * (1 - buffer), ends["hi"] * (1 + buffer),
                   s["lo"], s["hi"], s["mean"], s["std"])

    @property
    def z_low(self) -> float:
        return self.z_mean - 3.0 * self.z_std

    @property
    def z_high(self) -> float:
        return self.z_mean + 3.0 * self.z_std

    def apply(self, x):
        return targets.forward(x, self.method, self.lam)

    def invert(self, z, safe: bool = True):
        """Back to money; clipping is off for interval bounds. Box-Cox clips only the result."""
        z = col(z)
        if self.method == "none":
            return z
        if safe and self.method != "boxcox":
            z = clip(z, self.z_low, self.z_high)
        y = targets.backward(z, self.method, self.lam)
        return clip(y, self.safe_min, self.safe_max) if safe else y


def log_likelihoods(df: DataFrame, y, method: str, points: Sequence[float]) -> list[float]:
    """The log-likelihood of each shape parameter, all from one aggregate pass; minus infinity without variation."""
    y = col(y)
    logs = F.signum(y) * F.log1p(F.abs(y)) if method == "yeo-johnson" else F.ln(y)
    row = df.agg(
        F.count(y).alias("n"), F.sum(logs).alias("logs"),
        *[F.var_pop(targets.forward(y, method, float(p))).alias(f"v{i}") for i, p in enumerate(points)]).first()
    return [-row["n"] / 2.0 * math.log(row[f"v{i}"]) + (p - 1.0) * row["logs"] if row[f"v{i}"] else -math.inf
            for i, p in enumerate(points)]


def best_lambda(df: DataFrame, y, method: str, low: float = -2.0, high: float = 3.0, grid: int = 21, rounds: int = 4) -> float:
    """Maximum-likelihood shape parameter.

    A round evaluates a whole grid in one aggregate pass, then narrows to the cells
    around the best one; a parabola through the last three points gives the optimum.
    """
    for _ in range(rounds):
        points = np.linspace(low, high, grid)
        like = np.array(log_likelihoods(df, y, method, points.tolist()))
        best = int(np.argmax(like))
        low, high = float(points[max(best - 1, 0)]), float(points[min(best + 1, grid - 1)])
        if 0 < best < grid - 1 and np.isfinite(like[best - 1:best + 2]).all():
            a, b, c = like[best - 1:best + 2]
            bend = a - 2 * b + c
            answer = float(points[best]) + (0.5 * (a - c) / bend * (points[1] - points[0]) if bend else 0.0)
        else:
            answer = float(points[best])
    return float(answer)


# What a prediction column may look like per scale.
def scale_check(df: DataFrame, column: str, scale: str = "original") -> DataFrame:
    out = df.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.avg(column).alias("mean"))
    top = F.col("max")
    if scale == "log":
        verdict = F.when(top > 30, "original_scale").when(top < 1, "too_small").otherwise("ok")
    elif scale == "original":
        verdict = F.when(top < 100, "transformed_scale").otherwise("ok")
    else:
        raise ValueError(f"unknown scale {scale}")
    return out.withColumns({"verdict": verdict, "valid": verdict == "ok"})


def looks_transformed(method: str):
    """Whether the range (min, max) of a column fits a method's transformed scale."""
    lo, hi = F.col("min"), F.col("max")
    return {
        "log1p": (lo >= -1) & (hi < 20), "log": (lo >= 3) & (hi < 15), "boxcox": hi < 100,
        "yeo-johnson": (lo >= -20) & (hi <= 20)}.get(method, F.lit(False))


def extrapolation(df: DataFrame, column: str, t: TargetTransform) -> DataFrame:
    x = col(column)
    n = F.count(x)
    parts = {"below_min": x < t.min, "above_max": x > t.max, "above_safe_max": x > t.safe_max}
    return df.agg(
        n.alias("n"), F.min(x).alias("lowest"), F.max(x).alias("highest"),
        *[F.count_if(test).alias(f"n_{k}") for k, test in parts.items()],
        *[F.try_divide(F.count_if(test) * 100.0, n).alias(f"pct_{k}") for k, test in parts.items()],
        ((F.max(x) - t.max) / t.max * 100.0).alias("beyond_max_pct"))
