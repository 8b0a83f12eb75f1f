"""Aggregate expressions of accuracy, residual shape and portfolio economics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratebook.config import Economics
from ratebook.functions.columns import col
from ratebook.functions.economics import business_score, policy_economics

EPS = 2.220446049250313e-16


def share(condition: Column) -> Column:
    """Fraction of rows for which a condition holds."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def rmse(y, p) -> Column:
    e = col(p) - col(y)
    return F.sqrt(F.avg(e * e))


def mae(y, p) -> Column:
    return F.avg(F.abs(col(p) - col(y)))


def r2(y, p, at_least: int = 2) -> Column:
    """Null below two rows; a constant target scores 1 when matched and 0 otherwise."""
    e = col(p) - col(y)
    n = F.count(col(y))
    residual = F.sum(e * e)
    total = F.var_pop(col(y)) * n
    return (
        F.when(n < at_least, F.lit(None))
        .when(total > 0, 1.0 - F.try_divide(residual, total))
        .when(residual == 0, 1.0).otherwise(0.0))


def mape(y, p, floor: float = EPS) -> Column:
    return F.avg(F.abs(col(p) - col(y)) / F.greatest(F.abs(col(y)), F.lit(floor))) * 100.0


def smape(y, p, smallest: float = 0.01) -> Column:
    half = (F.abs(col(y)) + F.abs(col(p))) / 2.0
    ratio = F.when(half > smallest, F.try_divide(F.abs(col(p) - col(y)), half))
    return F.coalesce(F.avg(ratio) * 100.0, F.lit(0.0))


def male(y, p) -> Column:
    """Mean absolute log error; over log1p as soon as one value is not positive."""
    y, p = col(y), col(p)
    plain = F.avg(F.abs(F.ln(y) - F.ln(p)))
    shifted = F.avg(F.abs(F.log1p(y) - F.log1p(p)))
    return F.when(F.least(F.min(y), F.min(p)) <= 0, shifted).otherwise(plain)


def accuracy(y="y_true", p="price") -> dict[str, Column]:
    error = col(p) - col(y)
    return {
        "n": F.count(col(y)),
        "rmse": rmse(y, p),
        "mae": mae(y, p),
        "mape": mape(y, p),
        "smape": smape(y, p),
        "male": male(y, p),
        "r2": r2(y, p),
        "mean_true": F.avg(col(y)),
        "mean_pred": F.avg(col(p)),
        "mean_error": F.avg(error),
        "std_error": F.stddev_pop(error),
    }


def portfolio(y="y_true", p="price", e: Economics | None = None, only: Iterable[str] | None = None) -> dict[str, Column]:
    """Totals and rates of the per-policy economics: all of them, or the named ones."""
    e = e or Economics()
    row = policy_economics(y, p, e)
    n = F.count(col(y))

    def total(name):
        return F.sum(row[name])

    def accurate():
        return F.count_if(row["accurate"])

    measures = {
        "total_revenue": lambda: total("revenue"),
        "total_claims": lambda: F.sum(col(y)),
        "total_admin": lambda: n * F.lit(e.admin),
        "total_gross_profit": lambda: total("gross_profit"),
        "gross_margin_pct": lambda: F.coalesce(F.try_divide(total("gross_profit"), total("revenue")) * 100.0, F.lit(0.0)),
        "total_churn_cost": lambda: total("churn_cost"),
        "total_underpricing_penalty": lambda: total("underpricing_penalty"),
        "total_accuracy_bonus": lambda: total("accuracy_bonus"),
        "total_net_profit": lambda: total("net_profit"),
        "net_margin_pct": lambda: F.coalesce(F.try_divide(total("net_profit"), total("revenue")) * 100.0, F.lit(0.0)),
        "profit_per_policy": lambda: F.try_divide(total("net_profit"), n),
        "expected_churned": lambda: total("churn_probability"),
        "churn_rate_pct": lambda: F.try_divide(total("churn_probability"), n) * 100.0,
        "n_underpriced": lambda: F.count_if(row["error"] < 0),
        "n_overpriced": lambda: F.count_if(row["error"] > 0),
        "n_accurate": accurate,
        "accuracy_rate_pct": lambda: F.try_divide(accurate(), n) * 100.0,
        "business_score": lambda: business_score(
            F.try_divide(total("net_profit"), n), F.try_divide(total("churn_probability"), n),
            F.try_divide(accurate(), n), e),
    }
    return {k: measures[k]() for k in (only or measures)}


def skew_pop(x) -> Column:
    return F.skewness(col(x))


def kurt_pop(x) -> Column:
    """Excess kurtosis of the population."""
    return F.kurtosis(col(x))


def skew_sample(x) -> Column:
    """Bias-corrected skewness."""
    n = F.count(col(x)).cast("double")
    return F.when(n > 2, F.skewness(col(x)) * F.sqrt(n * (n - 1)) / (n - 2))


def kurt_sample(x) -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(col(x)).cast("double")
    return F.when(n > 3, ((n + 1) * F.kurtosis(col(x)) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def jarque_bera(x) -> Column:
    n = F.count(col(x))
    s, k = F.skewness(col(x)), F.kurtosis(col(x))
    return n / 6.0 * (s * s + k * k / 4.0)


def named(columns: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]
