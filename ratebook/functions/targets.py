"""Target transforms as expressions: log1p, Yeo-Johnson and Box-Cox, both directions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratebook.functions.columns import col

ZERO = 1e-8


def yeo_johnson(x, lam: float) -> Column:
    x = col(x)
    upper = F.log1p(x) if abs(lam) < ZERO else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / F.lit(lam)
    rest = 2.0 - lam
    lower = -F.log1p(-x) if abs(rest) < ZERO else -(F.pow(1.0 - x, F.lit(rest)) - 1.0) / F.lit(rest)
    return F.when(x >= 0, upper).otherwise(lower)


def yeo_johnson_inverse(z, lam: float) -> Column:
    z = col(z)
    upper = F.expm1(z) if abs(lam) < ZERO else F.pow(z * F.lit(lam) + 1.0, F.lit(1.0 / lam)) - 1.0
    rest = 2.0 - lam
    lower = -F.expm1(-z) if abs(rest) < ZERO else 1.0 - F.pow(1.0 - z * F.lit(rest), F.lit(1.0 / rest))
    return F.when(z >= 0, upper).otherwise(lower)


def box_cox(x, lam: float) -> Column:
    x = col(x)
    return F.ln(x) if abs(lam) < ZERO else (F.pow(x, F.lit(lam)) - 1.0) / F.lit(lam)


def box_cox_inverse(z, lam: float) -> Column:
    z = col(z)
    if abs(lam) < ZERO:
        return F.exp(z)
    return F.pow(F.greatest(z * F.lit(lam) + 1.0, F.lit(1e-10)), F.lit(1.0 / lam))


def forward(x, method: str, lam: float | None) -> Column:
    if method == "log1p":
        return F.log1p(col(x))
    if method == "yeo-johnson":
        return yeo_johnson(x, lam)
    if method == "boxcox":
        return box_cox(x, lam)
    return col(x)


def backward(z, method: str, lam: float | None) -> Column:
    if method == "log1p":
        return F.expm1(col(z))
    if method == "yeo-johnson":
        return yeo_johnson_inverse(z, lam)
    if method == "boxcox":
        return box_cox_inverse(z, lam)
    return col(z)
