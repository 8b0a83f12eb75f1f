"""Inverse of the normal distribution as a column, by rational functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# P. J. Acklam's approximation, relative error below 1.2e-9.
CENTRE_TOP = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
CENTRE_BOTTOM = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0)
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0)
TAIL = 0.02425


def _polynomial(x: Column, coefficients: tuple) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """z with probability p below it; null outside (0, 1)."""
    low = F.least(p, 1 - p)
    q = F.sqrt(-2.0 * F.ln(low))
    tail = _polynomial(q, TAIL_TOP) / _polynomial(q, TAIL_BOTTOM)
    d = p - 0.5
    centre = d * _polynomial(d * d, CENTRE_TOP) / _polynomial(d * d, CENTRE_BOTTOM)
    z = F.when(low >= TAIL, centre).when(p < 0.5, tail).otherwise(-tail)
    return F.when((p > 0) & (p < 1), z)


def normal_quantile_sql(p: str) -> str:
    """The same as text of a statement."""

    def polynomial(x: str, coefficients: tuple) -> str:
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"({out}*{x}+{c!r})"
        return out

    q, d = f"sqrt(-2.0*ln(least({p},1.0-({p}))))", f"(({p})-0.5)"
    tail = f"{polynomial(q, TAIL_TOP)}/{polynomial(q, TAIL_BOTTOM)}"
    centre = f"{d}*{polynomial(f'({d}*{d})', CENTRE_TOP)}/{polynomial(f'({d}*{d})', CENTRE_BOTTOM)}"
    return f"CASE WHEN least({p},1.0-({p}))>={TAIL} THEN {centre} WHEN {p}<0.5 THEN {tail} ELSE -({tail}) END"
