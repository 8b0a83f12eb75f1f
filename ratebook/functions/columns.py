"""Small column helpers shared by every operator."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def flag(condition: Column) -> Column:
    return condition.cast("int")


def above(x: Column, start: float) -> Column:
    """Excess of x over a start value, zero below it."""
    return F.greatest(x - F.lit(start), F.lit(0.0))


def clip(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def band(x, edges: Sequence[float], labels: Sequence, include_lowest: bool = False) -> Column:
    """Right-closed bands (lo, hi]; values outside every band give null."""
    x = col(x)
    first, last = edges[0], edges[-1]
    inside = F.lit(True)
    if first != float("-inf"):
        inside = x >= F.lit(float(first)) if include_lowest else x > F.lit(float(first))
    out = None
    for edge, label in zip(edges[1:], labels):
        if edge == float("inf"):
            test = x.isNotNull()
        else:
            test = x <= F.lit(float(edge))
        test = inside & test
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out


def lookup(key: Sequence | Column | str, table: Mapping, default=None) -> Column:
    """Literal lookup of a handful of fitted values as one `when` chain."""
    keys = key if isinstance(key, (list, tuple)) else [key]
    out = None
    for k, value in table.items():
        parts = k if isinstance(k, tuple) else (k,)
        test = F.lit(True)
        for c, part in zip(keys, parts):
            test = test & col(c).eqNullSafe(F.lit(part))
        out = F.when(test, F.lit(value)) if out is None else out.when(test, F.lit(value))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))


def rounded(df, digits: Mapping[str, int] | int, only: Sequence[str] | None = None):
    """Round the double columns of a result; a mapping sets digits per column."""
    out = []
    for name, kind in df.dtypes:
        d = digits.get(name) if isinstance(digits, Mapping) else digits
        if kind in ("double", "float") and d is not None and (only is None or name in only):
            out.append(F.round(F.col(f"`{name}`"), d).alias(name))
        else:
            out.append(F.col(f"`{name}`"))
    return df.select(*out)


def hash_key(key, seed: int) -> Column:
    """Sixty bits of an md5 over (seed, key): a reproducible random order of rows."""
    text = F.concat_ws(":", F.lit(str(seed)), col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
