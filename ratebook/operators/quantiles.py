"""Exact order statistics of columns of any size.

Spark's ``percentile`` keeps every distinct value of a group in one task, which
cannot work for a continuous column of a very large table. Here each wanted
rank is bracketed by repeated histograms: a pass counts the rows of a bracket
in equal-width slices (partial aggregation makes that a few rows per task, so
one hot value or group does no harm) and narrows the bracket to one slice. Once
a bracket holds few rows its distinct values are ranked in one small window.
Only counts, edges and the wanted values ever reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratebook.functions.columns import col

SLICES = 1024
SMALL_BRACKET = 500_000


@dataclass
class Bracket:
    group: tuple
    ranks: list[int]
    below: int
    n: int
    lo: object
    hi: object


@contextmanager
def kept(df: DataFrame):
    """Hold a narrow table between the passes of a fit; a lost block is recomputed."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def _matched(rows: DataFrame, by: Sequence[str], table: list[tuple], fields: Sequence[T.StructField], test: Column) -> DataFrame:
    """Inner join with a local table of a few rows per group; its size is known to Spark."""
    keys = [T.StructField(f"w_{k}", rows.schema[k].dataType) for k in by]
    local = rows.sparkSession.createDataFrame(table, T.StructType([*keys, *fields]))
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"w_{k}"))
    return rows.join(local, same & test)


def _bracketed(rows: DataFrame, by: Sequence[str], brackets: Sequence[Bracket]) -> DataFrame:
    """Rows inside a bracket, with its number, ends and scale. The brackets of a group are disjoint.

    A few brackets are tested in the scan's own stage; many are joined by group.
    """
    kind = rows.schema["v"].dataType
    if len(brackets) <= LITERAL_RANKS:
        found = F
        for i, b in enumerate(brackets):
            lo, hi = F.lit(b.lo).cast(kind), F.lit(b.hi).cast(kind)
            test = F.col("v").between(lo, hi)
            for name, value in zip(by, b.group):
                test = test & F.col(name).eqNullSafe(F.lit(value))
            scale = F.lit(1.0 if math.isfinite(float(b.hi) - float(b.lo)) else 0.5)
            own = F.struct(F.lit(i).alias("bracket"), lo.alias("lo"), hi.alias("hi"), scale.alias("scale"))
            found = found.when(test, own)
        return rows.withColumn("_in", found).where("_in IS NOT NULL").select(*rows.columns, "_in.*")
    fields = [T.StructField("bracket", T.IntegerType()), T.StructField("lo", kind), T.StructField("hi", kind),
              T.StructField("scale", T.DoubleType())]
    table = [(*b.group, i, b.lo, b.hi, 1.0 if math.isfinite(float(b.hi) - float(b.lo)) else 0.5)
             for i, b in enumerate(brackets)]
    return _matched(rows, by, table, fields, F.col("v").between(F.col("lo"), F.col("hi")))


def _distance(rows: DataFrame, a: str, b: str) -> Column:
    """a - b as a double: exact for whole numbers, without overflow for any range."""
    if isinstance(rows.schema["v"].dataType, (T.DoubleType, T.FloatType)):
        return F.col(a) * F.col("scale") - F.col(b) * F.col("scale")
    return (F.col(a).cast("decimal(20,0)") - F.col(b).cast("decimal(20,0)")).cast("double")


def _narrow(rows: DataFrame, by: Sequence[str], wide: list[Bracket]) -> list[Bracket]:
    """Replace each bracket by the slices that hold its ranks: one counting pass. Both ends
    of a bracket fall into different slices, so every pass makes it smaller."""
    place = F.floor(_distance(rows, "v", "lo") / _distance(rows, "hi", "lo") * SLICES)
    counts = (
        _bracketed(rows, by, wide)
        .groupBy("bracket", F.least(place, F.lit(SLICES - 1)).cast("int").alias("slice"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    )
    slices: dict[int, list] = {}
    for r in sorted(counts, key=lambda r: (r["bracket"], r["slice"])):
        slices.setdefault(r["bracket"], []).append(r)
    out = []
    for i, b in enumerate(wide):
        below = b.below
        for r in slices[i]:
            ranks = [k for k in b.ranks if below < k <= below + r["n"]]
            if ranks:
                out.append(Bracket(b.group, ranks, below, r["n"], r["lo"], r["hi"]))
            below += r["n"]
    return out


def order_statistics(
    df: DataFrame,
    value,
    ranks_for: Callable[[int], Iterable[int]],
    by: Sequence[str] = (),
) -> dict[tuple, tuple[int, dict[int, object]]]:
    """``{group: (n, {rank: value})}`` for the 1-based ranks that ``ranks_for(n)`` asks for.

    Nulls are left out. The number of groups must be small (tiers, bins, features).
    """
    return planned_order_statistics(df, value, lambda sizes: {g: ranks_for(n) for g, n in sizes.items()}, by)


def planned_order_statistics(
    df: DataFrame,
    value,
    plan: Callable[[dict[tuple, int]], dict[tuple, Iterable[int]]],
    by: Sequence[str] = (),
) -> dict[tuple, tuple[int, dict[int, object]]]:
    """As above where a group's ranks hang on the sizes of others: ``plan`` gets all sizes and names the ranks, none
    for a group it leaves out. Statistics of several columns take one search that way, melted into groups by name."""
    # Only the value and its group are kept between the passes: the source is computed
    # once, and a lost block is recomputed from it.
    with kept(df.select(*by, col(value).alias("v"))) as narrow:
        known = F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double"))
        return _order_statistics(narrow.where(known), plan, list(by))


def _order_statistics(rows: DataFrame, plan, by: list[str]) -> dict[tuple, tuple[int, dict[int, object]]]:
    stats = (
        rows.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        .collect()
    )
    out: dict[tuple, tuple[int, dict[int, object]]] = {}
    open_: list[Bracket] = []
    wanted = plan({tuple(r[b] for b in by): r["n"] for r in stats if r["n"]})
    for r in stats:
        n = r["n"]
        if n == 0:
            continue
        group = tuple(r[b] for b in by)
        ranks = sorted({min(max(int(k), 1), n) for k in wanted.get(group, ())})
        out[group] = (n, {})
        if ranks:
            open_.append(Bracket(group, ranks, 0, n, r["lo"], r["hi"]))

    small: list[Bracket] = []
    whole: list[Bracket] = []
    while open_:
        wide = []
        for b in open_:
            if b.lo == b.hi:
                out[b.group][1].update({k: b.lo for k in b.ranks})
            elif math.isinf(float(b.lo)) or math.isinf(float(b.hi)):
                raise ValueError("order statistics need finite values")
            elif b.n <= SMALL_BRACKET:
                (whole if b.n == out[b.group][0] else small).append(b)
            else:
                # Both ends are known already; asking for them needs no pass.
                for k in list(b.ranks):
                    if k in (b.below + 1, b.below + b.n):
                        out[b.group][1][k] = b.lo if k == b.below + 1 else b.hi
                        b.ranks.remove(k)
                if b.ranks:
                    wide.append(b)
        open_ = _narrow(rows, by, wide) if wide else []

    if small:
        marked = _bracketed(rows, by, small).select("bracket", "v")
        asked = [(i, k - b.below) for i, b in enumerate(small) for k in b.ranks]
        for r in _ranked(marked, ["bracket"], asked):
            b = small[r["bracket"]]
            out[b.group][1][r["rank"] + b.below] = r["v"]
    if whole:
        for r in _ranked(rows, by, [(*b.group, k) for b in whole for k in b.ranks], some=len(whole) < len(out)):
            out[tuple(r[c] for c in by)][1][r["rank"]] = r["v"]
    return out


LITERAL_RANKS = 32


def _ranked(rows: DataFrame, by: list[str], asked: list[tuple], some: bool = False) -> list[dict]:
    """The values at the asked ranks of groups that hold at most SMALL_BRACKET rows each.

    ``some`` says that other groups exist, of any size: they are left out of the window.
    """
    if not by:
        rows, by, asked = rows.withColumn("all", F.lit(0)), ["all"], [(0, *a) for a in asked]
    if some:
        groups = sorted({a[:-1] for a in asked}, key=repr)
        rows = _matched(rows, by, groups, [], F.lit(True)).select(*by, "v")
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("v"))
    ranked = rows.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    if len(asked) > LITERAL_RANKS:
        hit = (F.col("rank") > F.col("upto") - F.col("n")) & (F.col("rank") <= F.col("upto"))
        found = _matched(ranked, by, asked, [T.StructField("rank", T.LongType())], hit).select(*by, "rank", "v")
        return [r.asDict() for r in found.collect()]
    wanted = F.lit(False)
    for *group, k in asked:
        test = (F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)
        for name, value in zip(by, group):
            test = test & F.col(name).eqNullSafe(F.lit(value))
        wanted = wanted | test
    out = []
    for r in ranked.where(wanted).collect():
        group = tuple(r[c] for c in by)
        out += [{**r.asDict(), "rank": a[-1]} for a in asked
                if a[:-1] == group and r["upto"] - r["n"] < a[-1] <= r["upto"]]
    return out


def quantile_ranks(n: int, probs: Sequence[float]) -> list[int]:
    """The ranks between which the quantiles of n values lie."""
    below = [math.floor(p * (n - 1)) + 1 for p in probs]
    return [*below, *(min(k + 1, n) for k in below)]


def interpolated(n: int, values: dict[int, object], p: float) -> float:
    """The quantile at p from the order statistics at its ``quantile_ranks``."""
    position = p * (n - 1)
    k = math.floor(position) + 1
    low, high = float(values[k]), float(values[min(k + 1, n)])
    return low + (high - low) * (position - (k - 1))


def grouped_quantiles(
    df: DataFrame, value, probs: Sequence[float], by: Sequence[str] = ()
) -> dict[tuple, tuple[int, list[float]]]:
    """``{group: (n, quantiles)}``: linearly interpolated, exact for any number of rows."""
    found = order_statistics(df, value, lambda n: quantile_ranks(n, probs), by)
    return {group: (n, [interpolated(n, values, p) for p in probs]) for group, (n, values) in found.items()}


def exact_quantiles(df: DataFrame, value, probs: Sequence[float], by: Sequence[str] = ()) -> dict[tuple, list[float]]:
    return {group: row for group, (_, row) in grouped_quantiles(df, value, probs, by).items()}


def quantiles(df: DataFrame, value, probs: Sequence[float]) -> list[float | None]:
    """Quantiles of one whole column."""
    return exact_quantiles(df, value, probs).get((), [None] * len(probs))


def median(df: DataFrame, value) -> float | None:
    return quantiles(df, value, [0.5])[0]


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles of several columns at once: the columns are melted and ranked by name."""
    melted = melt(df, columns)
    found = exact_quantiles(melted, "value", probs, by=["feature"])
    return {c: found.get((c,), [None] * len(probs)) for c in columns}


def melt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long form (feature, value) of numeric columns, made inside the scan stage."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.inline(pairs))
