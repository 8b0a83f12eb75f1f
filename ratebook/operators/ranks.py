"""Global ranks and dense numbers of values of any number, without a window over all of them.

Distinct values are counted, cut into ranges and numbered within each; what lies before a range is a sum over the
ranges before it, one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratebook.functions.columns import col
from ratebook.functions.normal import normal_quantile
from ratebook.operators.splits import stored


def ranked_values(df: DataFrame, value, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """(by, v, n, before, number): each distinct value of a group with its rows, the rows of smaller values and its
    place among the group's values from 0 on. Nulls and NaN are left out. The groups must be few; a value may hold
    any share of the rows."""
    by = list(by)
    rows = df.select(*by, col(value).alias("v")).where("v IS NOT NULL")
    if isinstance(rows.schema["v"].dataType, (T.DoubleType, T.FloatType)):
        rows = rows.where(~F.isnan("v")).withColumn("v", F.col("v") + F.lit(0.0).cast(rows.schema["v"].dataType))  # one zero
    counted = rows.groupBy(*by, "v").agg(F.count(F.lit(1)).alias("n"))
    dealt = counted.repartitionByRange(ranges, *by, "v") if ranges else counted.repartitionByRange(*by, "v")
    kept = stored(dealt.withColumn("part", F.spark_partition_id()), "ranked")
    totals = kept.groupBy(*by, "part").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("values")).collect()
    groups: dict[tuple, list] = {}
    for r in sorted(totals, key=lambda r: r["part"]):
        groups.setdefault(tuple(r[b] for b in by), []).append(r)
    offsets = [(*g, r["part"], a, b) for g, rs in groups.items()
               for r, a, b in zip(rs, accumulate([r["rows"] for r in rs], initial=0), accumulate([r["values"] for r in rs], initial=0))]
    fields = [*[T.StructField(f"_{b}", kept.schema[b].dataType) for b in by], T.StructField("_part", T.IntegerType()),
              T.StructField("_rows", T.LongType()), T.StructField("_values", T.LongType())]
    table = kept.sparkSession.createDataFrame(offsets, T.StructType(fields))
    same = F.col("part") == F.col("_part")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_{b}"))
    inside = Window.partitionBy(*by, "part").orderBy("v")
    upto = F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return (kept.join(F.broadcast(table), same)  # a row per range and group
            .select(*by, "v", "n", (F.col("_rows") + upto).alias("before"), (F.col("_values") + F.row_number().over(inside) - 1).alias("number")))


def mean_rank() -> Column:
    """1-based rank of the rows of a ranked value, ties averaged."""
    return F.col("before") + (F.col("n") + 1) / 2.0


def shapiro_francia(df: DataFrame, value) -> DataFrame:
    """(n, w): the squared correlation of the ordered values with normal scores, from global ranks; near 1 if normal.

    Scores follow Blom, at (rank - 3/8) / (n + 1/4). Fewer than three rows or a constant column have no statistic.
    """
    values = stored(ranked_values(df, col(value).cast("double")), "normal-ranks")
    n = values.agg(F.sum("n")).first()[0] or 0
    score = normal_quantile((mean_rank() - 0.375) / F.lit(n + 0.25))
    rows = values.select("v", F.col("n").cast("double").alias("w"), score.alias("m"))
    total = lambda c: F.sum(c * F.col("w"))
    v, m = F.col("v"), F.col("m")
    centre = values.agg((F.sum(F.col("v") * F.col("n")) / F.lit(max(n, 1)))).first()[0] or 0.0
    v = v - F.lit(float(centre))
    out = rows.agg(total(v * m).alias("vm"), total(v * v).alias("vv"), total(m * m).alias("mm"), total(v).alias("v"), total(m).alias("m"))
    size = F.lit(float(max(n, 1)))
    across = F.col("vm") - F.col("v") * F.col("m") / size
    spread = (F.col("vv") - F.col("v") * F.col("v") / size) * (F.col("mm") - F.col("m") * F.col("m") / size)
    return out.select(F.lit(n).cast("long").alias("n"), F.when((F.lit(n) >= 3) & (spread > 0), across * across / spread).alias("w"))
