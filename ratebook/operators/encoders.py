"""Encodings of category columns with any number of classes: the classes stay a table and are joined."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.operators.ranks import ranked_values
from ratebook.operators.splits import stored


def class_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, v, n, number): the sorted classes of every column, numbered from 0 on."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])
    ranked = ranked_values(df.select(F.inline(pairs)), "value", ["feature"])
    return stored(ranked.select("feature", "v", "n", F.col("number").cast("int").alias("number")), "classes")


def _joined(df: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``df`` with ``_number``, the class number of a column's value. The table side has each value once."""
    known = table.where(F.col("feature") == column).select(F.col("v").alias("_v"), F.col("number").alias("_number"))
    return df.join(known, F.col(column) == F.col("_v"), "left").drop("_v")


@dataclass(frozen=True)
class TableEncoder:
    """Position of a value among the sorted classes; unseen values and nulls take the commonest class."""

    classes: DataFrame
    defaults: dict

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "TableEncoder":
        table = class_table(df, columns)
        common = table.groupBy("feature").agg(F.min_by("number", F.struct(-F.col("n"), "v")).alias("number")).collect()
        found = {r["feature"]: r["number"] for r in common}
        return cls(table, {c: found.get(c) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        order = df.columns
        for c, default in self.defaults.items():
            df = _joined(df, self.classes, c).withColumn(c, F.coalesce("_number", F.lit(default).cast("int"))).drop("_number")
        return df.select(*order)


@dataclass(frozen=True)
class TableOneHot:
    """For each column ``<name>_hot``: the 0-based place of the one among all but the first class, null for the
    first class, nulls and unseen values, which have zeros only. ``sizes`` gives the widths."""

    classes: DataFrame
    sizes: dict

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> "TableOneHot":
        table = class_table(df, columns)
        found = {r["feature"]: r["n"] for r in table.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
        return cls(table, {c: max(0, found.get(c, 0) - 1) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        for c in self.sizes:
            df = _joined(df, self.classes, c).withColumn(f"{c}_hot", F.when(F.col("_number") > 0, F.col("_number") - 1)).drop("_number", c)
        return df
