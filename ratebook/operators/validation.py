"""Validation, cleaning and profiles of policy tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.config import KEY, POLICY_COLUMNS, TARGET, Bounds
from ratebook.functions import checks
from ratebook.operators.quantiles import column_quantiles, median, melt
from ratebook.functions.columns import lookup

NUMERIC = ("age", "bmi", "children", TARGET)
CATEGORIES = ("sex", "smoker", "region")
QUARTILES = (0.25, 0.5, 0.75)


def require_columns(df: DataFrame, columns: Sequence[str] = POLICY_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def typed(df: DataFrame) -> DataFrame:
    """Numbers cast, categories normalised; unreadable numbers become null."""
    kinds = {"age": checks.as_int("age"), "bmi": checks.as_number("bmi"),
             "children": checks.as_int("children"), TARGET: checks.as_number(TARGET)}
    out = []
    for c in df.columns:
        if c in kinds:
            out.append(kinds[c].alias(c))
        elif c in CATEGORIES:
            out.append(checks.normal(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def cast_failures(df: DataFrame, columns: Sequence[str] = ("age", "bmi", "children")) -> DataFrame:
    """How many values of each column are text that is no number."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("raw")) for c in columns])
    rows = df.select(F.inline(pairs))
    bad = F.col("raw").isNotNull() & checks.as_number("raw").isNull()
    return rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(bad).alias("non_numeric"),
        F.min(F.when(bad, F.col("raw"))).alias("example"))


def checked(df: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Adds ``errors`` (array of codes) and ``status``."""
    out = df.withColumn("errors", checks.record_errors(bounds))
    return out.withColumn("status", F.when(F.size("errors") == 0, "success").otherwise("error"))


def split_valid(df: DataFrame, bounds: Bounds | None = None) -> tuple[DataFrame, DataFrame]:
    """(typed valid rows, quarantined raw rows with their errors)."""
    all_ = checked(require_columns(df), bounds)
    valid = typed(all_.where(F.col("status") == "success").drop("errors", "status"))
    return valid, all_.where(F.col("status") == "error").drop("status")


def offending_rows(df: DataFrame, key: str = KEY, bounds: Bounds | None = None, show: int = 20) -> DataFrame:
    return (
        checked(df, bounds).where(F.col("status") == "error")
        .select(key, F.concat_ws("|", "errors").alias("errors")).orderBy(key).limit(show))


def require_valid(df: DataFrame, key: str = KEY, bounds: Bounds | None = None) -> DataFrame:
    """Strict mode: raise on any bad row, naming the first twenty."""
    bad = offending_rows(require_columns(df), key, bounds).collect()
    if bad:
        raise ValueError("invalid rows: " + "; ".join(f"{r[key]} ({r['errors']})" for r in bad))
    return typed(df)


def without_duplicates(df: DataFrame, key: str = KEY) -> DataFrame:
    """One row per distinct record: the one with the smallest key. Partial aggregation
    collapses copies before the shuffle, however many a record has."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(*rest).agg(F.min(key).alias(key)).select(*df.columns)


def without_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def cleaned(df: DataFrame, key: str = KEY) -> DataFrame:
    out = without_nulls(
        without_duplicates(df, key), [c for c in (*POLICY_COLUMNS, TARGET) if c in df.columns])
    if out.isEmpty():
        raise ValueError("no rows are left after cleaning")
    return out


def duplicate_count(df: DataFrame, key: str = KEY) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(*rest).agg(F.count(F.lit(1)).alias("n")).agg(
        F.sum(F.col("n") - 1).alias("duplicates"), F.sum("n").alias("n_rows"))


def quality_profile(df: DataFrame, key: str = KEY, target: str = TARGET) -> DataFrame:
    """One row per column: nulls, and for the target its distribution."""
    columns = [c for c in df.columns if c != key]
    copies = duplicate_count(df, key).first()
    wide = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns],
        F.min(target).alias("min"), F.max(target).alias("max"), F.avg(target).alias("mean"),
        F.stddev_samp(target).alias("std"))
    stats = {"min": F.col("min"), "max": F.col("max"), "mean": F.col("mean"),
             "median": F.lit(median(df, target)), "std": F.col("std")}
    nothing = F.lit(None).cast("double")
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column"), "n_rows", F.col(f"nulls_{c}").alias("nulls"),
            (F.col(f"nulls_{c}") * 100.0 / F.col("n_rows")).alias("null_pct"),
            F.lit(copies["duplicates"]).alias("duplicates"),
            *[(value if c == target else nothing).alias(name) for name, value in stats.items()])
        for c in columns])
    return wide.select(F.inline(rows))


def describe(df: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """Per numeric column: count, mean, sample deviation, extremes and exact quartiles."""
    cuts = column_quantiles(df, columns, QUARTILES)
    stats = melt(df, columns).groupBy("feature").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return stats.select(
        "feature", "count", "mean", "std", "min",
        *[lookup("feature", {c: cuts[c][i] for c in columns}).alias(q) for i, q in enumerate(("q25", "q50", "q75"))],
        "max")


def value_counts(df: DataFrame, columns: Sequence[str] = CATEGORIES) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def filled(df: DataFrame) -> DataFrame:
    """Records completed with defaults, listing what was imputed."""
    fixed = checks.filled_record()
    keep = [F.col(c) for c in df.columns if c not in fixed]
    missing = checks.imputed_fields().alias("imputed_fields")
    return df.select(*keep, missing, *[v.alias(k) for k, v in fixed.items()]).withColumn(
        "status", F.when(F.col("imputed_fields") == "", "success").otherwise("success_with_imputation"))


def unsafe_cells(df: DataFrame, key: str = KEY) -> DataFrame:
    """Rows with a cell that could run as a formula; an unsafe header flags every row."""
    if any(checks.unsafe_header(c) for c in df.columns):
        return df.select(key, F.lit("<header>").alias("columns"))
    text = [name for name, kind in df.dtypes if kind == "string"]
    hits = F.concat_ws(",", *[F.when(checks.unsafe_cell(c), F.lit(c)) for c in text])
    return df.select(key, hits.alias("columns")).where(F.col("columns") != "")
