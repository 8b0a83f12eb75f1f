"""Reading and writing policy tables, reports and fitted parameters."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StringType, StructField, StructType

from ratebook.config import POLICY_COLUMNS
from ratebook.operators.validation import require_columns
from ratebook.sources.portfolio import POLICY_SCHEMA


def read_policies(spark: SparkSession, path: str, fmt: str = "csv", schema=POLICY_SCHEMA) -> DataFrame:
    """A policy table with an explicit schema (no inference pass). A missing path, an empty table or a
    missing column is an error. CSV columns go by the names in the header, in any order; others are left out."""
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path)
        require_columns(header, POLICY_COLUMNS)
        kinds = {f.name: f.dataType for f in schema.fields}
        found = StructType([StructField(c, kinds.get(c, StringType())) for c in header.columns])
        df = (spark.read.schema(found).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
              .select(*(c for c in kinds if c in header.columns)))
    else:
        df = spark.read.format(fmt).load(path)
        require_columns(df, POLICY_COLUMNS)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def write_policies(df: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_scored(df: DataFrame, path: str, fmt: str = "parquet", partition: str = "status") -> None:
    """Scored rows in one folder per status, so that failed rows can be read on their own."""
    df.write.mode("errorifexists").partitionBy(partition).format(fmt).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report table as CSV."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_state(spark: SparkSession, state: dict, path: str) -> None:
    """Fitted parameters as one JSON row."""
    spark.createDataFrame([(json.dumps(state),)], "value string").write.mode("errorifexists").text(path)


def read_state(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


BIAS_KEYS = ("var_low", "var_mid", "var_high", "threshold", "threshold_low", "threshold_high")
_PARAMS = ", ".join(f"{k}: double" for k in BIAS_KEYS)
BIAS_SCHEMA = (
    f"name string, applied boolean, correction_params struct<{_PARAMS}>, "
    + ", ".join(f"{k} double" for k in BIAS_KEYS)
    + ", _bias_var_low double, _bias_var_high double, _bias_threshold double")


def read_bias(spark: SparkSession, path: str) -> DataFrame:
    """Bias corrections in any stored form: plain, three-tier, wrapped or with legacy keys.

    A wrapper that says it was not applied gives no row; a three-tier form without a plain
    threshold takes its lower one.
    """
    raw = spark.read.schema(BIAS_SCHEMA).json(path).where(F.coalesce("applied", F.lit(True)))

    def found(key: str, legacy: str | None = None):
        options = [F.col(f"correction_params.{key}"), F.col(key)] + ([F.col(legacy)] if legacy else [])
        return F.coalesce(*options)

    return raw.select(
        "name", found("var_low", "_bias_var_low").alias("var_low"), found("var_mid").alias("var_mid"),
        found("var_high", "_bias_var_high").alias("var_high"),
        F.coalesce(found("threshold", "_bias_threshold"), found("threshold_low"), F.lit(0.0)).alias("threshold"),
        found("threshold_low").alias("threshold_low"), found("threshold_high").alias("threshold_high"),
    ).where(F.col("var_low").isNotNull())
