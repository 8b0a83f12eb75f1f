"""Streaming scoring: each micro-batch is validated, priced and written to two sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.functions import checks, features
from ratebook.functions.pricing import actuarial_premium
from ratebook.operators.validation import checked
from ratebook.session import work_path


def scored_records(raw: DataFrame, key: str = "policy_id") -> DataFrame:
    """Status, errors and, for good records, risk score and premium: all in one projection."""
    rows = checked(raw)
    good = F.col("status") == "success"
    typed = rows.select(
        key, "status", F.concat_ws("|", "errors").alias("error"), checks.as_int("age").alias("age"),
        checks.as_number("bmi").alias("bmi"), checks.as_int("children").alias("children"),
        checks.normal("smoker").alias("smoker"), checks.normal("region").alias("region"))
    return typed.select(
        key, "status", F.when(~good, F.col("error")).alias("error"),
        F.when(good, features.risk_score()).alias("risk_score"), F.when(good, actuarial_premium()).alias("premium"))


def run(raw: DataFrame, key: str = "policy_id") -> tuple[DataFrame, DataFrame]:
    """Score a stream of raw records; returns the (scored, quarantined) tables it wrote.

    A batch writes under its own number: a rerun replaces its files and adds none twice.
    """
    spark = raw.sparkSession
    root = work_path(spark, "scoring")

    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for status, folder in (("success", "scored"), ("error", "quarantine")):
                batch.where(F.col("status") == status).write.mode("overwrite").parquet(
                    os.path.join(root, folder, f"batch={number}"))
        finally:
            batch.unpersist()

    job = (
        scored_records(raw, key).writeStream.outputMode("append").foreachBatch(store)
        .option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True).start())
    job.awaitTermination()

    def table(folder: str) -> DataFrame:
        return spark.read.parquet(os.path.join(root, folder)).drop("batch")

    return table("scored"), table("quarantine")
