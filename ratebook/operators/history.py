"""Metric history that an evaluation written twice does not count twice.

Entries lie in folders period / evaluation. Writing replaces exactly the folders it has entries for, so a retry
changes nothing. Old periods are compacted into one folder each; what is evaluated again later takes precedence.
"""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIVE, COMPACT = "live", "compact"


def _written(df: DataFrame, path: str, *folders: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)


def _part(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def upsert(entries: DataFrame, path: str) -> None:
    """Writes the entries of some evaluations; ``period`` (a string that sorts by time) and ``evaluation`` name their
    folder. An evaluation is written whole: what it wrote before in that period is replaced."""
    if {"period", "evaluation"} - set(entries.columns):
        raise ValueError("entries need a period and an evaluation")
    # One file per evaluation: its entries are few.
    _written(entries.repartition("period", "evaluation"), os.path.join(path, LIVE), "period", "evaluation")


def read(spark: SparkSession, path: str, schema: str, since: str | None = None) -> DataFrame:
    """All entries, or those from a period on: only the folders of these periods are listed and read. ``schema`` names
    every column, period and evaluation as strings."""
    live, compact = (_part(spark, os.path.join(path, p), schema) for p in (LIVE, COMPACT))
    if since is not None:
        live, compact = (p.where(F.col("period") >= since) for p in (live, compact))
    again = live.select("period", "evaluation").distinct()
    return live.unionByName(compact.join(again, ["period", "evaluation"], "left_anti"))


def compact(spark: SparkSession, path: str, schema: str, before: str) -> None:
    """Puts the periods before ``before`` into one folder each and removes their evaluations' own folders.

    A run that ends in between leaves both; the entries still count once.
    """
    live = _part(spark, os.path.join(path, LIVE), schema).where(F.col("period") < before)
    periods = [r["period"] for r in live.select("period").distinct().collect()]
    if not periods:
        return
    # The replaced folders are read too, so the new ones are stored apart first.
    staged = os.path.join(path, "staged")
    whole = read(spark, path, schema).where(F.col("period").isin(periods))
    whole.repartition("period").write.mode("overwrite").parquet(staged)
    _written(spark.read.schema(whole.schema).parquet(staged).repartition("period"), os.path.join(path, COMPACT), "period")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in [staged, *(os.path.join(path, LIVE, f"period={p}") for p in periods)]:
        place = jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(conf).delete(place, True)


def newest(spark: SparkSession, path: str, schema: str, order: str, keep: int = 100) -> DataFrame:
    """The newest entries by ``order``, which must not fall from period to period. Periods are taken from the newest
    on until they hold enough; older folders are not read."""
    live, compacted = (_part(spark, os.path.join(path, p), schema) for p in (LIVE, COMPACT))
    periods = sorted({r["period"] for p in (live, compacted) for r in p.select("period").distinct().collect()}, reverse=True)
    since, held = None, 0
    for since in periods:
        held += read(spark, path, schema, since).where(F.col("period") == since).count()
        if held >= keep:
            break
    return read(spark, path, schema, since).orderBy(F.desc(order)).limit(keep)
