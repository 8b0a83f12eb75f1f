"""Streaming monitors: drift and request metrics per event-time window.

State holds one row of counts and moments per open window; the watermark bounds how
long a window stays open. Updates are written per micro-batch under the batch's number,
so a batch that runs again after a failure replaces its own files.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.operators.drift import TVD_LIMIT, Z_LIMIT
from ratebook.operators.splits import stored
from ratebook.session import work_path


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream over the files of one table, a folder of part files or a single file; the schema comes from them."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def timed(stream: DataFrame, column: str = "ts") -> DataFrame:
    """A zone-free time as the instant with the same clock time in UTC: event time needs
    instants, and day windows are cut in UTC whatever zone the session uses."""
    if dict(stream.dtypes)[column] != "timestamp_ntz":
        return stream
    return stream.withColumn(column, F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))


def utc_day(instant) -> Column:
    return F.date_format(F.to_utc_timestamp(instant, F.current_timezone()), "yyyy-MM-dd")


def event_baseline(events: DataFrame) -> dict:
    """Mean and sample deviation of a reference period, and its category shares as a table (event_type, share), of any
    number of categories; null is one of its own."""
    row = events.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n")).first()
    shares = events.groupBy("event_type").agg((F.count(F.lit(1)) / F.lit(max(1, row["n"]))).alias("share"))
    return {"mean": row["mean"], "std": row["std"], "shares": stored(shares, "shares")}


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and category: all the state that a drift monitor needs, a row for each."""
    counts = timed(events).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.count(F.lit(1)).alias("rows"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n", "total", "rows")


def drift_figures(counts: DataFrame, baseline: dict) -> DataFrame:
    """z of the mean and total variation of the categories, per window, from its counts.

    A category that the window lacks differs by its whole share, so what the present ones leave of the baseline is
    added at once.
    """
    sizes = counts.groupBy("window_start").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("rows").alias("all"))
    shares = baseline["shares"].withColumnRenamed("event_type", "_type")
    known = counts.join(shares, F.col("event_type").eqNullSafe(F.col("_type")), "left").join(sizes.select("window_start", "all"), "window_start")
    share = F.coalesce("share", F.lit(0.0))
    gaps = known.groupBy("window_start").agg(
        ((F.sum(F.abs(F.col("rows") / F.col("all") - share)) + 1.0 - F.sum(share)) * 0.5).alias("tvd"))
    mean = F.col("total") / F.col("n")
    z = F.abs(mean - F.lit(baseline["mean"])) / (F.lit(baseline["std"]) / F.sqrt(F.col("n").cast("double")) + 1e-10)
    return sizes.join(gaps, "window_start").select(
        "window_start", "n", F.try_divide("total", "n").alias("new_mean"), F.when(F.col("n") >= 2, z).alias("z"), "tvd",
    ).withColumns({"mean_drifted": F.coalesce(F.col("z") > Z_LIMIT, F.lit(False)), "mix_drifted": F.col("tvd") > TVD_LIMIT})


def windowed_requests(log: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    served = ~F.col("rejected")
    latency = F.when(served, F.col("latency"))
    return timed(log).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w")).agg(
        F.count_if(served).alias("total"), F.count_if(served & ~F.col("ok")).alias("errors"),
        F.count_if("rejected").alias("rejected"), F.avg(latency).alias("mean"),
        *[F.percentile_approx(latency, p, 1000).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))],
    ).select(F.col("w.start").alias("window_start"), "total", "errors", "rejected",
             (F.try_divide("errors", "total") * 100.0).alias("error_pct"), "mean", "p50", "p95", "p99")


def drained(stream: DataFrame, name: str, *key: str) -> DataFrame:
    """Run a windowed stream over all input there is and return the last update of every window (or other key)."""
    spark = stream.sparkSession
    root = work_path(spark, name)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(root, "updates", f"batch={number}"))

    job = (
        stream.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", os.path.join(root, "checkpoint")).trigger(availableNow=True).start())
    job.awaitTermination()
    updates = spark.read.parquet(os.path.join(root, "updates"))
    columns = [c for c in updates.columns if c != "batch"]
    latest = updates.groupBy(*(key or ["window_start"])).agg(F.max_by(F.struct(*columns), "batch").alias("r"))
    return latest.select("r.*")
