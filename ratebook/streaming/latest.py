"""Latency figures over the newest requests of a stream, exact at any moment.

Requests are dealt to lanes by a hash of their id, so that no task sees them all. Each lane keeps its newest requests in
event-time order as keyed state; the newest of all are among those of the lanes. A request that is delivered again
finds itself in the buffer and is not counted twice there.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_RING = "ts array<long>, id array<long>, latency array<double>, seen long"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestRequests(StatefulProcessor):
    """The newest ``size`` requests of a lane; those older than ``keep`` microseconds before the newest one go."""

    def __init__(self, keys: Sequence[str], size: int, keep: int | None):
        self.keys, self.size, self.keep = list(keys), size, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", _RING)

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        held = self.ring.get() if self.ring.exists() else ([], [], [], 0)
        parts = [pd.DataFrame({"ts": np.array(held[0], np.int64), "id": np.array(held[1], np.int64), "latency": np.array(held[2], float)})]
        seen = int(held[3])
        for pdf in rows:
            seen += len(pdf)
            parts.append(self._cut(pdf[["ts", "id", "latency"]]))
        now = self._cut(pd.concat([p for p in parts if len(p)] or parts[:1], ignore_index=True))
        lists = tuple(now[c].tolist() for c in ("ts", "id", "latency"))
        self.ring.update((*lists, seen))
        yield pd.DataFrame({**{n: [k] for n, k in zip(self.keys, key)}, "seen": [seen], "ts": [lists[0]], "id": [lists[1]], "latency": [lists[2]]})

    def _cut(self, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["ts", "id"]).sort_values(["ts", "id"]).tail(self.size)
        return rows if self.keep is None or not len(rows) else rows[rows["ts"] >= rows["ts"].iloc[-1] - self.keep]

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    """Keyed state of this kind lives in RocksDB; the session keeps its own setting afterwards."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def newest_requests(log: DataFrame, by: Sequence[str] = (), size: int = 1000, lanes: int = 16, keep_days: float | None = None) -> DataFrame:
    """A stream of (by, lane, seen, ts, id, latency): a lane's buffer whenever it has changed. ``log`` has event_id, ts
    and latency; rows without an id or time are left out, a null latency takes its place and has no figure."""
    lane = F.pmod(F.xxhash64("event_id"), F.lit(lanes)).cast("int")
    rows = log.where("event_id IS NOT NULL AND ts IS NOT NULL").select(
        *by, lane.alias("lane"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").cast("long").alias("id"),
        F.col("latency").cast("double").alias("latency"))
    keys = [*by, "lane"]
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    keep = None if keep_days is None else int(keep_days * 86_400_000_000)
    return rows.groupBy(*keys).transformWithStateInPandas(
        NewestRequests(keys, size, keep), f"{kinds}, seen long, ts array<long>, id array<long>, latency array<double>", "Update", "None")


def followed(stream: DataFrame, root: str, keys: Sequence[str] = ("lane",)) -> DataFrame:
    """Run over all input there is, from where the checkpoint below ``root`` stands; the last buffer of every lane."""
    spark = stream.sparkSession

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(root, "updates", f"batch={number}"))

    with _state_store(spark):
        job = (stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", os.path.join(root, "checkpoint"))
               .trigger(availableNow=True).start())
        job.awaitTermination()
    updates = spark.read.parquet(os.path.join(root, "updates"))
    columns = [c for c in updates.columns if c != "batch"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*columns), "batch").alias("r")).select("r.*")


def latest_figures(buffers: DataFrame, by: Sequence[str] = (), size: int = 1000) -> DataFrame:
    """Samples, mean and exact percentiles over the newest ``size`` requests of all lanes (per ``by``)."""
    entries = buffers.select(*by, F.inline(F.arrays_zip("ts", "id", "latency")))
    # Not more than lanes x size rows per group.
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("ts"), F.desc("id"))
    newest = entries.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size)
    return newest.groupBy(*by).agg(F.count("latency").alias("samples"), F.avg("latency").alias("mean"),
                                   *[F.percentile("latency", p).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
