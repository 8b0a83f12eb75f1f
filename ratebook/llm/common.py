"""Shared pieces of the corpus operators: working folders, cut lineage, connected components."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ratebook.session import shared_dir, work_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def bounded_batches(df: DataFrame, rows: int = 500, size: int = 8 << 20) -> None:
    """Whole texts go to Python in Arrow batches of at most ``rows`` and about ``size`` bytes, so that a worker holds few
    of them at a time. A session that sets its own limit of rows below the default keeps it."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) in (0, 10000):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The frame, written once to the shared folder and read back: lineage ends there and survives lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(os.path.join(shared_dir(df.sparkSession), "checkpoints"))
    return df.checkpoint()


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list and the smallest node each is connected with, by label passing and pointer jumping."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[:len(u)], ends[len(u):]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            nearer = label[label]
            if np.array_equal(nearer, label):
                break
            label = nearer
        if np.array_equal(before, label):
            break
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[label]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        nodes, low = roots(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        keep = nodes != low
        yield pd.DataFrame({"u": low[keep], "v": nodes[keep]})


def connected_components(edges: DataFrame, most_rounds: int = 50, contract: bool = True) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the smallest node reachable.

    Alternating large-star and small-star steps, each a grouped minimum and a join, so no node's
    neighbours meet in one task: minima are combined before the shuffle, and joins on a node of huge
    degree are split at run time. Every round is checkpointed. Edges are first contracted within
    each Arrow batch, which keeps what they connect; ``contract`` is false where their maker has done so. Null ends
    and loops are ignored.
    """
    e = (edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
         .where("u IS NOT NULL AND v IS NOT NULL AND u <> v"))
    e = checkpointed((e.mapInPandas(_contract, "u long, v long") if contract else e).distinct())
    seen = None
    for _ in range(most_rounds):
        # Large star: every larger neighbour of u goes to the smallest of u and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("m").alias("u"), "v").distinct()
        # Small star: the smaller neighbours of v, and v itself, go to the smallest of them.
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(
            F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("u").alias("v")),
                              F.struct(F.col("m").alias("u"), F.col("v").alias("v")))).alias("e"))
        e = checkpointed(small.select("e.*").where("u <> v").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    # Settled edges are stars: every node but the centre is a v exactly once.
    return (e.select(F.col("v").alias("node"), F.col("u").alias("root"))
            .unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()))
