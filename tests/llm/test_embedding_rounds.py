"""Groups of blocks that meet in rounds: the links of all pairs, with disk that follows the vectors and not their pairs."""

import os
import threading
import time

import numpy as np
import pytest

from ratebook.llm import embedding_join
from ratebook.llm.common import roots


def frame(spark, x, kind):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"vec_id long, embedding array<{kind}>")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_all_pairs_meet_once(spark, monkeypatch, kind):
    """Small groups and small rounds; equal vectors, some of them in several batches."""
    monkeypatch.setattr(embedding_join, "_GROUP", 1 << 9)
    monkeypatch.setattr(embedding_join, "_ROUND", 1)
    monkeypatch.setattr(embedding_join, "_HELD", 10)
    monkeypatch.setattr(embedding_join, "_TASKS", 1)
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(20, 6)).repeat(8, axis=0) + rng.normal(size=(160, 6)) * 0.2).astype(np.float32)
    x = np.concatenate([x, x[:5], x[:3]])
    got = embedding_join.near_duplicates(frame(spark, x, kind).repartition(3), leading=2, block_rows=20, leaf=4).orderBy("vec_id").collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert [r.n_links for r in got] == near.sum(axis=1).tolist()
    low = np.arange(len(x))
    of, to = roots(*np.nonzero(near))
    low[of] = to
    assert [r.component_id for r in got] == low.tolist()
    assert [r.kept for r in got] == (low == np.arange(len(x))).tolist()


def test_disk_follows_the_vectors(spark, monkeypatch):
    """Vectors whose directions are all alike, so nearly every pair of blocks is compared: 1 MB in 63 blocks."""
    monkeypatch.setattr(embedding_join, "_ROUND", 1, raising=False)
    monkeypatch.setattr(embedding_join, "_TASKS", 1, raising=False)
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def used():
        total = 0
        for folder, _, files in (x for d in dirs for x in os.walk(d)):
            for f in files:
                try:
                    total += os.stat(os.path.join(folder, f)).st_size
                except OSError:  # gone meanwhile
                    pass
        return total

    df = frame(spark, np.random.default_rng(2).normal(size=(2000, 64)), "double")
    peak, over, before = [0], threading.Event(), used()

    def watch():
        while not over.is_set():
            peak[0] = max(peak[0], used() - before)
            time.sleep(0.05)

    watcher = threading.Thread(target=watch)
    watcher.start()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    try:
        assert embedding_join.near_duplicates(df, block_rows=32).count() == 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        over.set()
        watcher.join()
    assert peak[0] < 12e6
