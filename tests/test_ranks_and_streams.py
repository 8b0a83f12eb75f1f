"""Global ranks, encodings of many classes, normal scores and the newest requests of a stream."""

import math
import random
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ratebook.functions.normal import normal_quantile
from ratebook.operators import encoders, ranks, transforms
from ratebook.streaming import latest


@pytest.mark.parametrize("ranges", [1, 5, None])
def test_ranks_of_tied_groups(spark, ranges):
    draw = random.Random(1)
    rows = [(draw.choice("ab"), draw.choice([1.5, -0.0, 0.0, 7.0, None, float("nan"), draw.random()])) for _ in range(500)] + [("c", None)]
    got = {(r["g"], r["v"]): (r["n"], r["before"], r["number"]) for r in
           ranks.ranked_values(spark.createDataFrame(rows, "g string, x double"), "x", ["g"], ranges).collect()}
    want = {}
    for g in "ab":
        values = sorted(v for k, v in rows if k == g and v is not None and not math.isnan(v))
        for i, v in enumerate(sorted(set(values))):
            want[g, v] = (values.count(v), sum(x < v for x in values), i)
    assert got == want


def test_normal_scores(spark):
    ps = [1e-9, 0.001, 0.02, 0.024, 0.025, 0.3, 0.5, 0.7, 0.98, 0.999999]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0]], "p double").select(normal_quantile(F.col("p")).alias("z")).collect()
    assert [r["z"] for r in got[-2:]] == [None, None]
    for p, r in zip(ps, got):
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(p), abs=1e-8)


def test_normality_of_samples(spark):
    rng = np.random.default_rng(2)
    w = {}
    for name, x in (("normal", rng.normal(size=800) * 3 + 1e6), ("skewed", rng.exponential(size=800)), ("flat", np.ones(10)), ("two", np.arange(2.0))):
        df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(6)
        w[name] = ranks.shapiro_francia(df, "x").first()
    assert w["normal"]["w"] > 0.99 > 0.9 > w["skewed"]["w"] and w["flat"]["w"] is None and w["two"]["w"] is None
    x = np.sort(rng.exponential(size=100))
    m = [NormalDist().inv_cdf((i - 0.375) / 100.25) for i in range(1, 101)]
    got = ranks.shapiro_francia(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").first()
    assert got["w"] == pytest.approx(np.corrcoef(x, m)[0, 1] ** 2, rel=1e-7) and got["n"] == 100
    assert ranks.shapiro_francia(spark.createDataFrame([], "x double"), "x").first()["w"] is None


def test_fifty_thousand_classes(spark):
    df = spark.range(50_000).select(F.format_string("c%06d", "id").alias("shop"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("kind"))
    df = df.unionByName(spark.createDataFrame([("c000007", "y"), (None, None)], "shop string, kind string"))
    fit = transforms.LabelEncoder.fit(df, ["shop", "kind"])
    assert isinstance(fit, encoders.TableEncoder)
    probe = spark.createDataFrame([(1, "c049999", "x"), (2, "unseen", "y"), (3, None, None)], "id int, shop string, kind string")
    assert [tuple(r) for r in fit.transform(probe).orderBy("id").collect()] == [(1, 49_999, 0), (2, 7, 1), (3, 7, 1)]
    hot = transforms.OneHot.fit(df, ["shop", "kind"])
    assert hot.sizes == {"shop": 49_999, "kind": 1}
    assert [tuple(r) for r in hot.transform(probe).orderBy("id").collect()] == [(1, 49_998, None), (2, None, 0), (3, None, None)]


def test_few_classes_by_table_are_the_same(spark, policy_frame):
    df = policy_frame({"sex": "female"}, {"smoker": "yes"}, {}, {"region": "southwest"})
    a, b = (transforms.LabelEncoder.fit(df, most=n).transform(df).orderBy("policy_id").collect() for n in (10_000, 0))
    assert a == b


class Handle:
    """State of one key in memory."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_ring_keeps_the_newest_in_time_order():
    ring = latest.NewestRequests(["lane"], 3, 50)
    ring.init(Handle())
    give = lambda *rows: next(ring.handleInputRows((4,), iter([pd.DataFrame(rows, columns=["ts", "id", "latency"])]), None)).iloc[0]
    assert give((30, 1, 1.0), (10, 2, 2.0))["id"] == [2, 1]
    assert give((20, 3, 3.0), (40, 4, 4.0))["id"] == [3, 1, 4]  # the oldest fell out, a late one found its place
    assert give((40, 4, 4.0))["id"] == [3, 1, 4]  # delivered again
    last = give((85, 5, None))
    assert last["id"] == [4, 5] and last["seen"] == 6 and last["lane"] == 4  # 30 is more than 50 before 85


def test_figures_survive_a_restart(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, draw.randint(0, 10 ** 6), draw.random(), draw.choice("ab")) for i in range(3000)]
    schema = "event_id long, s long, latency double, kind string"
    root, source = str(tmp_path / "root"), str(tmp_path / "in")
    for part in (rows[:1200], rows[1200:1300] + rows[100:300], rows[1300:]):  # some are delivered again
        spark.createDataFrame(part, schema).coalesce(2).write.mode("append").parquet(source)
        log = spark.readStream.schema(schema).parquet(source).withColumn("ts", F.timestamp_seconds("s"))
        buffers = latest.followed(latest.newest_requests(log, ["kind"], size=200, lanes=4), root, ["kind", "lane"])
    got = {r["kind"]: r for r in latest.latest_figures(buffers, ["kind"], 200).collect()}
    for kind in "ab":
        last = [r[2] for r in sorted((r for r in rows if r[3] == kind), key=lambda r: (-r[1], -r[0]))[:200]]
        assert got[kind]["samples"] == 200 and got[kind]["mean"] == pytest.approx(np.mean(last))
        assert [got[kind][p] for p in ("p50", "p95", "p99")] == pytest.approx(np.quantile(last, [0.5, 0.95, 0.99]).tolist())
    assert spark.conf.get(latest._STORE, "") != latest._ROCKS
