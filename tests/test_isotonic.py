"""The merge tree of the isotonic fit against pooling in one place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratebook.operators import isotonic as iso


def frame(spark, x, y):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, p double, y_true double")


def plain(x, y):
    """(lo, hi, v) of the blocks by pooling all points."""
    ux, at = np.unique(x, return_inverse=True)
    s, w = np.bincount(at, y), np.bincount(at).astype(float)
    lo, hi, s, w = iso.pooled(ux, s, w)
    v = s / w
    assert (np.diff(v) > 0).all()
    return lo, hi, v


def interpolated(lo, hi, v, x):
    return np.interp(x, np.column_stack([lo, hi]).ravel(), np.repeat(v, 2))


def shapes():
    rng = np.random.default_rng(0)
    n = 400
    x = rng.permutation(n).astype(float)
    yield "noise", x, rng.normal(size=n)
    yield "rising", x, x * 0.01 + rng.normal(size=n)
    yield "strictly rising", x, x * 3
    yield "falling", x, -x
    yield "saw", x, x % 50
    yield "two hills", x, np.where(x < n / 2, x, x - n / 2) + rng.normal(size=n) * 0.1
    yield "steps", x, np.floor(x / 40) % 3
    yield "few values", np.floor(x / 57), rng.normal(size=n).round(1)
    yield "one value", np.ones(n), rng.normal(size=n)
    yield "outlier", x, np.where(x == 399, -1e6, x) + np.where(x == 0, 1e6, 0)


@pytest.mark.parametrize("name, x, y", list(shapes()), ids=[s[0] for s in shapes()])
def test_same_steps_as_in_one_place(spark, name, x, y):
    df = frame(spark, x, y).repartition(4)
    lo, hi, v = plain(x, y)
    at = np.r_[x, [-5.0, 500.0, 10.5, 0.25, 133.7]]
    probe = frame(spark, at, at)
    for ranges in (1, 6):
        fit = iso.IsotonicCalibrator.fit(df, "p", ranges=ranges)
        got = np.array(sorted(tuple(r) for r in fit.steps().collect()))
        assert fit.n == len(x) and np.allclose(np.interp(at, *[np.column_stack([got[:, 0], got[:, 1]]).ravel(), np.repeat(got[:, 2], 2)]),
                                               interpolated(lo, hi, v, at), rtol=1e-9, atol=1e-9)
    out = fit.transform(probe, "c", 20).orderBy("id").collect()  # many tasks per range
    assert np.allclose([r["c"] for r in out], interpolated(lo, hi, v, at), rtol=1e-9, atol=1e-9)


def test_odd_predictions(spark):
    df = frame(spark, np.arange(60), np.arange(60) * 2)
    fit = iso.IsotonicCalibrator.fit(df, "p", ranges=4)
    probe = spark.createDataFrame([(1, None, "a"), (2, float("nan"), "a"), (3, 30.5, "a"), (3, 30.5, "a")], "id long, p double, _note string")
    assert sorted([(r["id"], r["c"]) for r in fit.transform(probe, "c").collect()], key=str) == [(1, None), (2, 118.0), (3, 61.0), (3, 61.0)]
    assert fit.transform(probe.limit(0), "c").count() == 0
    with pytest.raises(ValueError):
        iso.IsotonicCalibrator.fit(df.limit(20), "p")
    with pytest.raises(ValueError):
        iso.IsotonicCalibrator.fit(df.limit(0), "p")


def test_driver_receives_little_of_a_million_points(spark):
    n = 10 ** 6
    df = spark.range(n, numPartitions=8).select("id", F.col("id").cast("double").alias("p"), (F.col("id") + F.col("id") % 3).cast("double").alias("y_true"))
    fit = iso.IsotonicCalibrator.fit(df, "p", ranges=8)
    assert fit.n == n and fit.blocks.count() > n / 2 and fit.received < 1000
    out = fit.transform(df, "c")
    assert out.where("abs(c - p) > 2").count() == 0 and out.count() == n
    # Two rising halves of the same values: half of all points pool across the middle.
    halves = df.select("p", F.pmod(F.col("id"), F.lit(n // 2)).cast("double").alias("y_true"))
    fit = iso.IsotonicCalibrator.fit(halves, "p", ranges=8)
    low = n // 4
    steps = fit.steps().where(f"hi > {low} AND lo < {3 * low}").collect()
    assert fit.received < 5000 and max(r["hi"] - r["lo"] for r in steps) >= n // 2 - 4
