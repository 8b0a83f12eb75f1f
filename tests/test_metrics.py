import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratebook.config import GATE_TIERS
from ratebook.functions import moments as m
from ratebook.operators import drift, gates, metrics


def test_one_row_segment_has_no_r2(scored_frame):
    row = metrics.accuracy_report(scored_frame((5000, 5100))).first()
    assert row["r2"] is None and row["rmse"] == pytest.approx(100.0)


def test_constant_target(scored_frame):
    assert metrics.accuracy_report(scored_frame((5, 5), (5, 5))).first()["r2"] == 1.0
    assert metrics.accuracy_report(scored_frame((5, 5), (5, 6))).first()["r2"] == 0.0


def test_log_error_switches_with_non_positive_values(scored_frame):
    row = scored_frame((0, 1), (9, 9)).agg(m.male("y_true", "price").alias("x")).first()
    assert row["x"] == pytest.approx(math.log(2) / 2)


def test_gate_tier_edges(scored_frame):
    df = scored_frame(*[(y, y) for y in (-1, 0, 5000, 5000.01, 10000, 14000, 16701, 16701.01)])
    got = [r["t"] for r in df.orderBy("policy_id").select(metrics.tier("y_true", GATE_TIERS).alias("t")).collect()]
    assert got == [None, "Low", "Low", "Mid", "Mid", "High", "High+", "Very High"]


def test_segments_skip_rows_outside(scored_frame):
    rows = metrics.gate_segment_report(scored_frame((-1, 5), (100, 100), (200, 220))).collect()
    assert [(r["segment"], r["n"]) for r in rows] == [("Low", 2)]


def test_tier_table_lists_empty_tiers(scored_frame):
    rows = metrics.tier_table(scored_frame(*[(100 + i, 100) for i in range(4)]), GATE_TIERS).orderBy("position").collect()
    assert [r["n"] for r in rows] == [4, 0, 0, 0, 0] and all(r["r2"] is None for r in rows)


def test_calibration_table_keeps_the_largest_prediction(scored_frame):
    df = scored_frame(*[(i, i) for i in range(100)])
    assert metrics.calibration_table(df).agg(F.sum("n")).first()[0] == 100


@pytest.mark.parametrize("partitions", [None, 1, 7, 200])
@pytest.mark.parametrize("order", ["k", ["hot", "k"]])
def test_durbin_watson_any_slicing(spark, partitions, order):
    rng = np.random.default_rng(0)
    e = rng.normal(size=500)
    df = spark.createDataFrame([(int(i * 3), float(v)) for i, v in enumerate(e)], "k long, e double").withColumn("hot", F.lit(7)).repartition(5)
    got = metrics.durbin_watson(df, order, "e", partitions).first()["durbin_watson"]
    assert got == pytest.approx(np.sum(np.diff(e) ** 2) / np.sum(e**2))


def test_weighted_r2(scored_frame):
    pairs = [(4000, 4100), (8000, 7000), (12000, 12500), (15000, 15100), (30000, 28000)]
    y, p = np.array(pairs, float).T
    w = np.array([1, 1.5, 2.5, 3.2, 4])
    mu = np.average(y, weights=w)
    want = 1 - np.sum(w * (y - p) ** 2) / np.sum(w * (y - mu) ** 2)
    assert metrics.weighted_r2(scored_frame(*pairs)).first()["weighted_r2"] == pytest.approx(want)


def test_veto_needs_rows_and_spread(scored_frame):
    broad = [(3000 + 100 * (i % 2), 30000) for i in range(40)]  # spread below 2,000: advisory only
    row = gates.weighted_r2_gate(scored_frame(*broad, *[(20000 + i, 20000 + i) for i in range(40)])).first()
    assert row["veto_segments"] == "" and row["advisory_segments"] == "Low" and row["critical_segments"] == "Low"
    wide = [(1000 + 3800 * (i % 2), 40000) for i in range(40)]
    assert gates.weighted_r2_gate(scored_frame(*wide)).first()["advisory_segments"] == "Low"
    wide = [(i * 125, 40000) for i in range(40)]
    assert gates.weighted_r2_gate(scored_frame(*wide)).first()["passed"] is False


def test_sweep_settings():
    names = [c["name"] for c in metrics.sweep_configs()]
    assert len(names) == 28 == len(set(names))


def test_tiny_batch_reports_no_drift(policy_frame):
    base = drift.numeric_baseline(policy_frame({}, {"age": 50, "bmi": 30.0, "children": 2, "charges": 1.0}))
    assert drift.numeric_drift(policy_frame({}), base).isEmpty()


def test_missing_features_are_listed(policy_frame):
    assert drift.missing_features(policy_frame({}).drop("bmi", "sex")) == ["bmi", "sex"]


def test_mape_of_a_batch_with_zero_is_null(scored_frame):
    df = scored_frame((0, 1), (5, 5)).withColumn("batch", F.lit(1))
    assert drift.snapshots(df, "batch").first()["mape"] is None


def test_no_thresholds_no_degradation(scored_frame):
    df = scored_frame((4, 1), (5, 5)).withColumn("batch", F.lit(1))
    assert drift.degradation(drift.snapshots(df, "batch"), "batch").first()["degraded"] is False
