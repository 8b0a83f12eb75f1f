import math

import pytest
from pyspark.sql import functions as F

from ratebook.config import Blend
from ratebook.functions import pricing as fx
from ratebook.operators import pricing as op


def test_unknown_region_has_no_factor(policy_frame):
    rows = policy_frame({"region": "nowhere"}, {"region": " NorthEast "}).select(fx.actuarial_premium().alias("p")).collect()
    assert rows[1]["p"] == pytest.approx(rows[0]["p"] * 1.05)


def test_weight_can_leave_the_unit_interval(spark):
    """Learned 1,000 against actuarial 13,000: the weight is 2.65 and the floor decides."""
    df = spark.createDataFrame([(1000.0, 13000.0)], "ml_pred double, act_pred double")
    row = op.blended(df).first()
    assert row["weight"] == pytest.approx(2.65) and row["blended"] == pytest.approx(750.0)
    assert op.blended(df, Blend(clamp_weight=True)).first()["weight"] == 1.0


@pytest.mark.parametrize("act,zone", [(6500.0, "actuarial_dominant"), (6500.01, "transition"), (9999.0, "ml_only")])
def test_zone_edges(spark, act, zone):
    df = spark.createDataFrame([(5001.0, act)], "ml_pred double, act_pred double")
    assert op.blended(df).first()["zone"] == zone


@pytest.mark.parametrize("closed,factor", [(False, math.exp(0.01)), (True, math.exp(0.02))])
def test_bias_boundary_side(spark, closed, factor):
    df = spark.createDataFrame([(10000.0,)], "p double")
    got = df.select(fx.bias_factor("p", {"low": 0.04, "high": 0.02}, 10000.0, closed=closed)).first()[0]
    assert got == pytest.approx(factor)


def test_ratio_bias_two_tier_fallback_and_caps(scored_frame):
    df = scored_frame(*[(4000.0, 8000.0)] * 40, *[(30000.0, 20000.0)] * 40)
    fit = {r["tier"]: r for r in op.fit_ratio_bias(df)}
    assert set(fit) == {"low", "high"}  # nothing between 10,000 and 14,000
    assert fit["low"]["factor"] == pytest.approx(0.90)  # halved truth, limited downwards
    assert fit["high"]["variance"] == 1e-6  # underpriced tier stays as it is


def test_ratio_bias_uses_true_tier_only_with_enough_rows(scored_frame):
    many = [(9500.0, 9600.0)] * 30 + [(12000.0, 9000.0)] * 5
    rest = [(12000.0, 12500.0)] * 12 + [(20000.0, 21000.0)] * 12
    fit = {r["tier"]: r for r in op.fit_ratio_bias(scored_frame(*many, *rest))}
    assert fit["low"]["n_own"] == 30 and fit["low"]["ratio"] == pytest.approx(9500 / 9600)
    assert fit["mid"]["n_own"] == 12 and fit["high"]["n_own"] == 0


def test_tier_routing_is_continuous_inside_a_blend(spark):
    df = spark.createDataFrame([(4749.0,), (4999.999,), (5000.0,), (5249.99,), (5250.0,), (20000.0,)], "ml_pred double")
    df = df.withColumns({n: F.col("ml_pred") * s for n, s in (("low", 0.98), ("mid", 1.01), ("high_mid", 1.02), ("very_high", 0.97))})
    got = [r[0] for r in df.select(op.tier_routed()).collect()]
    assert got[0] == pytest.approx(4749.0 * 0.98)
    assert got[1] == pytest.approx(4999.999 * 1.01, rel=1e-4)
    assert got[2] == pytest.approx(5050.0) and got[4] == pytest.approx(5250 * 1.01) and got[5] == pytest.approx(19400.0)


def test_sweep_base_point_does_not_change(policy_frame):
    rows = op.sweep(policy_frame({"age": 40}), "age").where("grid_value = 40").collect()
    assert len(rows) == 1 and rows[0]["change_pct"] == pytest.approx(0.0)


def test_last_scenarios_of_a_hot_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") > 2, "hot").otherwise("cold").alias("g"), F.col("id").alias("t"))
    last = op.last_scenarios(df, "g", "t", 5)
    assert sorted(r["t"] for r in last.where("g = 'hot'").collect()) == [995, 996, 997, 998, 999]
    assert last.where("g = 'cold'").count() == 3
    assert "WindowGroupLimit" in last._jdf.queryExecution().optimizedPlan().toString()
