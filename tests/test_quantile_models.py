"""Quantile forest, linear quantile regression and conformal bounds against plain versions."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ratebook.operators import intervals, learners, quantile_models as qm
from ratebook.operators.sums import elastic_solution, grams


def frame(spark, x, y, **more):
    rows = [(i, *map(float, a), float(b), *(v[i] for v in more.values())) for i, (a, b) in enumerate(zip(x, y))]
    names = ", ".join(f"x{i} double" for i in range(len(x[0])))
    return spark.createDataFrame(rows, f"id long, {names}, label double" + "".join(f", {k} string" for k in more))


def loss(r, alpha, w=1.0):
    return float(np.sum(w * np.where(r >= 0, alpha * r, (alpha - 1) * r)))


def test_grams_by_group(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    group = ["a" if v > 0 else None for v in x[:, 0]]
    df = frame(spark, x[:, :2], x[:, 2], g=group).repartition(7)
    got = grams(df, ["x0", "x1", "label"], [F.col("g")], F.col("x1") * F.col("x1"))
    for name in ("a", None):
        part = x[[g == name for g in group]]
        assert np.allclose(got[name,], (part * part[:, 1:2] ** 2).T @ part)
    assert grams(df.limit(0), ["x0"]) == {}


def test_coordinate_descent_meets_its_conditions():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 5))
    g, c, l1, l2 = x.T @ x, x.T @ rng.normal(size=60), np.array([0, 3.0, 3, 3, 50]), np.array([0, 1.0, 1, 1, 1])
    b = elastic_solution(g, c, l1, l2)
    pull = c - g @ b - l2 * b
    assert b[4] == 0 and (np.abs(pull) <= l1 + 1e-7).all()
    assert np.allclose(pull[b != 0], (l1 * np.sign(b))[b != 0], atol=1e-7) and (b != 0).sum() >= 3


def test_forest_quantiles_are_weighted_by_shared_leaves(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    y = x[:, 0] * 3 + rng.normal(size=300)
    df = frame(spark, x, y)
    fit = qm.QuantileForest.fit(df, ["x0", "x1"], bins=5000, numTrees=6, maxDepth=4)
    leaves = np.array([r[0] for r in fit.model.transform(learners.assembled(df, ["x0", "x1"])).orderBy("id").select(vector_to_array("leaves")).collect()])
    got = fit.transform(df, [0.3, 0.9], ["low", "high"]).orderBy("id").collect()
    assert [r["label"] for r in got] == y.tolist()
    order = np.argsort(y)
    for i in range(300):
        weight = np.zeros(300)
        for t in range(6):
            mates = leaves[:, t] == leaves[i, t]
            weight += mates / mates.sum() / 6
        upto = np.cumsum(weight[order])
        for alpha, c in ((0.3, "low"), (0.9, "high")):
            assert got[i][c] == pytest.approx(y[order][np.searchsorted(upto, alpha - 1e-6)])


def test_forest_beats_the_cells(spark, data):
    got = {r["model"]: r["pinball"] for r in entry.queries()["f4_quantile_losses"](spark, data.replace("sf0.001", "sf0.01")).collect()}
    assert got["forest"] < got["cells"] and got["linear"] < got["cells"]


@pytest.mark.parametrize("alpha", [0.1, 0.5, 0.8])
def test_linear_fit_is_the_best_one(spark, alpha):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=400) * 50 + 1000, rng.integers(0, 3, 400), np.full(400, 7.0)])
    y = 2 * x[:, 0] - 30 * x[:, 1] + rng.standard_t(2, 400) * 20
    x, y = np.vstack([x, x[:50]]), np.r_[y, y[:50]]  # equal rows count twice
    df = frame(spark, x, y)
    for band in (2000, 40):  # the second leaves most rows to the two sums
        fit = qm.LinearQuantile.fit(df, ["x0", "x1", "x2"], alpha, band=band)
        assert fit.exact and fit.coefficients[2] == 0
        b = np.array([fit.intercept, *fit.coefficients])
        design = np.column_stack([np.ones(450), x])
        r = y - design @ b
        on = np.abs(r) < 1e-6
        pull = design.T @ np.where(on, 0, alpha - (r < 0))
        assert (np.abs(pull[:3]) <= (np.abs(design[:, :3]) * on[:, None]).sum(axis=0) * max(alpha, 1 - alpha) + 1e-6).all()
        best = loss(r, alpha)
        for _ in range(200):
            step = rng.normal(size=4) * np.array([30, 0.03, 3, 0])
            assert loss(y - design @ (b + step), alpha) >= best - 1e-7
        held = fit.conditions(df).first()
        assert held["share_holds"] and held["subgradient_holds"] and held["n"] == 450


def test_penalised_fit_sits_between(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    y = 5 * x[:, 0] + 0.05 * x[:, 1] + rng.normal(size=500)
    df = frame(spark, x, y)
    plain, strong = (qm.LinearQuantile.fit(df, ["x0", "x1", "x2"], 0.5, l1=l, l2=0.01) for l in (0.0, 0.1))
    assert strong.coefficients[1] == pytest.approx(0, abs=1e-4) and strong.coefficients[2] == pytest.approx(0, abs=1e-4)
    assert 0 < strong.coefficients[0] < plain.coefficients[0] < 5.2
    z = (x - x.mean(0)) / x.std(0)

    def total(c0, c):
        return loss(y - c0 - z @ c, 0.5) / 500 + 0.1 * np.abs(c).sum() + 0.005 * (c * c).sum()

    c = np.array(strong.coefficients) * x.std(0)
    c0 = strong.intercept + (np.array(strong.coefficients) @ x.mean(0))
    best = total(c0, c)
    for _ in range(300):
        assert total(c0 + rng.normal() * 0.05, c + rng.normal(size=3) * 0.05) >= best - 1e-5


def test_fits_of_odd_tables(spark):
    df = frame(spark, [[1.0]] * 5, [1, 2, 3, 4, 5.0])
    fit = qm.LinearQuantile.fit(df, ["x0"], 0.5)
    assert (fit.intercept, fit.coefficients) == (pytest.approx(3.0), (0.0,))
    with pytest.raises(ValueError):
        qm.LinearQuantile.fit(df.limit(0), ["x0"], 0.5)
    one = qm.LinearQuantile.fit(df.limit(1), ["x0"], 0.5)
    assert one.intercept == pytest.approx(df.limit(1).first()["label"])


def test_bounds_cover_rows_apart(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 1))
    y = x[:, 0] + rng.normal(size=4000)
    df = frame(spark, x, y).selectExpr("id", "label", "x0 + 0.5 AS lower", "x0 - 0.5 AS upper")  # crossed and too narrow
    for per_side in (False, True):
        fit = intervals.ConformalBounds.fit(df.where("id < 2000"), "label", "lower", "upper", per_side=per_side)
        if not per_side:
            score = np.sort(np.maximum(x[:2000, 0] - 0.5 - y[:2000], y[:2000] - x[:2000, 0] - 0.5))
            assert fit.below == fit.above == pytest.approx(score[intervals.conformal_rank(2000, 0.1) - 1])
        got = intervals.coverage(fit.transform(df.where("id >= 2000"), "lower", "upper", floor=None), "label").first()
        assert 0.88 <= got["empirical"] <= 0.92
    wide = df.selectExpr("id", "label", "lower - 50 AS lower", "upper + 50 AS upper")
    assert intervals.ConformalBounds.fit(wide, "label", "lower", "upper").below < -40
    with pytest.raises(ValueError):
        intervals.ConformalBounds.fit(wide.limit(5), "label", "lower", "upper")


def test_forest_bounds_cover(spark, data):
    got = entry.queries()["h2_conformal_quantiles"](spark, data.replace("sf0.001", "sf0.01")).first()
    assert got["empirical"] >= 0.88
