import math

import numpy as np
import pytest

from ratebook.operators import forest, intervals as iv, isotonic, learners
from ratebook.sources import files, portfolio


@pytest.mark.parametrize("n", [30, 50, 99, 500, 1499])
def test_rank_is_the_next_higher_order_statistic(n):
    level = min(1.0, math.ceil((n + 1) * 0.9) / n)
    values = np.arange(1, n + 1)
    assert iv.conformal_rank(n, 0.1) == np.quantile(values, level, method="higher")


def test_no_width_below_thirty_rows(scored_frame):
    assert iv.conformal_half_width(scored_frame(*[(i, 0) for i in range(29)]), "y_true") == (29, None)


def test_bins_with_tied_predictions(scored_frame):
    df = scored_frame(*[(i % 7 - 3, 10.0 if i < 60 else 20.0 + i) for i in range(120)])
    fit = iv.ConformalBins.fit(df, "price", "y_true")
    assert len(set(fit.edges)) == len(fit.edges) == len(fit.widths)
    assert df.select(iv.ConformalBins.width(fit, "price").alias("w")).where("w is null").isEmpty()


def test_bins_need_fifty_rows(scored_frame):
    assert iv.ConformalBins.fit(scored_frame(*[(i, i) for i in range(49)]), "price", "y_true") is None


@pytest.mark.parametrize("p,dof,want", [(0.975, 1, 12.7062), (0.975, 5, 2.5706), (0.975, 30, 2.0423), (0.95, 10, 1.8125), (0.975, 100000, 1.95999)])
def test_student_quantile(p, dof, want):
    assert iv.student_quantile(p, dof) == pytest.approx(want, abs=2e-4)


def test_unknown_family(scored_frame):
    with pytest.raises(ValueError):
        iv.heuristic(scored_frame((1, 1)), "price", "magic")


def test_conformal_coverage(spark, data):
    from ratebook.plans.intervals import with_intervals
    row = iv.coverage(with_intervals(spark, data).withColumn("y_true", portfolio.F.col("charges"))).first()
    assert row["n_covered"] <= row["n"] and row["mean_width"] > 0


def test_importance_sums_to_one(spark, data):
    df = learners.learning_table(portfolio.policies(spark, data)).cache()
    model = learners.train(df, "random_forest", numTrees=5, maxDepth=4)
    rows = learners.importance(model, df, top=100).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0)
    wide = learners.tree_interval(model, df)
    assert wide.where("lower > upper").isEmpty()
    plain = learners.predict(model, df).select("policy_id", portfolio.F.col("prediction").alias("p"))
    assert wide.join(plain, "policy_id").where("abs(prediction - p) > 1e-6").isEmpty()
    with pytest.raises(ValueError):
        learners.train(df, "unheard_of")


def test_shuffling_keeps_the_values(spark, data):
    df = learners.learning_table(portfolio.policies(spark, data)).cache()
    mixed = learners.with_next(df, ["age"], 1, 3).withColumn("age", portfolio.F.col("_next.age")).drop("_next")
    other = learners.with_next(df, ["age"], 1, 64).select("policy_id", portfolio.F.col("_next.age").alias("b"))
    assert mixed.join(other, "policy_id").where("age <> b").isEmpty()  # whatever the number of ranges
    assert sorted(r["age"] for r in mixed.collect()) == sorted(r["age"] for r in df.collect())
    moved = mixed.select("policy_id", portfolio.F.col("age").alias("a")).join(df, "policy_id").where("a <> age").count()
    assert moved > df.count() / 2


def test_isotonic_is_monotone(spark, data):
    df = portfolio.scored(spark, data)
    out = isotonic.IsotonicCalibrator.fit(df, "ml_pred").transform(df, "c").orderBy("ml_pred").collect()
    values = [r["c"] for r in out]
    assert all(a <= b + 1e-9 for a, b in zip(values, values[1:]))


def test_isolation_forest_finds_the_far_point(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))] + [(999, 12.0, -12.0)]
    df = spark.createDataFrame(rows, "policy_id long, a double, b double")
    fit = forest.IsolationForest.fit(df, ["a", "b"], trees=30)
    flagged = {r["policy_id"] for r in fit.flag(df).where("outlier").collect()}
    assert 999 in flagged and len(flagged) == 8  # two percent of 401 rows
    assert fit.keep_normal(df).count() == 393


def test_csv_and_parquet_sources(spark, policy_frame, tmp_path):
    df = policy_frame({}, {"policy_id": 5, "bmi": 31.25})
    for fmt in ("csv", "parquet"):
        files.write_policies(df, str(tmp_path / fmt), fmt)
        assert sorted(files.read_policies(spark, str(tmp_path / fmt), fmt).collect()) == sorted(df.collect())
    files.write_policies(df.limit(0), str(tmp_path / "none"), "parquet")
    with pytest.raises(ValueError):
        files.read_policies(spark, str(tmp_path / "none"), "parquet")
    with pytest.raises(Exception):
        files.read_policies(spark, str(tmp_path / "absent"))
    files.write_state(spark, {"a": 1, "b": [1.5]}, str(tmp_path / "state"))
    assert files.read_state(spark, str(tmp_path / "state")) == {"a": 1, "b": [1.5]}


class FakeContext:
    def __init__(self):
        self.dir = None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


class FakeSession:
    def __init__(self, configured):
        self.conf = {"spark.sql.warehouse.dir": "/warehouse"} | ({"spark.checkpoint.dir": configured} if configured else {})
        self.sparkContext = FakeContext()


def test_shared_folder_comes_from_the_session():
    from ratebook import session
    assert session.work_path(FakeSession("/shared/work/"), "x").startswith("/shared/work/x-")
    unset = FakeSession(None)
    assert session.shared_dir(unset) == session.shared_dir(unset) == "/warehouse/_work"
