"""Staged losses, out-of-bag votes, fold sums and the metric history against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ratebook.operators import ensembles, fold_sums, history, learners
from ratebook.sources import portfolio


@pytest.fixture(scope="module")
def rows(spark, data):
    p = portfolio.policies(spark, data).withColumn("part", F.when(F.col("policy_id") % 4 == 0, "val").otherwise("train"))
    return learners.learning_table(p, keep=["part"]).cache()


def test_losses_of_every_prefix(rows):
    train, val = rows.where("part = 'train'"), rows.where("part = 'val'")
    fit = ensembles.StoppedTrees.fit(train, val, patience=3, maxIter=8, maxDepth=3)
    got = {r["round"]: r for r in ensembles.staged_losses(fit.model, val, by=["part"]).collect()}
    want = fit.model.evaluateEachIteration(learners.assembled(val), "squared")
    assert sorted(got) == list(range(1, 9)) and got[1]["part"] == "val" and got[1]["n"] == val.count()
    assert [got[k]["loss"] for k in range(1, 9)] == pytest.approx(list(want))
    assert list(fit.losses) == pytest.approx(list(want))
    cut = fit.transform(val, "p").agg(F.avg((F.col("label") - F.col("p")) ** 2)).first()[0]
    assert cut == pytest.approx(fit.losses[fit.rounds - 1])
    low = ensembles.staged_losses(fit.model, val, alpha=0.3).orderBy("round").collect()
    e = np.array([r["label"] - r["prediction"] for r in learners.predict(fit.model, val).collect()])
    assert low[-1]["loss"] == pytest.approx(np.where(e >= 0, 0.3 * e, -0.7 * e).mean())
    with pytest.raises(ValueError):
        ensembles.StoppedTrees.fit(train, val.limit(0), maxIter=2)


def test_patience():
    assert ensembles.best_round([5, 4, 3, 3.5, 3.4, 1], 2) == 3
    assert ensembles.best_round([5, 4, 3, 3.5, 3.4, 1], 3) == 6
    assert ensembles.best_round([1.0], 50) == 1 and ensembles.best_round([], 50) == 0


def test_votes_come_from_trees_that_have_not_seen_the_row(rows):
    fit = ensembles.BaggedForest.fit(rows, trees=6, maxDepth=4)
    names = [f"d{t}" for t in range(6)]
    seen = rows.select("policy_id", *[ensembles.draws(t).alias(n) for t, n in enumerate(names)]).collect()
    seen = {r["policy_id"]: [r[n] for n in names] for r in seen}
    flat = np.array(list(seen.values()))
    assert abs(flat.mean() - 1) < 0.2 and abs((flat == 0).mean() - np.exp(-1)) < 0.1 and flat.max() > 1
    trees = ensembles.tree_predictions(fit.trees, rows, learners.INPUTS).select("policy_id", "label", "_trees").collect()
    got = {r["policy_id"]: r for r in fit.votes(rows).collect()}
    errors, labels = [], []
    for r in trees:
        free = [p for p, k in zip(r["_trees"], seen[r["policy_id"]]) if k == 0]
        mine = got[r["policy_id"]]
        assert mine["n_trees"] == len(free) and mine["prediction"] == pytest.approx(np.mean(r["_trees"]))
        if free:
            assert mine["out_of_bag"] == pytest.approx(np.mean(free))
            errors.append(r["label"] - np.mean(free))
            labels.append(r["label"])
        else:
            assert mine["out_of_bag"] is None
    score = fit.score(rows).first()
    assert score["n_judged"] == len(errors) and score["n"] == len(trees)
    assert score["rmse"] == pytest.approx(np.sqrt(np.mean(np.square(errors))))
    assert score["r2"] == pytest.approx(1 - np.mean(np.square(errors)) / np.var(labels))


def test_fold_sums_are_the_fits(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=300) * 10 + 500, rng.normal(size=300), np.ones(300)])
    y = 3 * x[:, 0] - 20 * x[:, 1] + rng.normal(size=300)
    fold = rng.integers(0, 4, 300)
    df = spark.createDataFrame([(i, *map(float, a), float(b), int(f)) for i, (a, b, f) in enumerate(zip(x, y, fold))] + [(999, None, 1.0, 1.0, 1.0, 0)],
                               "policy_id long, x0 double, x1 double, x2 double, label double, fold int")
    got = fold_sums.fold_scores(df, ["x0", "x1", "x2"], fractions=[0.5, 1.0], penalties=[(0, 0), (0, 0.5), (5.0, 0)]).collect()
    assert len(got) == 2 * 3 * 4
    for r in got:
        if r["fraction"] < 1:
            continue
        a, b = x[fold != r["fold"]], y[fold != r["fold"]]
        z, s = a - a.mean(0), np.where(a.std(0) > 0, a.std(0), 1)
        z, t = z / s, b - b.mean()
        if not r["l1"]:
            c = np.linalg.lstsq(z.T @ z / len(z) + np.diag([r["l2"]] * 2 + [r["l2"] + 1e-12]), z.T @ t / len(z), rcond=None)[0]
        else:  # two inputs, nearly independent: the subgradient condition decides
            c = np.zeros(3)
            for _ in range(500):
                for j in range(2):
                    pull = z[:, j] @ (t - z @ c + z[:, j] * c[j]) / len(z)
                    c[j] = np.sign(pull) * max(0, abs(pull) - r["l1"])
        p = (x[fold == r["fold"]] - a.mean(0)) / s @ c + b.mean()
        assert r["n_train"] == len(a) and r["n_val"] == len(p)
        assert r["val_rmse"] == pytest.approx(np.sqrt(np.mean((y[fold == r["fold"]] - p) ** 2)), rel=1e-6)
        assert r["train_rmse"] == pytest.approx(np.sqrt(np.mean((t - z @ c) ** 2)), rel=1e-6)
    assert fold_sums.curve(spark.createDataFrame(got)).count() == 6
    assert fold_sums.fold_scores(df.limit(0), ["x0"], fractions=[0.5, 1.0]).count() == 0


SCHEMA = "entry string, v int, period string, evaluation string"


def test_history_counts_an_evaluation_once(spark, tmp_path):
    path = str(tmp_path / "history")
    put = lambda *rows: history.upsert(spark.createDataFrame(rows, SCHEMA), path)
    all_ = lambda: sorted(tuple(r) for r in history.read(spark, path, SCHEMA).select("entry", "v").collect())
    assert all_() == []
    put(("a", 1, "2024-01", "e1"), ("b", 2, "2024-02", "e1"))
    put(("c", 3, "2024-02", "e2"))
    put(("b", 20, "2024-02", "e1"))  # the same evaluation again
    assert all_() == [("a", 1), ("b", 20), ("c", 3)]
    history.compact(spark, path, SCHEMA, "2024-03")
    assert all_() == [("a", 1), ("b", 20), ("c", 3)]
    put(("c", 30, "2024-02", "e2"), ("d", 4, "2024-03", "e3"))  # evaluated again after it was compacted
    assert all_() == [("a", 1), ("b", 20), ("c", 30), ("d", 4)]
    history.compact(spark, path, SCHEMA, "2024-03")
    assert all_() == [("a", 1), ("b", 20), ("c", 30), ("d", 4)]
    assert [r["entry"] for r in history.newest(spark, path, SCHEMA, "entry", 2).collect()] == ["d", "c"]
    plan = history.read(spark, path, SCHEMA, "2024-03")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(period" in plan
    assert sorted(r["entry"] for r in history.read(spark, path, SCHEMA, "2024-03").collect()) == ["d"]
    with pytest.raises(ValueError):
        history.upsert(spark.createDataFrame([("a",)], "entry string"), path)
