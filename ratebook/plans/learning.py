"""Queries that fit Spark ML models; their results depend on the learner, not on SQL."""

from pyspark.sql import functions as F

from ratebook.config import KEY
from ratebook.functions import moments as m
from ratebook.functions.columns import rounded
from ratebook.operators import ensembles, fold_sums, forest, intervals, learners, models, pricing, quantile_models as qm, splits
from ratebook.plans.registry import query
from ratebook.plans.splits import bins, h
from ratebook.plans.sql import with_ctes
from ratebook.sources import portfolio


def table(spark, d, keep=()):
    """The learning table, written once for the passes of an iterative fit."""
    return splits.stored(learners.learning_table(portfolio.policies(spark, d), keep=keep), "learning")


def folded(spark, d, k=5):
    p = splits.folds(portfolio.policies(spark, d), "charges", k)
    return splits.stored(learners.learning_table(p, keep=["fold"]), "folded")


def parted(spark, d):
    p = splits.train_val_test(portfolio.policies(spark, d))
    return splits.stored(learners.learning_table(p, keep=["split"]), "parted")


def scores(df, models_):
    out = None
    for name, model in models_.items():
        one = learners.predict(model, df.where(F.col("split") != "train")).groupBy("split").agg(
            F.count("label").alias("n"), m.rmse("label", "prediction").alias("rmse"), m.r2("label", "prediction").alias("r2")
        ).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 4)


@query("f1_linear_models")
def linear_models(spark, d):
    df = parted(spark, d)
    fit = df.where(F.col("split") == "train")
    return scores(df, {n: learners.train(fit, n) for n in ("linear", "ridge", "lasso")})


@query("f2_random_forest")
def random_forest(spark, d):
    df = parted(spark, d)
    return scores(df, {"random_forest": learners.train(df.where(F.col("split") == "train"), "random_forest", numTrees=20)})


@query("f3_boosted_trees")
def boosted_trees(spark, d):
    """Boosted trees with sample weights and early stopping on the validation rows."""
    df = parted(spark, d)
    fit = df.where(F.col("split") != "test").withColumn("is_val", F.col("split") == "val")
    fit = fit.withColumn("weight", splits.sample_weight(fit.where("NOT is_val"), "label"))
    return scores(df, {"boosted": learners.train(fit, "boosted", weight="weight", validation="is_val", maxIter=20)})


def quantile_forest(df):
    return qm.QuantileForest.fit(df.where("split = 'train'"), numTrees=20)


@query("f4_quantile_forest")
def quantile_forest_premium(spark, d):
    """The 30 per cent quantile of the charge for rows that the forest has not seen."""
    df = parted(spark, d)
    out = quantile_forest(df).transform(df.where("split <> 'train'"), [0.30], ["risk_premium"])
    return rounded(out.select(KEY, "split", "label", "risk_premium"), 4)


@query("f4_quantile_losses")
def quantile_losses(spark, d):
    """Pinball loss on rows apart: the forest, the linear fit and the table of cells."""
    p = splits.train_val_test(portfolio.policies(spark, d))
    df = splits.stored(learners.learning_table(p, keep=["split", "smoker"]), "quantiles")
    fit, rest = df.where("split = 'train'"), df.where("split <> 'train'")
    rest = quantile_forest(df).transform(rest, [0.30], ["forest"])
    rest = qm.LinearQuantile.fit(fit, ["age", "bmi", "children", "smoking", "smoker_bmi", "smoker_age"], 0.30).transform(rest, "linear")
    rest = models.QuantileTable.fit(fit, 0.30, "label").transform(rest).withColumnRenamed("risk_premium", "cells")
    return rounded(qm.pinball_table(rest, 0.30, {c: c for c in ("forest", "linear", "cells")}), 4)


@query("f1_linear_quantile", with_ctes("""
, g AS (SELECT smoker, charges, row_number() OVER (PARTITION BY smoker ORDER BY charges) AS r, count(*) OVER (PARTITION BY smoker) AS n FROM policies),
q AS (SELECT max(charges) FILTER (smoker='no') AS a, max(charges) FILTER (smoker='yes') AS b FROM g WHERE r = ceil(0.3003*n))
SELECT 0.3003 AS alpha, round(a,4) AS intercept, round(b-a,4) AS smoking, true AS exact FROM q"""))
def linear_quantile(spark, d):
    """With one yes-or-no input the fit is the quantile of either group."""
    fit = qm.LinearQuantile.fit(learners.learning_table(portfolio.policies(spark, d)), ["smoking"], 0.3003)
    return rounded(spark.createDataFrame([(fit.alpha, fit.intercept, fit.coefficients[0], fit.exact)],
                                         "alpha double, intercept double, smoking double, exact boolean"), {"intercept": 4, "smoking": 4})


@query("f1_quantile_conditions", with_ctes("SELECT count(*) AS n, true AS share_holds, true AS subgradient_holds, 3 AS n_on FROM policies"))
def quantile_conditions(spark, d):
    """What makes a fit on two inputs the best one; the statement says what must come out."""
    df = learners.learning_table(portfolio.policies(spark, d))
    fit = qm.LinearQuantile.fit(df, ["age", "bmi"], 0.30)
    return fit.conditions(df).select("n", "share_holds", "subgradient_holds", F.col("n_on").cast("int").alias("n_on"))


@query("h2_conformal_quantiles")
def conformal_quantiles(spark, d):
    """Forest quantiles at 5 and 95 per cent, adjusted on the validation rows and judged on the test rows."""
    df = parted(spark, d)
    both = quantile_forest(df).transform(df.where("split <> 'train'"), [0.05, 0.95], ["lower", "upper"])
    both = splits.stored(both.select(KEY, "split", "label", "lower", "upper"), "quantile-bounds")
    fit = intervals.ConformalBounds.fit(both.where("split = 'val'"), "label", "lower", "upper")
    out = intervals.coverage(fit.transform(both.where("split = 'test'"), "lower", "upper"), "label")
    return rounded(out, {"empirical": 6, "gap": 6, "mean_width": 4, "median_width": 4})


@query("f3_staged_loss")
def staged_loss(spark, d):
    """Loss of every prefix of the boosted trees on validation and test rows, and the round that patience keeps."""
    df = parted(spark, d)
    fit = ensembles.StoppedTrees.fit(df.where("split = 'train'"), df.where("split = 'val'"), patience=5, maxIter=20)
    losses = ensembles.staged_losses(fit.model, df.where("split <> 'train'"), by=["split"])
    return rounded(losses.withColumn("kept", F.col("round") == fit.rounds), 4)


@query("f2_out_of_bag")
def out_of_bag(spark, d):
    """A forest judged by the trees that have not seen a row, on the rows it was grown on."""
    df = table(spark, d)
    return rounded(ensembles.BaggedForest.fit(df, trees=10).score(df), 4)


_ALL_FOLDS = f"""st AS (SELECT policy_id, age, charges, {bins((0.2, 0.4, 0.6, 0.8))} AS stratum FROM policies),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {h(42)}) AS r, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (ORDER BY {h(7)}) AS place, count(*) OVER () AS rows FROM st),
f AS (SELECT age, charges, place, rows, CAST(r>n//5 AS INT)+CAST(r>2*n//5 AS INT)+CAST(r>3*n//5 AS INT)+CAST(r>4*n//5 AS INT) AS fold FROM r),
g AS (SELECT unnest([0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]) AS fraction),
k AS (SELECT DISTINCT fold AS k FROM f),
t AS (SELECT fraction, k, count(*) AS n_train, regr_slope(charges,age) AS b, regr_intercept(charges,age) AS a FROM g, k, f WHERE fold<>k AND place<=greatest(1,CAST(floor(rows*fraction) AS BIGINT)) GROUP BY ALL)"""


@query("f20_fold_sums", with_ctes(f""", {_ALL_FOLDS},
v AS (SELECT t.fraction, t.k AS fold, n_train, count(*) AS n_val, sqrt(avg((charges-a-b*age)*(charges-a-b*age))) AS val_rmse FROM t JOIN f ON f.fold=t.k GROUP BY ALL),
w AS (SELECT t.fraction, t.k AS fold, sqrt(avg((charges-a-b*age)*(charges-a-b*age))) AS train_rmse FROM t JOIN f ON f.fold<>t.k AND place<=greatest(1,CAST(floor(rows*t.fraction) AS BIGINT)) GROUP BY ALL)
SELECT v.fraction, CAST(v.fold AS INT) AS fold, n_train, n_val, round(train_rmse,4) AS train_rmse, round(val_rmse,4) AS val_rmse FROM v JOIN w ON w.fraction=v.fraction AND w.fold=v.fold"""))
def fold_sums_curve(spark, d):
    """Learning curve of a line through one input, all folds and shares from one scan."""
    p = splits.folds(portfolio.policies(spark, d), "charges", 5)
    out = fold_sums.fold_scores(p, ["age"], "charges", fractions=[i / 10 for i in range(1, 11)])
    return rounded(out.drop("l1", "l2"), {"train_rmse": 4, "val_rmse": 4})


@query("f8_penalties")
def penalties(spark, d):
    """Cross-validated error of ridge and lasso at several strengths, every one from the same sums."""
    df = learners.learning_table(splits.folds(portfolio.policies(spark, d), "charges", 5), keep=["fold"])
    grid = [(0.0, 0.0), *[(0.0, v) for v in (0.01, 0.1, 1.0)], *[(v, 0.0) for v in (10.0, 100.0, 1000.0)]]
    return rounded(fold_sums.curve(fold_sums.fold_scores(df, learners.INPUTS, penalties=grid)), 2)


@query("f6_grid_search")
def grid_search(spark, d):
    return rounded(learners.grid_search(folded(spark, d), "boosted", {"maxDepth": [2, 4], "maxIter": [5, 10]}, folds=5), 4)


@query("f8_cross_validation")
def cross_validation(spark, d):
    per_fold = learners.cross_validated(folded(spark, d), "boosted", folds=5, weighted=True, maxIter=10)
    return rounded(learners.cv_summary(per_fold), 4)


@query("f13_tier_specialists")
def tier_specialists(spark, d):
    """Specialists per tier of the learned premium, routed and compared with it."""
    p = portfolio.with_ml_prediction(portfolio.policies(spark, d))
    df = learners.learning_table(p, keep=["ml_pred"])
    df = splits.stored(df, "specialists")
    made = learners.specialists(df, "ml_pred", rounds=20)
    rows = learners.with_specialists(df, made, "ml_pred").withColumn("routed", pricing.tier_routed())
    out = rows.agg(m.rmse("label", "ml_pred").alias("rmse_base"), m.rmse("label", "routed").alias("rmse_routed"), F.count("label").alias("n"))
    return rounded(out.withColumn("n_specialists", F.lit(len(made))), 4)


@query("f17_importance")
def importance(spark, d):
    df = table(spark, d)
    return rounded(learners.importance(learners.train(df, "boosted", maxIter=10), df), 6)


@query("f18_permutation_importance")
def permutation_importance(spark, d):
    df = table(spark, d)
    return rounded(learners.permutation_importance(learners.train(df, "boosted", maxIter=10), df), 4)


@query("f19_partial_dependence")
def partial_dependence(spark, d):
    df = table(spark, d)
    model = learners.train(df, "boosted", maxIter=10)
    return rounded(learners.partial_dependence(model, df, learners.INPUTS[:6]), 4)


@query("f20_learning_curve")
def learning_curve(spark, d):
    return rounded(learners.learning_curve(folded(spark, d), "linear"), 4)


@query("h6_forest_interval")
def forest_interval(spark, d):
    df = table(spark, d)
    model = learners.train(df, "random_forest", numTrees=20)
    out = learners.tree_interval(model, df).select(KEY, "label", "prediction", "lower", "upper")
    return rounded(out, 4)


@query("d10_isolation_forest")
def isolation_forest(spark, d):
    df = portfolio.policies(spark, d).select(KEY, "age", "bmi", "children", "charges")
    df = splits.stored(df, "forest")
    fit = forest.IsolationForest.fit(df, ["age", "bmi", "children", "charges"])
    return rounded(fit.flag(df), 6)
