"""Learned premiums on Spark ML: estimators by name, search, cross-validation, explanation."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratebook.config import KEY, TARGET
from ratebook.functions import moments as m
from ratebook.functions import features as fx
from ratebook.functions.columns import col, flag, hash_key
from ratebook.functions.pricing import is_smoker
from ratebook.operators import splits
from ratebook.operators.pricing import SPECIALIST_TIERS
from ratebook.operators.quantiles import kept, order_statistics

INPUTS = ("age", "bmi", "children", "smoking", "smoker_bmi", "smoker_age", "bmi_squared", "age_squared",
          "age_bmi_stress", "chronic_condition_proxy")

# The one extension point: a name and the estimator it stands for.
BUILDERS: dict[str, Callable[..., Estimator]] = {
    "linear": lambda **p: LinearRegression(**p),
    "ridge": lambda **p: LinearRegression(**{"elasticNetParam": 0.0, "regParam": 1.0, **p}),
    "lasso": lambda **p: LinearRegression(**{"elasticNetParam": 1.0, "regParam": 1.0, **p}),
    "random_forest": lambda **p: RandomForestRegressor(**{"numTrees": 200, "maxDepth": 8, "seed": 42, **p}),
    "boosted": lambda **p: GBTRegressor(**{"maxIter": 200, "maxDepth": 4, "stepSize": 0.1, "seed": 42, **p}),
}


def learning_table(df: DataFrame, target: str = TARGET, keep: Sequence[str] = ()) -> DataFrame:
    """Key, target, weight and the model inputs, ready to assemble."""
    made = fx.all_features()
    inputs = {"smoking": flag(is_smoker())}
    out = [(inputs.get(c) if c in inputs else made[c] if c in made else F.col(c)).cast("double").alias(c) for c in INPUTS]
    return df.select(KEY, F.col(target).cast("double").alias("label"), *keep, *out)


def assembled(df: DataFrame, inputs: Sequence[str] = INPUTS) -> DataFrame:
    return VectorAssembler(inputCols=list(inputs), outputCol="features", handleInvalid="error").transform(df)


def train(df: DataFrame, name: str, weight: str | None = None, validation: str | None = None, **params) -> Model:
    """Fit a named model on a learning table; boosted trees may stop early on marked rows."""
    if name not in BUILDERS:
        raise ValueError(f"unknown model {name}; known: {', '.join(BUILDERS)}")
    if weight:
        params["weightCol"] = weight
    if validation:
        if name != "boosted":
            raise ValueError("only boosted trees stop early")
        params["validationIndicatorCol"] = validation
    return BUILDERS[name](featuresCol="features", labelCol="label", **params).fit(assembled(df))


def predict(model: Model, df: DataFrame, output: str = "prediction") -> DataFrame:
    out = model.transform(assembled(df)).drop("features", "rawPrediction")
    return out if output == "prediction" else out.withColumnRenamed("prediction", output)


def grid_search(df: DataFrame, name: str, grid: dict[str, Sequence], folds: int = 3, fold: str = "fold") -> DataFrame:
    """Mean cross-validated RMSE of every combination, best first; folds are the given ones."""
    estimator = BUILDERS[name](featuresCol="features", labelCol="label")
    builder = ParamGridBuilder()
    for key, values in grid.items():
        builder = builder.addGrid(getattr(estimator, key), list(values))
    combos = builder.build()
    search = CrossValidator(
        estimator=estimator, estimatorParamMaps=combos, evaluator=RegressionEvaluator(labelCol="label"),
        numFolds=folds, foldCol=fold, parallelism=2)
    fitted = search.fit(assembled(df).withColumn(fold, F.col(fold).cast("int")))
    rows = [({p.name: str(v) for p, v in combo.items()}, float(score), float(std))
            for combo, score, std in zip(combos, fitted.avgMetrics, fitted.stdMetrics)]
    out = df.sparkSession.createDataFrame(rows, "params map<string,string>, mean_rmse double, std_rmse double")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select(text.alias("params"), "mean_rmse", "std_rmse").orderBy("mean_rmse", "params")


def cross_validated(df: DataFrame, name: str, folds: int = 3, fold: str = "fold", weighted: bool = False, **params) -> DataFrame:
    """One row per fold with its RMSE; sample weights come from the training folds only."""
    parts = []
    for k in range(folds):
        rest = df.where(F.col(fold) != k)
        if weighted:
            rest = rest.withColumn("weight", splits.sample_weight(rest, "label"))
        model = train(rest, name, weight="weight" if weighted else None, **params)
        parts.append(predict(model, df.where(F.col(fold) == k)))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return scored.groupBy(fold).agg(F.count("label").alias("n"), m.rmse("label", "prediction").alias("rmse"))


def cv_summary(per_fold: DataFrame) -> DataFrame:
    return per_fold.agg(F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"), F.sum("n").alias("n"))


def specialists(df: DataFrame, base: str, tiers=SPECIALIST_TIERS, at_least: int = 50, rounds: int | None = None) -> dict[str, Model]:
    """One boosted model per tier of the base premium. Small tiers grow shallower trees and fewer of them, and a
    leaf holds a fortieth of the tier at least. ``rounds`` fixes the number of trees for all tiers."""
    counts = df.agg(*[
        F.count_if((F.col(base) >= lo) & (F.col(base) < F.lit(hi))).alias(name) for name, lo, hi in tiers]).first()
    out = {}
    for name, lo, hi in tiers:
        n = counts[name]
        if n < at_least:
            continue
        rows = df.where((F.col(base) >= lo) & (F.col(base) < F.lit(hi)))
        out[name] = train(
            rows, "boosted", maxDepth=min(4, max(2, int(math.log2(n / 20 + 1)))), maxIter=rounds or min(500, max(200, n // 50 * 50)),
            minInstancesPerNode=max(5, n // 40), stepSize=0.02, subsamplingRate=0.8)
    return out


def with_specialists(df: DataFrame, models: dict[str, Model], base: str, tiers=SPECIALIST_TIERS) -> DataFrame:
    """A column per tier; a tier without a model repeats the base premium."""
    for name, _, _ in tiers:
        if name in models:
            df = predict(models[name], df, name)
        else:
            df = df.withColumn(name, F.col(base))
    return df


def importance(model: Model, df: DataFrame, inputs: Sequence[str] = INPUTS, top: int = 15) -> DataFrame:
    """Learned importance of every input, normalised to one."""
    if hasattr(model, "featureImportances"):
        raw = [float(v) for v in model.featureImportances.toArray()]
    else:
        raw = [abs(float(v)) for v in model.coefficients.toArray()]
    total = sum(raw) or 1.0
    rows = [(c, v / total) for c, v in zip(inputs, raw)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature").limit(top)


def with_next(df: DataFrame, columns: Sequence[str], seed: int, buckets: int | None = None) -> DataFrame:
    """Adds ``_next``: the columns' values of the next row in a random order of all rows (of the last row, those
    of the first), so every value is dealt exactly once.

    The order is that of a hash of the key. It is cut into ``buckets`` ranges of the hash, as many as the session
    has shuffle partitions; the last row of a range takes the first row of the next one that has rows, so the
    result doesn't depend on their number. One row per range meets in a single task.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = F.struct(*columns)
    rows = df.withColumn("_h", hash_key(KEY, seed)).withColumn(
        "_b", F.floor(F.col("_h").cast("double") / 2.0**60 * buckets).cast("int"))
    firsts = rows.groupBy("_b").agg(F.min_by(values, F.struct("_h", KEY)).alias("_first"))
    over = Window.partitionBy(F.lit(0)).orderBy("_b")
    firsts = firsts.select("_b", F.coalesce(F.lead("_first").over(over), F.first("_first").over(
        over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_after"))
    inside = Window.partitionBy("_b").orderBy("_h", KEY)
    return rows.withColumn("_lead", F.lead(values).over(inside)).join(firsts, "_b").withColumn(
        "_next", F.coalesce("_lead", "_after")).drop("_b", "_h", "_lead", "_after")


def permutation_importance(model: Model, df: DataFrame, inputs: Sequence[str] = INPUTS, repeats: int = 10, seed: int = 42) -> DataFrame:
    """Growth of RMSE when one input is permuted: mean and deviation over repeats.

    A repeat shuffles the table once; its rows are then expanded by the inputs within their task, each copy with
    one input permuted.
    """
    plain = predict(model, df).agg(m.rmse("label", "prediction")).first()[0]
    parts = None
    for r in range(repeats):
        copies = F.array(*[F.struct(F.lit(c).alias("feature"), *[(F.col(f"_next.{k}") if k == c else F.col(k)).alias(k) for k in inputs])
                           for c in inputs])
        mixed = with_next(df.select(KEY, "label", *inputs), inputs, seed + r).select("label", F.explode(copies).alias("c"))
        one = predict(model, mixed.select("label", "c.*")).groupBy("feature").agg(
            (m.rmse("label", "prediction") - F.lit(plain)).alias("gain"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("feature").agg(F.avg("gain").alias("mean"), F.stddev_pop("gain").alias("std"))


def partial_dependence(model: Model, df: DataFrame, inputs: Sequence[str], points: int = 20, sample: int | None = None) -> DataFrame:
    """Mean prediction along a grid of each input. Rows are expanded by a literal grid inside
    their task; ``sample`` keeps the rows with the smallest hashes."""
    rows = df if sample is None else df.orderBy(hash_key(KEY, 42)).limit(sample)
    ends = rows.agg(*[f(c).alias(f"{c}_{k}") for c in inputs for k, f in (("lo", F.min), ("hi", F.max))]).first()
    parts = None
    for c in inputs:
        lo, hi = ends[f"{c}_lo"], ends[f"{c}_hi"]
        grid = F.array(*[F.lit(lo + (hi - lo) * i / (points - 1)) for i in range(points)])
        grown = rows.withColumn(c, F.explode(grid))
        one = predict(model, grown).groupBy(F.col(c).alias("grid_value")).agg(
            F.avg("prediction").alias("mean_prediction"), F.count(F.lit(1)).alias("n")).withColumn("feature", F.lit(c))
        parts = one if parts is None else parts.unionByName(one)
    return parts.select("feature", "grid_value", "mean_prediction", "n")


def learning_curve(df: DataFrame, name: str, fractions: Sequence[float] = tuple(i / 10 for i in range(1, 11)), folds: int = 5, fold: str = "fold",
                   seed: int = 7, **params) -> DataFrame:
    """Train and validation RMSE as the training part grows. A fraction is the rows below an
    exact hash threshold, so larger parts contain the smaller ones. The seed must differ from
    that of the folds, which are ranges of their hash."""
    h = hash_key(KEY, seed)
    n, cuts = order_statistics(df, h, lambda k: [max(1, int(k * f)) for f in fractions])[()]
    inside = {f: h <= F.lit(cuts[max(1, int(n * f))]) for f in fractions}
    with kept(df.select(KEY, "label", fold, *INPUTS)) as rows:
        models = {f: [train(rows.where((F.col(fold) != k) & inside[f]), name, **params) for k in range(folds)] for f in fractions}
    # One scan a fraction judges the models of all folds: a row is expanded to the parts it belongs to.
    parts = None
    for f, fitted in models.items():
        rows = assembled(df)
        for k, model in enumerate(fitted):
            rows = model.copy({model.predictionCol: f"_p{k}"}).transform(rows)
        part = [F.when(F.col(fold) == k, "val").when((F.col(fold) != k) & inside[f], "train") for k in range(folds)]
        each = F.array(*[F.struct(F.lit(k).alias("fold"), part[k].alias("part"), F.col(f"_p{k}").alias("prediction")) for k in range(folds)])
        one = rows.select("label", F.inline(each)).where("part IS NOT NULL").groupBy("fold", "part").agg(
            m.rmse("label", "prediction").alias("rmse"), F.count("label").alias("n")).withColumn("fraction", F.lit(f))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("fraction", "part").agg(
        F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"), F.sum("n").alias("n"))


def tree_interval(model, df: DataFrame, level: float = 0.90) -> DataFrame:
    """Interval from the spread of a forest's trees: percentiles over the row's own array of
    tree predictions, so nothing is exploded or shuffled."""
    rows = assembled(df)
    names = []
    for i, tree in enumerate(model.trees):
        names.append(f"_t{i}")
        rows = tree.copy({tree.predictionCol: f"_t{i}"}).transform(rows)
    rows = rows.withColumn("_sorted", F.array_sort(F.array(*names))).drop(*names, "features")

    def at(p: float) -> Column:
        position = p * (len(names) - 1)
        k = int(position)
        low, high = F.col("_sorted")[k], F.col("_sorted")[min(k + 1, len(names) - 1)]
        return low + (high - low) * F.lit(position - k)

    return rows.withColumns({"lower": at((1 - level) / 2), "upper": at((1 + level) / 2),
                             "prediction": F.aggregate("_sorted", F.lit(0.0), lambda a, x: a + x) / len(names)}).drop("_sorted")
