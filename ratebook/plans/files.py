"""Source and sink queries: written to the shared folder and read back."""

import json

from pyspark.sql import functions as F

from ratebook.config import KEY, POLICY_COLUMNS
from ratebook.functions.columns import rounded
from ratebook.operators import metrics, pricing, splits, validation
from ratebook.plans.metrics import SWEEP, DIGITS
from ratebook.plans.registry import query
from ratebook.plans.splits import SPLIT, split_table
from ratebook.plans.sql import ACT, with_ctes
from ratebook.plans.validation import CHECKED, _age, _bmi, _kids
from ratebook.session import work_path
from ratebook.sources import files, portfolio
from ratebook.streaming.scoring import scored_records


@query("a1_load_policies", with_ctes("SELECT policy_id, age, sex, bmi, children, smoker, region, round(charges,6) AS charges FROM policies"))
def load_policies(spark, d):
    path = work_path(spark, "policies-csv")
    files.write_policies(portfolio.policies(spark, d), path)
    return rounded(files.read_policies(spark, path), {"charges": 6})


@query("a2_column_contract", with_ctes("SELECT col AS \"column\", true AS present, n AS n_filled FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS col, count({c}) AS n FROM policies" for c in POLICY_COLUMNS) + ")"))
def column_contract(spark, d):
    p = validation.require_columns(portfolio.policies(spark, d))
    counts = p.agg(*[F.count(c).alias(c) for c in POLICY_COLUMNS])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(c in p.columns).alias("present"), F.col(c).alias("n_filled"))
        for c in POLICY_COLUMNS])))


@query("a4_write_scored", with_ctes(f"""
, ok AS (SELECT policy_id, CAST({_age} AS INT) AS age, {_bmi} AS bmi, CAST({_kids} AS INT) AS children, smoker, region, errors FROM checked WHERE errors = '')
SELECT 'success' AS status, count(*) AS n, round(sum({ACT}),2) AS total_premium FROM ok UNION ALL SELECT 'error', count(*), NULL FROM checked WHERE errors <> ''""", checked=CHECKED))
def write_scored(spark, d):
    path = work_path(spark, "scored")
    files.write_scored(scored_records(portfolio.raw_records(spark, d)), path)
    out = spark.read.parquet(path).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("premium").alias("total_premium"))
    return rounded(out, 2)


@query("a5_bias_state", with_ctes("""
, q AS (SELECT quantile_cont(y_true,0.5) AS c FROM scored), r AS (SELECT ln(1+y_true)-ln(1+ml_pred) AS e, y_true<c AS lo, c FROM scored, q),
v AS (SELECT round(var_samp(e) FILTER (lo),8) AS l, round(var_samp(e) FILTER (NOT lo),8) AS h, round(var_samp(e),8) AS m, round(max(c),4) AS t FROM r)
SELECT 'plain' AS name, l AS var_low, CAST(NULL AS DOUBLE) AS var_mid, h AS var_high, t AS threshold, CAST(NULL AS DOUBLE) AS threshold_low, CAST(NULL AS DOUBLE) AS threshold_high FROM v
UNION ALL SELECT 'three_tier', l, m, h, t, t, round(t*2,4) FROM v UNION ALL SELECT 'wrapped', l, NULL, h, t, NULL, NULL FROM v UNION ALL SELECT 'legacy', l, NULL, h, t, NULL, NULL FROM v"""))
def bias_state(spark, d):
    """A fitted correction stored in every known form, with one that was not applied, and read back."""
    fit = pricing.fit_variance_bias(portfolio.scored(spark, d), p="ml_pred")
    low, high, cut = fit["var_low"], fit["var_high"], fit["threshold"]
    plain = {"var_low": low, "var_high": high, "threshold": cut}
    stored = [
        {"name": "plain", **plain},
        {"name": "three_tier", "var_low": low, "var_mid": fit["var_all"], "var_high": high, "threshold_low": cut, "threshold_high": cut * 2},
        {"name": "wrapped", "applied": True, "correction_params": plain},
        {"name": "legacy", "_bias_var_low": low, "_bias_var_high": high, "_bias_threshold": cut},
        {"name": "not_applied", "applied": False, "correction_params": None},
    ]
    path = work_path(spark, "bias")
    spark.createDataFrame([(json.dumps(s),) for s in stored], "value string").write.text(path)
    out = files.read_bias(spark, path)
    return rounded(out, {c: 8 if c.startswith("var") else 4 for c in out.columns})


@query("a6_replay_holdout", with_ctes(f""", {SPLIT}
SELECT policy_id, round(charges,6) AS charges FROM policies SEMI JOIN (SELECT policy_id FROM split_table WHERE split='test') USING (policy_id)"""))
def replay_holdout(spark, d):
    held = split_table(spark, d).where(F.col("split") == "test")
    return rounded(splits.replay_strict(portfolio.policies(spark, d), held).select(KEY, "charges"), {"charges": 6})


@query("a6_vanished_ids", with_ctes(f""", {SPLIT}
SELECT policy_id FROM split_table WHERE split='test' AND policy_id NOT IN (SELECT policy_id FROM policies WHERE smoker='no')"""))
def vanished_ids(spark, d):
    """Held-out ids that a later delivery without smokers no longer has."""
    held = split_table(spark, d).where(F.col("split") == "test")
    return splits.vanished(portfolio.policies(spark, d).where(F.col("smoker") == "no"), held)


@query("a7_comparison_table", with_ctes(SWEEP + """
SELECT position, name, round(rmse,4) AS rmse, round(total_net_profit,2) AS total_net_profit, round(business_score,6) AS business_score FROM sw"""))
def comparison_table(spark, d):
    path = work_path(spark, "comparison")
    sweep = rounded(metrics.config_sweep(portfolio.scored(spark, d)), DIGITS)
    files.write_report(sweep.select("position", "name", "rmse", "total_net_profit", "business_score"), path)
    return spark.read.option("header", True).schema(
        "position int, name string, rmse double, total_net_profit double, business_score double").csv(path)
