"""Drift and monitoring queries."""

from pyspark.sql import functions as F

from ratebook.functions.columns import rounded
from ratebook.operators import drift, history
from ratebook.plans.registry import query
from ratebook.plans.sql import with_ctes
from ratebook.session import work_path
from ratebook.sources import portfolio


def long_sql(table):
    return (f"SELECT 'age' AS feature, CAST(age AS DOUBLE) AS value FROM {table} UNION ALL SELECT 'bmi', bmi FROM {table} "
            f"UNION ALL SELECT 'children', CAST(children AS DOUBLE) FROM {table} UNION ALL SELECT 'charges', charges FROM {table}")


def shares_sql(table):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS category, count(*)*1.0/(SELECT count(*) FROM {table}) AS share FROM {table} GROUP BY {c}"
        for c in ("sex", "smoker", "region"))


@query("l1_numeric_baseline", with_ctes("""
SELECT feature, count(value) AS n, round(avg(value),6) AS mean, round(stddev_samp(value),6) AS std, round(min(value),6) AS min, round(max(value),6) AS max,
 round(quantile_cont(value,0.25),6) AS q25, round(quantile_cont(value,0.5),6) AS q50, round(quantile_cont(value,0.75),6) AS q75 FROM melted GROUP BY feature""", melted=long_sql("policies")))
def numeric_baseline(spark, d):
    return rounded(drift.numeric_baseline(portfolio.policies(spark, d)), 6)


@query("l2_category_baseline", with_ctes("SELECT feature, category, round(share,8) AS share FROM sh", sh=shares_sql("policies")))
def category_baseline(spark, d):
    return rounded(drift.category_baseline(portfolio.policies(spark, d)), 8)


_Z = """b AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS std FROM melted GROUP BY feature), n AS (SELECT feature, avg(value) AS new_mean, count(value) AS n_new FROM later GROUP BY feature),
zz AS (SELECT b.feature, n_new, new_mean, mean AS base_mean, abs(new_mean-mean)/(std/sqrt(n_new)+1e-10) AS z FROM b JOIN n ON b.feature=n.feature WHERE n_new>=2)"""


@query("l3_numeric_drift", with_ctes(f", {_Z} SELECT feature, n_new, round(new_mean,6) AS new_mean, round(base_mean,6) AS base_mean, round(z,4) AS z, z>2.0 AS drifted FROM zz",
                                     melted=long_sql("policies"), later=long_sql("shifted")))
def numeric_drift(spark, d):
    base = drift.numeric_baseline(portfolio.policies(spark, d))
    return rounded(drift.numeric_drift(portfolio.shifted(spark, d), base), {"new_mean": 6, "base_mean": 6, "z": 4})


_TVD = """tv AS (SELECT coalesce(o.feature,w.feature) AS feature, sum(abs(coalesce(o.share,0.0)-coalesce(w.share,0.0)))*0.5 AS tvd, count(*) AS n_categories
 FROM sh o FULL OUTER JOIN later_sh w ON o.feature=w.feature AND o.category=w.category GROUP BY 1)"""


@query("l4_category_drift", with_ctes(f", {_TVD} SELECT feature, round(tvd,8) AS tvd, n_categories, tvd>0.05 AS drifted FROM tv",
                                      sh=shares_sql("policies"), later_sh=shares_sql("shifted")))
def category_drift(spark, d):
    base = drift.category_baseline(portfolio.policies(spark, d))
    return rounded(drift.category_drift(portfolio.shifted(spark, d), base), 8)


@query("l5_batch_comparison", with_ctes(f", {_Z}, {_TVD} SELECT feature, 'z' AS measure, round(z,4) AS value, z>2.0 AS drifted FROM zz UNION ALL SELECT feature, 'tvd', round(tvd,4), tvd>0.05 FROM tv",
                                        melted=long_sql("policies"), later=long_sql("shifted"), sh=shares_sql("policies"), later_sh=shares_sql("shifted")))
def batch_comparison(spark, d):
    return rounded(drift.compare_batches(portfolio.policies(spark, d), portfolio.shifted(spark, d)), 4)


@query("l6_missing_features", with_ctes("SELECT 'bmi' AS feature, count(*) AS n_rows FROM shifted UNION ALL SELECT 'region', count(*) FROM shifted"))
def missing_features(spark, d):
    """A delivery without two features: they are listed next to its row count."""
    new = portfolio.shifted(spark, d).drop("bmi", "region")
    names = F.array(*[F.lit(c) for c in drift.missing_features(new)])
    return new.agg(F.count(F.lit(1)).alias("n_rows")).select(F.explode(names).alias("feature"), "n_rows")


_SNAP = """sn AS (SELECT policy_id%12 AS batch, count(*) AS n, avg(abs(y_true-hybrid_pred)) AS mae, sqrt(avg((y_true-hybrid_pred)*(y_true-hybrid_pred))) AS rmse, avg(abs((y_true-hybrid_pred)/y_true))*100.0 AS mape,
 1.0-sum((y_true-hybrid_pred)*(y_true-hybrid_pred))/(var_pop(y_true)*count(*)+1e-10) AS r2, avg(hybrid_pred) AS mean_pred, stddev_pop(hybrid_pred) AS std_pred FROM scored GROUP BY 1)"""
_DIG = {"mae": 4, "rmse": 4, "mape": 6, "r2": 6, "mean_pred": 4, "std_pred": 4}
_SNAP_OUT = "batch, n, round(mae,4) AS mae, round(rmse,4) AS rmse, round(mape,6) AS mape, round(r2,6) AS r2, round(mean_pred,4) AS mean_pred, round(std_pred,4) AS std_pred"


def performance(spark, d):
    return drift.snapshots(portfolio.scored(spark, d).withColumn("batch", F.col("policy_id") % 12), "batch", p="hybrid_pred")


@query("l7_performance_snapshots", with_ctes(f", {_SNAP} SELECT {_SNAP_OUT} FROM sn"))
def performance_snapshots(spark, d):
    return rounded(performance(spark, d), _DIG)


@query("l8_degradation", with_ctes(f""", {_SNAP}
SELECT batch, round(mae,4) AS mae, round(rmse,4) AS rmse, round(r2,6) AS r2, concat_ws('|', CASE WHEN mae>1500 THEN 'mae' END, CASE WHEN rmse>9000 THEN 'rmse' END, CASE WHEN r2<0.95 THEN 'r2' END) AS reasons,
 mae>1500 OR rmse>9000 OR r2<0.95 AS degraded FROM sn WHERE batch=(SELECT max(batch) FROM sn)"""))
def degradation(spark, d):
    return rounded(drift.degradation(performance(spark, d), "batch", 1500.0, 9000.0, 0.95), _DIG)


@query("l9_metric_history", with_ctes("""
, hs AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2),
o AS (SELECT *, strftime(day,'%Y-%m-%d')||event_type AS entry FROM hs)
SELECT entry, n, round(mean,6) AS mean FROM o ORDER BY entry DESC LIMIT 100"""))
def metric_history(spark, d):
    """Daily request snapshots, written by two evaluations of which one runs twice, then compacted; the newest hundred."""
    log = portfolio.request_log(spark, d)
    daily = log.groupBy(F.to_date("ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("latency").alias("mean"))
    entries = daily.select(F.concat(F.date_format("day", "yyyy-MM-dd"), "event_type").alias("entry"), "n", "mean")
    odd = F.dayofmonth(F.to_date(F.substring("entry", 1, 10))) % 2 == 1
    entries = entries.withColumns({"period": F.substring("entry", 1, 7), "evaluation": F.when(odd, "odd days").otherwise("even days")})
    schema = "entry string, n long, mean double, period string, evaluation string"
    path = work_path(spark, "metric-history")
    for part in (~odd, odd, ~odd):  # the first evaluation is retried
        history.upsert(entries.where(part), path)
    last = entries.agg(F.max("period")).first()[0]
    if last:
        history.compact(spark, path, schema, last)
    return rounded(history.newest(spark, path, schema, "entry").select("entry", "n", "mean"), 6)


@query("l11_request_metrics", with_ctes("""
, t AS (SELECT count(*) FILTER (NOT rejected) AS total, count(*) FILTER (NOT ok AND NOT rejected) AS errors, count(*) FILTER (rejected) AS rejected FROM requests),
l AS (SELECT latency FROM requests WHERE NOT rejected ORDER BY ts DESC, event_id DESC LIMIT 1000),
s AS (SELECT count(latency) AS samples, avg(latency) AS mean, quantile_cont(latency,0.5) AS p50, quantile_cont(latency,0.95) AS p95, quantile_cont(latency,0.99) AS p99 FROM l)
SELECT total, total-errors AS successful, errors, round(errors*100.0/total,6) AS error_pct, rejected, samples, round(mean,6) AS mean, round(p50,6) AS p50, round(p95,6) AS p95, round(p99,6) AS p99 FROM t, s"""))
def request_metrics(spark, d):
    return rounded(drift.request_metrics(portfolio.request_log(spark, d)), 6)
