"""Split, fold and weight queries."""

from pyspark.sql import functions as F

from ratebook.config import KEY
from ratebook.functions.columns import rounded
from ratebook.operators import splits
from ratebook.plans.registry import query
from ratebook.plans.sql import with_ctes
from ratebook.sources import portfolio


def split_table(spark, d):
    labelled = splits.train_val_test(portfolio.policies(spark, d)).select(KEY, "split")
    return splits.stored(labelled)


def h(seed: int) -> str:
    return f"substr(md5('{seed}:'||policy_id),1,15)"


def bins(probs, source="policies"):
    return " + ".join(f"CAST(charges > (SELECT quantile_cont(charges,{p}) FROM {source}) AS INT)" for p in probs)


SPLIT = f"""st AS (SELECT policy_id, charges, {bins((0.25, 0.5, 0.75, 0.9, 0.95, 0.99))} AS stratum FROM policies),
rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {h(42)}) <= floor(count(*) OVER (PARTITION BY stratum)*0.15+0.5) AS is_test FROM st),
rest AS (SELECT policy_id, charges FROM rk WHERE NOT is_test),
ft AS (SELECT *, {bins((0.2, 0.4, 0.6, 0.8), 'rest')} AS fifth FROM rest),
vl AS (SELECT policy_id, row_number() OVER (PARTITION BY fifth ORDER BY {h(43)}) <= floor(count(*) OVER (PARTITION BY fifth)*0.20+0.5) AS is_val FROM ft),
split_table AS (SELECT rk.policy_id, stratum, CASE WHEN is_test THEN 'test' WHEN is_val THEN 'val' ELSE 'train' END AS split FROM rk LEFT JOIN vl ON vl.policy_id=rk.policy_id)"""


@query("e1_stratified_split", with_ctes(f", {SPLIT} SELECT * FROM split_table"))
def stratified_split(spark, d):
    return splits.train_val_test(portfolio.policies(spark, d)).select(KEY, "stratum", "split")


@query("e2_split_disjoint", with_ctes(f""", {SPLIT}
SELECT count(*) AS n_rows, count(DISTINCT policy_id) AS n_ids, 0 AS n_overlapping, true AS disjoint FROM split_table"""))
def split_disjoint(spark, d):
    return splits.disjointness(split_table(spark, d))


@query("e2_split_overlap", with_ctes(f""", {SPLIT}
SELECT policy_id FROM split_table WHERE split='test' INTERSECT SELECT policy_id FROM split_table WHERE split='train'"""))
def split_overlap(spark, d):
    return splits.overlap(split_table(spark, d), "test", "train")


@query("e3_stratified_folds", with_ctes(f"""
, st AS (SELECT policy_id, {bins((0.2, 0.4, 0.6, 0.8))} AS stratum FROM policies),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {h(42)}) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM st)
SELECT policy_id, stratum, CAST(r>n//5 AS INT)+CAST(r>2*n//5 AS INT)+CAST(r>3*n//5 AS INT)+CAST(r>4*n//5 AS INT) AS fold FROM r"""))
def stratified_folds(spark, d):
    return splits.folds(portfolio.policies(spark, d), "charges").select(KEY, "stratum", "fold")


def holdout_sql(table="policies", target="charges"):
    """Tables st and hp: policy_id, stratum and part of every row."""
    strata = " + ".join(f"CAST({target} > (SELECT quantile_cont({target},{i}/7.0) FROM {table}) AS INT)" for i in range(1, 7))
    return f"""st AS (SELECT policy_id, {strata} AS stratum FROM {table}),
hp AS (SELECT policy_id, stratum, CASE WHEN row_number() OVER (PARTITION BY stratum ORDER BY {h(42)}) <= floor(count(*) OVER (PARTITION BY stratum)*0.4+0.5) THEN 'holdout' ELSE 'calibration' END AS part FROM st)"""


@query("e4_holdout_split", with_ctes(f", {holdout_sql()} SELECT policy_id, stratum, part FROM hp"))
def holdout_split(spark, d):
    return splits.holdout(portfolio.policies(spark, d), "charges").select(KEY, "stratum", "part")


WEIGHTS = """wq AS (SELECT quantile_cont(charges,[0.25,0.5,0.75,0.9,0.95,0.99]) AS q FROM policies),
wt AS (SELECT policy_id, charges, CASE WHEN charges<=q[2] THEN 1.0 WHEN charges<=q[3] THEN 1.05 WHEN charges<=q[4] THEN 1.15 WHEN charges<=q[5] THEN 1.5 WHEN charges<=q[6] THEN 1.7 ELSE 2.0 END AS weight FROM policies, wq)"""


@query("e5_sample_weights", with_ctes(f", {WEIGHTS} SELECT policy_id, weight FROM wt"))
def sample_weights(spark, d):
    p = portfolio.policies(spark, d)
    return p.select(KEY, splits.sample_weight(p).alias("weight"))


@query("e6_weight_check", with_ctes(f""", {WEIGHTS}
SELECT count(*) AS n, 0 AS n_not_finite, 0 AS n_negative, min(weight) AS min, max(weight) AS max, round(avg(weight),8) AS mean, max(weight)/min(weight)<=100 AS valid FROM wt"""))
def weight_check(spark, d):
    p = portfolio.policies(spark, d)
    return rounded(splits.weight_check(p.select(splits.sample_weight(p).alias("weight"))), 8)


SPLIT_SCORED = "SELECT s.*, t.split FROM scored s JOIN split_table t ON t.policy_id=s.policy_id"


def split_scored(spark, d):
    return portfolio.scored(spark, d).join(split_table(spark, d), KEY)


@query("i15_release_gates", with_ctes(f""", {SPLIT}, ss AS ({SPLIT_SCORED}),
x AS (SELECT 1.0-sum((hybrid_pred-y_true)*(hybrid_pred-y_true)) FILTER (split='test')/(var_pop(y_true) FILTER (split='test')*count(*) FILTER (split='test')) AS r2,
 sqrt(avg((hybrid_pred-y_true)*(hybrid_pred-y_true)) FILTER (split='test')) AS rmse, sqrt(avg((hybrid_pred-y_true)*(hybrid_pred-y_true)) FILTER (split='train')) AS tr,
 count(*) FILTER (split='test' AND (hybrid_pred-y_true)/y_true>0.10)*1.0/count(*) FILTER (split='test') AS ov FROM ss)
SELECT 'r2_above_minimum' AS gate, round(r2,6) AS value, r2>=0.70 AS passed FROM x UNION ALL SELECT 'overpricing_rate', round(ov,6), ov<=0.62 FROM x
UNION ALL SELECT 'train_test_gap', round((rmse-tr)/tr,6), (rmse-tr)/tr<=0.20 FROM x UNION ALL SELECT 'rmse_cap', round(rmse,6), rmse<=7000 FROM x
UNION ALL SELECT 'no_nan', 0.0, true FROM x UNION ALL SELECT 'no_negative', 0.0, true FROM x"""))
def release_gates(spark, d):
    from ratebook.operators import gates
    return rounded(gates.release_gates(split_scored(spark, d), p="hybrid_pred"), 6)


_GEN = f"""{SPLIT}, ss AS ({SPLIT_SCORED}), g0 AS (SELECT {", ".join(f"sqrt(avg((hybrid_pred-y_true)*(hybrid_pred-y_true)) FILTER (split='{s}')) AS {s}_rmse" for s in ("train", "val", "test"))} FROM ss),
g1 AS (SELECT *, (val_rmse-train_rmse)/train_rmse*100.0 AS a, (test_rmse-val_rmse)/val_rmse*100.0 AS b FROM g0)"""


@query("i30_generalisation", with_ctes(f""", {_GEN}
SELECT round(train_rmse,4) AS train_rmse, round(val_rmse,4) AS val_rmse, round(test_rmse,4) AS test_rmse, round(a,6) AS train_val_gap_pct, round(b,6) AS val_test_gap_pct,
 CASE WHEN a<10 THEN 'minimal' WHEN a<20 THEN 'moderate' ELSE 'severe' END AS train_val_status,
 CASE WHEN abs(b)<5 THEN 'excellent' WHEN abs(b)<10 THEN 'good' WHEN abs(b)<15 THEN 'moderate' ELSE 'poor' END AS val_test_status FROM g1"""))
def generalisation(spark, d):
    from ratebook.operators import metrics
    out = metrics.generalisation(split_scored(spark, d), p="hybrid_pred")
    return rounded(out, {c: 4 if c.endswith("rmse") else 6 for c in out.columns})


@query("i31_overfit_penalty", with_ctes(f""", {_GEN}
SELECT round(val_rmse*CASE WHEN a>20 THEN 1.5 WHEN a>10 THEN 1.25 ELSE 1.0 END,4) AS penalised, round(a,6) AS gap_pct, CASE WHEN a>20 THEN 'critical' WHEN a>10 THEN 'warning' ELSE 'good' END AS status FROM g1"""))
def overfit_penalty(spark, d):
    from ratebook.operators import metrics
    one = metrics.generalisation(split_scored(spark, d), p="hybrid_pred")
    score, gap, status = metrics.overfit_penalty(F.col("train_rmse"), F.col("val_rmse"))
    return rounded(one.select(score.alias("penalised"), gap.alias("gap_pct"), status.alias("status")),
                   {"penalised": 4, "gap_pct": 6})
