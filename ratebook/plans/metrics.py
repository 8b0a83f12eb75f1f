"""Metric, economics and gate queries."""

from pyspark.sql import functions as F

from ratebook.config import FOUR_TIERS, GATE_TIERS, SEGMENTS
from ratebook.functions import moments as m
from ratebook.functions.columns import rounded
from ratebook.operators import gates, metrics, ranks, validation
from ratebook.functions import features
from ratebook.functions.normal import normal_quantile_sql
from ratebook.plans.registry import query
from ratebook.plans.sql import with_ctes
from ratebook.sources import portfolio

MODELS = {"ml": "ml_pred", "hybrid": "hybrid_pred"}


def hybrid(spark, d):
    return portfolio.scored(spark, d).withColumn("price", F.col("hybrid_pred"))


def stacked(spark, d):
    return metrics.stacked(portfolio.scored(spark, d), MODELS)


HYBRID = "SELECT policy_id, y_true, ml_pred, act_pred, hybrid_pred, hybrid_pred AS price FROM scored"


def r2_sql(y="y_true", p="price"):
    return (f"CASE WHEN count(*) < 2 THEN NULL WHEN var_pop({y}) > 0 THEN 1.0 - sum(({p}-{y})*({p}-{y}))/(var_pop({y})*count(*)) "
            f"WHEN sum(({p}-{y})*({p}-{y})) = 0 THEN 1.0 ELSE 0.0 END")


def rmse_sql(y="y_true", p="price"):
    return f"sqrt(avg(({p}-{y})*({p}-{y})))"


def accuracy_sql(y="y_true", p="price"):
    return f"""count(*) AS n, round({rmse_sql(y, p)}, 4) AS rmse, round(avg(abs({p}-{y})), 4) AS mae,
  round(avg(abs({p}-{y})/greatest(abs({y}), 2.220446049250313e-16))*100.0, 6) AS mape,
  round(coalesce(avg(abs({p}-{y})/((abs({y})+abs({p}))/2.0)) FILTER ((abs({y})+abs({p}))/2.0 > 0.01)*100.0, 0.0), 6) AS smape,
  round(avg(abs(ln({y})-ln({p}))), 6) AS male, round({r2_sql(y, p)}, 6) AS r2,
  round(avg({y}), 4) AS mean_true, round(avg({p}), 4) AS mean_pred, round(avg({p}-{y}), 4) AS mean_error,
  round(stddev_pop({p}-{y}), 4) AS std_error"""


MEDIAN_ERROR = "round(quantile_cont(price-y_true, 0.5), 4) AS median_error"
ACCURACY_DIGITS = {"rmse": 4, "mae": 4, "mape": 6, "smape": 6, "male": 6, "r2": 6, "mean_true": 4, "mean_pred": 4,
                   "mean_error": 4, "std_error": 4, "median_error": 4}

PPP = "sum(net_profit)/count(*)"
CHURN = "sum(churn_probability)/count(*)"
SCORE = f"""(CASE WHEN {PPP}/680.0 >= 1 THEN 50.0 WHEN {PPP} >= 0 THEN 25.0 + {PPP}/680.0*25.0 ELSE greatest(-50.0, {PPP}/680.0*25.0) END
  + CASE WHEN {CHURN} <= 0.10 THEN 30.0*(1.0-0.5*({CHURN})/0.10) WHEN {CHURN} <= 0.20 THEN 15.0*(1.0-({CHURN}-0.10)/0.10) ELSE 0.0 END
  + count(*) FILTER (accurate)*20.0/count(*))"""
PORTFOLIO = f"""round(sum(revenue), 2) AS total_revenue, round(sum(y_true), 2) AS total_claims, round(count(*)*25.0, 2) AS total_admin,
  round(sum(gross_profit), 2) AS total_gross_profit, round(sum(gross_profit)/sum(revenue)*100.0, 6) AS gross_margin_pct,
  round(sum(churn_cost), 2) AS total_churn_cost, round(sum(underpricing_penalty), 2) AS total_underpricing_penalty,
  round(sum(accuracy_bonus), 2) AS total_accuracy_bonus, round(sum(net_profit), 2) AS total_net_profit,
  round(sum(net_profit)/sum(revenue)*100.0, 6) AS net_margin_pct, round({PPP}, 4) AS profit_per_policy,
  round(sum(churn_probability), 4) AS expected_churned, round({CHURN}*100.0, 6) AS churn_rate_pct,
  count(*) FILTER (error < 0) AS n_underpriced, count(*) FILTER (error > 0) AS n_overpriced,
  count(*) FILTER (accurate) AS n_accurate, round(count(*) FILTER (accurate)*100.0/count(*), 6) AS accuracy_rate_pct,
  round({SCORE}, 6) AS business_score"""
MONEY_DIGITS = {
    **{k: 2 for k in ("total_revenue", "total_claims", "total_admin", "total_gross_profit", "total_churn_cost",
                      "total_underpricing_penalty", "total_accuracy_bonus", "total_net_profit")},
    "gross_margin_pct": 6, "net_margin_pct": 6, "profit_per_policy": 4, "expected_churned": 4, "churn_rate_pct": 6,
    "accuracy_rate_pct": 6, "business_score": 6}
DIGITS = {**ACCURACY_DIGITS, **MONEY_DIGITS}

SEGMENT = """CASE WHEN y_true <= 4500 THEN 'low_risk' WHEN y_true <= 15000 THEN 'standard'
  WHEN y_true <= 30000 THEN 'high_risk' ELSE 'catastrophic' END"""
GATE = """CASE WHEN y_true < 0 THEN NULL WHEN y_true <= 5000 THEN 'Low' WHEN y_true <= 10000 THEN 'Mid'
  WHEN y_true <= 14000 THEN 'High' WHEN y_true <= 16701 THEN 'High+' ELSE 'Very High' END"""


@query("flagship_portfolio", with_ctes(f"""
, duo AS (SELECT policy_id, 'actuarial' AS model, y_true, act_pred AS price FROM scored
  UNION ALL SELECT policy_id, 'hybrid', y_true, hybrid_pred FROM scored),
e1 AS (SELECT *, price-y_true AS error, (price-y_true)/y_true AS share, price*1.15 AS revenue, price-y_true+0.15*price-25.0 AS gross_profit FROM duo),
e2 AS (SELECT *, CASE WHEN error>0 THEN least(greatest(share-0.40,0.0),0.80) ELSE 0.0 END AS churn_probability,
  CASE WHEN error<0 THEN least(abs(error)*0.3, revenue*0.2)+CASE WHEN abs(share)>0.5 THEN 200.0 ELSE 0.0 END ELSE 0.0 END AS penalty,
  CASE WHEN abs(share)<=0.15 THEN 150.0 WHEN abs(share)<=0.30 THEN 75.0 ELSE 0.0 END AS bonus FROM e1),
e3 AS (SELECT *, gross_profit-churn_probability*(y_true*1.5+200.0)-penalty+bonus AS net_profit, {SEGMENT} AS band FROM e2)
SELECT model, coalesce(band, 'overall') AS band, count(*) AS n, round(sum(net_profit), 2) AS total_net_profit, round({PPP}, 4) AS profit_per_policy,
  round({CHURN}*100.0, 6) AS churn_rate_pct, round(avg(CASE WHEN error>0 THEN 1.0 ELSE 0.0 END), 6) AS overpricing_rate,
  round({rmse_sql()}, 4) AS rmse FROM e3 GROUP BY GROUPING SETS ((model), (model, band))"""))
def flagship(spark, d):
    """Validated policies, priced twice, with profit, churn and overpricing per band."""
    valid, _ = validation.split_valid(portfolio.policies(spark, d))
    priced = portfolio.with_ml_prediction(valid).withColumn("act_pred", portfolio.actuarial_premium())
    priced = priced.withColumn("hybrid_pred", portfolio.blend("ml_pred", "act_pred").final)
    rows = metrics.stacked(
        priced.withColumnRenamed("charges", "y_true"), {"actuarial": "act_pred", "hybrid": "hybrid_pred"})
    money = m.portfolio(only=("total_net_profit", "profit_per_policy", "churn_rate_pct"))
    out = rows.withColumn("band", metrics.tier("y_true", SEGMENTS)).groupingSets(
        [["model"], ["model", "band"]], "model", "band").agg(
        F.count(F.lit(1)).alias("n"),
        *m.named(money), m.share(F.col("price") > F.col("y_true")).alias("overpricing_rate"), m.rmse("y_true", "price").alias("rmse"))
    return rounded(out.withColumn("band", F.coalesce("band", F.lit("overall"))), {**DIGITS, "overpricing_rate": 6})


@query("i1_i2_accuracy", with_ctes(f"SELECT model, {accuracy_sql()}, {MEDIAN_ERROR} FROM stacked GROUP BY model"))
def accuracy(spark, d):
    return rounded(metrics.accuracy_report(stacked(spark, d), by=["model"]), DIGITS)


_MOM = """, r AS (SELECT y_true-price AS e, y_true, price FROM hy), c AS (SELECT avg(e) AS mu FROM r),
k AS (SELECT count(*)*1.0 AS n, avg(e) AS mean, stddev_pop(e) AS sd, avg((e-mu)*(e-mu)*(e-mu))/pow(var_pop(e),1.5) AS sk,
  avg((e-mu)*(e-mu)*(e-mu)*(e-mu))/pow(var_pop(e),2) - 3.0 AS ku FROM r, c)"""


@query("i3_training_metrics", with_ctes(_MOM + f""",
a AS (SELECT count(*) AS n, avg(e*e) AS mse, {rmse_sql()} AS rmse, avg(abs(e)) AS mae, avg(abs(e)/greatest(abs(y_true),1.0))*100.0 AS mape,
  {r2_sql()} AS r2 FROM r)
SELECT a.n, round(mse,2) AS mse, round(rmse,4) AS rmse, round(mae,4) AS mae, round(mape,6) AS mape, round(r2,6) AS r2,
  round(1.0-(1.0-r2)*(a.n-1)/(a.n-46-1),6) AS adjusted_r2, round(mean,4) AS residual_mean, round(sd,4) AS residual_std,
  round(sk*sqrt(k.n*(k.n-1))/(k.n-2),6) AS residual_skewness,
  round(((k.n+1)*ku+6)*(k.n-1)/((k.n-2)*(k.n-3)),6) AS residual_kurtosis FROM a, k""", hy=HYBRID))
def training_metrics(spark, d):
    return rounded(metrics.training_metrics(hybrid(spark, d), n_features=46), {
        **DIGITS, "mse": 2, "adjusted_r2": 6, "residual_mean": 4, "residual_std": 4, "residual_skewness": 6, "residual_kurtosis": 6})


@query("i4_policy_economics", with_ctes("""
SELECT policy_id, model, round(revenue,8) AS revenue, round(gross_profit,8) AS gross_profit, round(churn_probability,8) AS churn_probability,
  round(churn_cost,8) AS churn_cost, round(underpricing_penalty,8) AS underpricing_penalty, accuracy_bonus, round(net_profit,8) AS net_profit
FROM economics"""))
def policy_economics(spark, d):
    out = metrics.economics(stacked(spark, d)).drop("y_true", "price")
    return rounded(out, 8)  # prices carry seven decimals: coarser rounding would meet exact ties


@query("i5_i6_portfolio", with_ctes(f"SELECT model, count(*) AS n, {PORTFOLIO} FROM economics GROUP BY model"))
def portfolio_report(spark, d):
    return rounded(metrics.portfolio_report(stacked(spark, d), by=["model"]), DIGITS)


@query("i7_business_segments", with_ctes(f"""
, s AS (SELECT *, {SEGMENT} AS segment FROM economics WHERE model='hybrid')
SELECT segment, {accuracy_sql()}, {MEDIAN_ERROR}, round(sum(net_profit), 2) AS total_net_profit, round({PPP}, 4) AS profit_per_policy,
  round({CHURN}*100.0, 6) AS churn_rate_pct, round(count(*)*100.0/(SELECT count(*) FROM s), 6) AS pct_of_total FROM s GROUP BY segment"""))
def business_segments(spark, d):
    return rounded(metrics.segment_report(hybrid(spark, d)), {**DIGITS, "pct_of_total": 6})


@query("i7_quantile_segments", with_ctes(f"""
, q AS (SELECT quantile_cont(y_true,0.5) AS a, quantile_cont(y_true,0.75) AS b, quantile_cont(y_true,0.95) AS c FROM scored),
s AS (SELECT e.*, CASE WHEN y_true<=a THEN 'low' WHEN y_true<=b THEN 'mid' WHEN y_true<=c THEN 'high' ELSE 'extreme' END AS segment
  FROM economics e, q WHERE model='hybrid')
SELECT segment, {accuracy_sql()}, {MEDIAN_ERROR}, round(sum(net_profit), 2) AS total_net_profit, round({PPP}, 4) AS profit_per_policy,
  round({CHURN}*100.0, 6) AS churn_rate_pct, round(count(*)*100.0/(SELECT count(*) FROM s), 6) AS pct_of_total FROM s GROUP BY segment"""))
def quantile_segments(spark, d):
    h = hybrid(spark, d)
    return rounded(metrics.segment_report(h, metrics.quantile_tiers(h)), {**DIGITS, "pct_of_total": 6})


def _gate_sql(segment):
    return f"""
, s AS (SELECT *, {segment} AS segment FROM hy), g AS (SELECT segment, count(*) AS n, {rmse_sql()} AS rmse, avg(abs(price-y_true)) AS mae, {r2_sql()} AS r2,
  avg(CASE WHEN price>y_true THEN 1.0 ELSE 0.0 END) AS overpricing_rate, avg(y_true) AS mean_true, avg(price) AS mean_pred,
  avg(price-y_true) AS mean_error, quantile_cont(price-y_true,0.5) AS median_error FROM s WHERE segment IS NOT NULL GROUP BY segment)
SELECT segment, n, round(rmse,4) AS rmse, round(mae,4) AS mae, round(r2,6) AS r2, round(overpricing_rate,6) AS overpricing_rate,
  round(mean_true,4) AS mean_true, round(mean_pred,4) AS mean_pred, round(mean_error,4) AS mean_error, round(median_error,4) AS median_error,
  round(n*100.0/(SELECT sum(n) FROM g),6) AS pct_of_total, coalesce(r2 < -1,false) AND n<30 AS advisory, coalesce(r2 < -1,false) AND n>=30 AS veto FROM g"""


@query("i8_gate_segments", with_ctes(_gate_sql(GATE), hy=HYBRID))
def gate_segments(spark, d):
    return rounded(metrics.gate_segment_report(hybrid(spark, d)), {**DIGITS, "overpricing_rate": 6, "pct_of_total": 6})


@query("i8_stored_gate_segments", with_ctes(_gate_sql("""CASE WHEN y_true < 0 THEN NULL WHEN y_true <= (SELECT quantile_cont(y_true,0.5) FROM scored)/2 THEN 'Low'
  WHEN y_true <= (SELECT quantile_cont(y_true,0.5) FROM scored) THEN 'Mid' WHEN y_true <= (SELECT quantile_cont(y_true,0.75) FROM scored) THEN 'High'
  WHEN y_true <= 16701 THEN 'High+' ELSE 'Very High' END"""), hy=HYBRID))
def stored_gate_segments(spark, d):
    h = hybrid(spark, d)
    q50, q75 = metrics.quantiles(h, "y_true", [0.5, 0.75])
    return rounded(metrics.gate_segment_report(h, metrics.stored_gate_tiers(q50, q75)),
                   {**DIGITS, "overpricing_rate": 6, "pct_of_total": 6})


@query("i9_comprehensive", with_ctes(f"""
, s AS (SELECT *, CASE WHEN y_true < 4500 THEN 'low_value' ELSE 'high_value' END AS band FROM economics)
SELECT model, coalesce(band,'overall') AS band, {accuracy_sql()}, {MEDIAN_ERROR}, {PORTFOLIO} FROM s GROUP BY GROUPING SETS ((model),(model,band))"""))
def comprehensive(spark, d):
    return rounded(metrics.comprehensive(portfolio.scored(spark, d), MODELS), DIGITS)


@query("i10_asymmetric_cost", with_ctes("""
, s AS (SELECT price-y_true AS g FROM hy), t AS (SELECT coalesce(sum(-g) FILTER (g<0),0.0)*0.3 AS u, coalesce(sum(g) FILTER (g>0),0.0) AS o, count(*) AS n,
 count(*) FILTER (g<0) AS nu, count(*) FILTER (g>0) AS no_, avg(-g) FILTER (g<0) AS au, avg(g) FILTER (g>0) AS ao FROM s)
SELECT round(u+o,2) AS total_cost, round((u+o)/n,4) AS cost_per_policy, round(u,2) AS underpricing_cost, round(o,2) AS overpricing_cost,
 nu AS n_underpriced, no_ AS n_overpriced, round(nu*100.0/n,6) AS underpricing_pct, round(coalesce(au,0.0),4) AS avg_underprice, round(coalesce(ao,0.0),4) AS avg_overprice FROM t""", hy=HYBRID))
def asymmetric_cost(spark, d):
    return rounded(metrics.asymmetric_cost(hybrid(spark, d)), {
        "total_cost": 2, "cost_per_policy": 4, "underpricing_cost": 2, "overpricing_cost": 2, "underpricing_pct": 6,
        "avg_underprice": 4, "avg_overprice": 4})


def _w(four=False):
    mid = "" if four else " WHEN y_true <= 14000 THEN 2.5"
    upper = "2.5" if four else "3.2"
    return f"CASE WHEN y_true <= 5000 THEN 1.0 WHEN y_true <= 10000 THEN 1.5{mid} WHEN y_true <= 16701 THEN {upper} ELSE 4.0 END"


def _wr2(four=False):
    return f"""w AS (SELECT *, {_w(four)} AS w FROM stacked), mu AS (SELECT model, sum(w*y_true)/sum(w) AS mu FROM w GROUP BY model),
wr AS (SELECT w.model, 1.0 - sum(w*(y_true-price)*(y_true-price))/sum(w*(y_true-mu)*(y_true-mu)) AS weighted_r2 FROM w JOIN mu ON w.model=mu.model GROUP BY w.model)"""


@query("i11_weighted_r2", with_ctes(f", {_wr2()} SELECT model, round(weighted_r2,6) AS weighted_r2 FROM wr"))
def weighted_r2(spark, d):
    return rounded(metrics.weighted_r2(stacked(spark, d), by=["model"]), 6)


@query("i11_weighted_r2_four_tiers", with_ctes(f", {_wr2(True)} SELECT model, round(weighted_r2,6) AS weighted_r2 FROM wr"))
def weighted_r2_four(spark, d):
    return rounded(metrics.weighted_r2(stacked(spark, d), FOUR_TIERS, by=["model"]), 6)


_TIERS = f"""tt AS (SELECT {GATE} AS segment, count(*) AS n, {r2_sql()} AS r2, {rmse_sql()} AS rmse, avg(abs(price-y_true)) AS mae,
  avg(CASE WHEN price>y_true THEN 1.0 ELSE 0.0 END) AS o, stddev_pop(y_true) AS sd FROM hy GROUP BY 1),
tl AS (SELECT unnest([0,1,2,3,4]) AS position, unnest(['Low','Mid','High','High+','Very High']) AS segment),
tf AS (SELECT CAST(position AS INT) AS position, tl.segment, coalesce(n,0) AS n, CASE WHEN n>=5 THEN r2 END AS r2, CASE WHEN n>=5 THEN rmse END AS rmse,
  CASE WHEN n>=5 THEN mae END AS mae, CASE WHEN n>=5 THEN o END AS overpricing_rate, CASE WHEN n>=5 THEN sd END AS std_true FROM tl LEFT JOIN tt ON tl.segment=tt.segment)"""


@query("i12_tier_table", with_ctes(f""", {_TIERS}
SELECT position, segment, n, round(r2,6) AS r2, round(rmse,4) AS rmse, round(mae,4) AS mae, round(overpricing_rate,6) AS overpricing_rate, round(std_true,4) AS std_true FROM tf""", hy=HYBRID))
def tier_table(spark, d):
    return rounded(metrics.tier_table(hybrid(spark, d), GATE_TIERS), {**DIGITS, "overpricing_rate": 6, "std_true": 4})


@query("i13_weighted_r2_gate", with_ctes(f""", {_TIERS}, {_wr2()},
v AS (SELECT string_agg(segment, '|' ORDER BY position) FILTER (r2 < -1 AND n>=30 AND std_true>=2000) AS veto,
 string_agg(segment, '|' ORDER BY position) FILTER (r2 < -1 AND NOT (n>=30 AND std_true>=2000)) AS adv,
 string_agg(segment, '|' ORDER BY position) FILTER (r2 < 0) AS crit, string_agg(segment, '|' ORDER BY position) FILTER (r2>=0 AND r2<0.5) AS warn FROM tf)
SELECT round(weighted_r2,6) AS weighted_r2, coalesce(veto,'') AS veto_segments, coalesce(adv,'') AS advisory_segments, coalesce(crit,'') AS critical_segments,
 coalesce(warn,'') AS warning_segments, weighted_r2 >= 0.75 AND veto IS NULL AS passed FROM v, wr WHERE model='hybrid'""", hy=HYBRID))
def weighted_r2_gate(spark, d):
    return rounded(gates.weighted_r2_gate(hybrid(spark, d)), 6)


@query("i14_overpricing_gate", with_ctes(f"""
SELECT round(avg(CASE WHEN price>y_true THEN 1.0 ELSE 0.0 END),6) AS overpricing_rate, round({rmse_sql()},4) AS rmse, CAST(NULL AS DOUBLE) AS pinball,
 avg(CASE WHEN price>y_true THEN 1.0 ELSE 0.0 END) <= 0.62 AS passed FROM hy""", hy=HYBRID))
def overpricing_gate(spark, d):
    return rounded(gates.overpricing_gate(hybrid(spark, d)), {"overpricing_rate": 6, "rmse": 4})


@query("i14_quantile_gate", with_ctes(f"""
SELECT round(avg(CASE WHEN price>y_true THEN 1.0 ELSE 0.0 END),6) AS overpricing_rate, round({rmse_sql()},4) AS rmse,
 round(avg(CASE WHEN y_true-price>=0 THEN (y_true-price)*0.30 ELSE (y_true-price)*(0.30-1.0) END),6) AS pinball,
 abs(avg(CASE WHEN price>y_true THEN 1.0 ELSE 0.0 END) - 0.30) <= 0.10 AS passed FROM hy""", hy=HYBRID))
def quantile_gate(spark, d):
    return rounded(gates.overpricing_gate(hybrid(spark, d), alpha=0.30), {"overpricing_rate": 6, "rmse": 4, "pinball": 6})


@query("i16_within_bands", with_ctes("""
, s AS (SELECT abs(price-y_true) AS g, abs((price-y_true)/y_true) AS r, price, y_true FROM hy)
SELECT round(avg(CASE WHEN r<=0.05 THEN 1.0 ELSE 0.0 END),6) AS within_5pct, round(avg(CASE WHEN r<=0.10 THEN 1.0 ELSE 0.0 END),6) AS within_10pct,
 round(avg(CASE WHEN r<=0.15 THEN 1.0 ELSE 0.0 END),6) AS within_15pct, round(avg(CASE WHEN r<=0.20 THEN 1.0 ELSE 0.0 END),6) AS within_20pct,
 round(avg(g),4) AS mean_abs_error, round(max(g),4) AS max_abs_error, round(avg(CASE WHEN price>y_true THEN 1.0 ELSE 0.0 END),6) AS overpriced_share,
 round(avg(CASE WHEN price<y_true THEN 1.0 ELSE 0.0 END),6) AS underpriced_share, round(quantile_cont(g,0.5),4) AS median_abs_error FROM s""", hy=HYBRID))
def within_bands(spark, d):
    out = metrics.within_bands(hybrid(spark, d))
    return rounded(out, {c: 4 if "error" in c else 6 for c in out.columns})


@query("i17_error_by_range", with_ctes(f"""
, s AS (SELECT *, CASE WHEN price<=0 THEN NULL WHEN price<=5000 THEN 'Low' WHEN price<=10000 THEN 'Mid' WHEN price<=16701 THEN 'High' ELSE 'Very High' END AS range FROM hy)
SELECT range, count(*) AS n, round({rmse_sql()},4) AS rmse, round(avg(abs(y_true-price)),4) AS mae, round(avg(abs((y_true-price)/y_true)),6) AS mape
FROM s WHERE range IS NOT NULL GROUP BY range""", hy=HYBRID))
def error_by_range(spark, d):
    return rounded(metrics.error_by_range(hybrid(spark, d)), DIGITS)


@query("i18_prediction_distribution", with_ctes("""
, s AS (SELECT CASE WHEN price<=0 THEN NULL WHEN price<=5000 THEN '0-5000' WHEN price<=10000 THEN '5000-10000' WHEN price<=20000 THEN '10000-20000' ELSE '20000+' END AS bin, y_true-price AS e FROM hy),
t AS (SELECT count(*) AS n, avg(e) AS a, quantile_cont(e,0.5) AS b, quantile_cont(abs(e),0.95) AS c FROM s)
SELECT bin, count(*) AS n, round(count(*)*100.0/max(t.n),6) AS pct, round(max(a),4) AS mean_residual, round(max(b),4) AS median_residual, round(max(c),4) AS p95_abs_error
FROM s, t WHERE bin IS NOT NULL GROUP BY bin""", hy=HYBRID))
def prediction_distribution(spark, d):
    return rounded(metrics.prediction_distribution(hybrid(spark, d)),
                   {"pct": 6, "mean_residual": 4, "median_residual": 4, "p95_abs_error": 4})


@query("i19_calibration_table", with_ctes("""
, t AS (SELECT min(price) AS lo, (max(price)-min(price))/10 AS w FROM hy), s AS (SELECT CAST(least(floor((price-lo)/w),9) AS INT)+1 AS bin, y_true, price FROM hy, t)
SELECT bin, count(*) AS n, round(avg(price),4) AS pred_mean, round(avg(y_true),4) AS actual_mean, round(avg(price)-avg(y_true),4) AS deviation
FROM s GROUP BY bin HAVING count(*) > 5""", hy=HYBRID))
def calibration_table(spark, d):
    return rounded(metrics.calibration_table(hybrid(spark, d)), 4)


_Q15 = """, q AS (SELECT quantile_cont(price, [1/15.0,2/15.0,3/15.0,4/15.0,5/15.0,6/15.0,7/15.0,8/15.0,9/15.0,10/15.0,11/15.0,12/15.0,13/15.0,14/15.0]) AS e FROM hy),
s AS (SELECT len(list_filter(e, lambda x: price >= x)) AS bin, y_true, price FROM hy, q), b AS (SELECT bin, count(*) AS n, avg(price) AS p, avg(y_true) AS a FROM s GROUP BY bin)"""


@query("i20_quantile_calibration", with_ctes(
    f"{_Q15} SELECT CAST(bin AS INT) AS bin, n, round(p,4) AS pred_mean, round(a,4) AS actual_mean FROM b", hy=HYBRID))
def quantile_calibration(spark, d):
    return rounded(metrics.quantile_calibration(hybrid(spark, d)), 4)


@query("i20_calibration_error", with_ctes(
    f"{_Q15} SELECT round(avg(abs(p-a)),4) AS calibration_error, count(*) AS n_bins, CAST(sum(n) AS BIGINT) AS n FROM b", hy=HYBRID))
def calibration_error(spark, d):
    return rounded(metrics.calibration_error(hybrid(spark, d)), 4)


@query("i21_error_distribution", with_ctes("""
, s AS (SELECT abs(y_true-price) AS g, abs(y_true-price)/greatest(y_true,1e-10)*100.0 AS r FROM hy)
SELECT round(avg(g),4) AS mae, round(stddev_pop(g),4) AS std_ae, round(max(g),4) AS max_error, round(avg(r),6) AS mean_pct_error,
 round(avg(CASE WHEN r<=10 THEN 100.0 ELSE 0.0 END),6) AS pct_within_10pct, round(avg(CASE WHEN r<=20 THEN 100.0 ELSE 0.0 END),6) AS pct_within_20pct,
 round(avg(CASE WHEN r<=50 THEN 100.0 ELSE 0.0 END),6) AS pct_within_50pct, round(quantile_cont(g,0.5),4) AS median_ae, round(quantile_cont(g,0.9),4) AS p90,
 round(quantile_cont(g,0.95),4) AS p95, round(quantile_cont(r,0.5),6) AS median_pct_error FROM s""", hy=HYBRID))
def error_distribution(spark, d):
    out = metrics.error_distribution(hybrid(spark, d))
    return rounded(out, {c: 6 if "pct" in c else 4 for c in out.columns})


@query("i22_i23_residuals", with_ctes(_MOM + """,
x AS (SELECT count(*) AS n, min(e) AS mn, max(e) AS mx, count(*) FILTER (abs(e-mean)>3*sd) AS o3, count(*) FILTER (abs(e-mean)>4*sd) AS o4,
  quantile_cont(e,0.01) AS p01, quantile_cont(e,0.05) AS p05, quantile_cont(e,0.25) AS p25, quantile_cont(e,0.5) AS p50, quantile_cont(e,0.75) AS p75,
  quantile_cont(e,0.95) AS p95, quantile_cont(e,0.99) AS p99 FROM r, k),
y AS (SELECT x.*, mean, sd, sk, ku, x.n/6.0*(sk*sk+ku*ku/4.0) AS jb, o3*100.0/x.n AS op FROM x, k)
SELECT n, round(mean,4) AS mean, round(sd,4) AS std, round(mn,4) AS min, round(mx,4) AS max, round(sk,6) AS skewness, round(ku,6) AS kurtosis,
 o3 AS n_outliers_3sigma, o4 AS n_outliers_4sigma, round(jb,4) AS jarque_bera, round(exp(-jb/2.0),6) AS normality_p,
 round(p01,4) AS p01, round(p05,4) AS p05, round(p25,4) AS p25, round(p50,4) AS p50, round(p75,4) AS p75, round(p95,4) AS p95, round(p99,4) AS p99,
 round(op,6) AS outlier_pct, concat_ws('|', CASE WHEN op>5 THEN 'high_outlier_rate' END, CASE WHEN abs(mean)>0.1*sd THEN 'systematic_bias' END,
  CASE WHEN abs(sk)>1 THEN 'heavy_skew' END, CASE WHEN ku>3 THEN 'heavy_tails' END, CASE WHEN exp(-jb/2.0)<=0.05 THEN 'non_normal' END) AS recommendations FROM y""", hy=HYBRID))
def residual_diagnostics(spark, d):
    out = metrics.residual_diagnostics(hybrid(spark, d))
    return rounded(out, {c: 6 if c in ("skewness", "kurtosis", "normality_p", "outlier_pct") else 4 for c in out.columns})


_SCORE = normal_quantile_sql("(rk-0.375)/(n+0.25)")


@query("i23_shapiro_francia", with_ctes(f"""
, r AS (SELECT y_true-price AS e, row_number() OVER (ORDER BY y_true-price) AS r, count(*) OVER () AS n FROM hy),
t AS (SELECT e, n, avg(r) OVER (PARTITION BY e) AS rk FROM r)
SELECT count(*) AS n, round(power(corr(e, {_SCORE}),2),6) AS w FROM t""", hy=HYBRID))
def shapiro_francia(spark, d):
    return rounded(ranks.shapiro_francia(hybrid(spark, d), F.col("y_true") - F.col("price")), 6)


@query("i24_durbin_watson", with_ctes("""
, s AS (SELECT y_true-price AS e, y_true-price - lag(y_true-price) OVER (ORDER BY policy_id) AS dd FROM hy)
SELECT count(*) AS n, round(sum(dd*dd)/sum(e*e),6) AS durbin_watson, abs(sum(dd*dd)/sum(e*e)-2.0)>0.5 AS autocorrelated FROM s""", hy=HYBRID))
def durbin_watson(spark, d):
    return rounded(metrics.durbin_watson(hybrid(spark, d), "policy_id", F.col("y_true") - F.col("price")), 6)


@query("i25_paired_t", with_ctes("""
, s AS (SELECT a.net_profit-b.net_profit AS dp, abs(a.error)-abs(b.error) AS de FROM economics a JOIN economics b ON a.policy_id=b.policy_id AND a.model='ml' AND b.model='hybrid'),
t AS (SELECT count(*) AS n, avg(dp)/(stddev_samp(dp)/sqrt(count(*))) AS tp, avg(de)/(stddev_samp(de)/sqrt(count(*))) AS te FROM s)
SELECT n, round(tp,6) AS t_profit, round(te,6) AS t_error, abs(tp)>1.959963984540054 AS significant_profit, abs(te)>1.959963984540054 AS significant_error FROM t"""))
def paired_t(spark, d):
    return rounded(metrics.paired_t(portfolio.scored(spark, d)), 6)


@query("i26_profit_distribution", with_ctes("""
SELECT count(*) FILTER (churn_probability>0.5) AS high_churn_policies, count(*) FILTER (share < -0.5) AS severe_underpricing, round(sum(churn_cost),2) AS churn_losses,
 round(sum(underpricing_penalty),2) AS underpricing_penalties, round(sum(accuracy_bonus),2) AS accuracy_bonuses, round(quantile_cont(net_profit,0.25),4) AS profit_q25,
 round(quantile_cont(net_profit,0.5),4) AS profit_q50, round(quantile_cont(net_profit,0.75),4) AS profit_q75 FROM economics WHERE model='hybrid'"""))
def profit_distribution(spark, d):
    out = metrics.profit_distribution(hybrid(spark, d))
    return rounded(out, {c: 4 if c.startswith("profit") else 2 for c in out.columns})


_PAIR = f""", g AS (SELECT model, sum(net_profit) AS np, {CHURN}*100.0 AS ch, {SCORE} AS sc, sum(underpricing_penalty) AS up, {PPP} AS ppp,
  count(*) FILTER (share < -0.5) AS sv, {rmse_sql()} AS rmse, avg(abs(ln(y_true)-ln(price))) AS male FROM economics GROUP BY model),
w AS (SELECT h.np>m.np AS win_profit, h.ch<m.ch AS win_churn, h.sc>m.sc AS win_score, h.sv<=m.sv AS win_tail, h.up<m.up AS win_penalty,
  (h.ppp-m.ppp)/abs(m.ppp)*100.0 AS pi, CASE WHEN m.up>0 THEN 1.0-h.up/m.up ELSE 0.0 END AS rr, h.rmse<m.rmse AND h.male<m.male AS acc
  FROM g h, g m WHERE h.model='hybrid' AND m.model='ml'),
z AS (SELECT *, CAST(win_profit AS INT)+CAST(win_churn AS INT)+CAST(win_score AS INT)+CAST(win_tail AS INT)+CAST(win_penalty AS INT) AS wins FROM w)"""


@query("i27_decision", with_ctes(_PAIR + """
SELECT win_profit, win_churn, win_score, win_tail, win_penalty, wins, wins/5.0 AS confidence, round(pi,6) AS profit_improvement_pct, round(rr,6) AS risk_reduction,
 CASE WHEN wins>=4 THEN 'HIGH' WHEN wins>=3 THEN 'MODERATE' ELSE 'LOW' END AS level,
 CASE WHEN NOT win_score THEN 'KEEP_ML_ONLY' WHEN wins>=4 AND acc THEN 'STRONGLY_DEPLOY' WHEN wins>=4 THEN 'DEPLOY' WHEN wins>=3 THEN 'CONDITIONAL_DEPLOY' ELSE 'DO_NOT_DEPLOY' END AS verdict FROM z"""))
def decision(spark, d):
    return rounded(metrics.decision(portfolio.scored(spark, d)), {"profit_improvement_pct": 6, "risk_reduction": 6, "confidence": 6})


def _configs_sql():
    rows = ["SELECT 0 AS position, 'ML_Baseline' AS name, 0e0 AS th, 1e0 AS ra, false AS soft, 1e0 AS wi, 1e0 AS fa, true AS mo"]
    for c in metrics.sweep_configs():
        rows.append(f"SELECT {c['position']}, '{c['name']}', {c['threshold']}, {c['ratio']}, {str(c['soft']).lower()}, "
                    f"{c['window']}, {c['factor']}, {str(c['ml_only']).lower()}")
    return " UNION ALL ".join(rows)


SWEEP = f""", cfg AS ({_configs_sql()}),
x AS (SELECT cfg.*, y_true, ml_pred AS ml0, CASE WHEN mo THEN ml_pred*fa ELSE ml_pred END AS ml, act_pred AS act FROM scored, cfg),
y AS (SELECT *, CASE WHEN ml*0.5+act*0.5 >= th THEN 1.0 WHEN NOT soft THEN ra WHEN act <= th-wi THEN ra ELSE ra+(1.0-ra)*((act-(th-wi))/wi) END AS wt FROM x),
p AS (SELECT *, CASE WHEN position=0 THEN ml0 ELSE greatest(least(wt*ml+(1.0-wt)*act, ml*1.10), ml*0.75) END AS mixed FROM y),
e0 AS (SELECT position, name, y_true, CASE WHEN mo THEN mixed ELSE mixed*fa END AS price FROM p),
e1 AS (SELECT *, price-y_true AS error, (price-y_true)/y_true AS share, price*1.15 AS revenue, price-y_true+0.15*price-25.0 AS gross_profit FROM e0),
e2 AS (SELECT *, CASE WHEN error>0 THEN least(greatest(share-0.40,0.0),0.80) ELSE 0.0 END AS churn_probability,
  CASE WHEN error<0 THEN least(abs(error)*0.3, revenue*0.2)+CASE WHEN abs(share)>0.5 THEN 200.0 ELSE 0.0 END ELSE 0.0 END AS underpricing_penalty,
  CASE WHEN abs(share)<=0.15 THEN 150.0 WHEN abs(share)<=0.30 THEN 75.0 ELSE 0.0 END AS bonus, abs(share)<=0.30 AS accurate FROM e1),
e3 AS (SELECT *, gross_profit-churn_probability*(y_true*1.5+200.0)-underpricing_penalty+bonus AS net_profit FROM e2),
sw AS (SELECT position, name, avg(abs(error)/y_true)*100.0 AS mape, avg(abs(error)/((y_true+price)/2.0))*100.0 AS smape, {rmse_sql()} AS rmse,
  avg(abs(error)) AS mae, {r2_sql()} AS r2, sum(net_profit) AS total_net_profit, {PPP} AS profit_per_policy, {CHURN}*100.0 AS churn_rate_pct,
  {SCORE} AS business_score, sum(churn_probability) AS expected_churned, sum(underpricing_penalty) AS total_underpricing_penalty
  FROM e3 GROUP BY position, name)"""
SWEEP_OUT = """position, name, round(mape,6) AS mape, round(smape,6) AS smape, round(rmse,4) AS rmse, round(mae,4) AS mae, round(r2,6) AS r2,
 round(total_net_profit,2) AS total_net_profit, round(profit_per_policy,4) AS profit_per_policy, round(churn_rate_pct,6) AS churn_rate_pct,
 round(business_score,6) AS business_score, round(expected_churned,4) AS expected_churned, round(total_underpricing_penalty,2) AS total_underpricing_penalty"""


@query("i28_config_sweep", with_ctes(SWEEP + f"""
SELECT {SWEEP_OUT}, row_number() OVER (ORDER BY round(business_score,6) DESC, position)=1 AS best_business,
 row_number() OVER (ORDER BY round(rmse,6), position)=1 AS best_rmse FROM sw"""))
def config_sweep(spark, d):
    return rounded(metrics.marked_best(metrics.config_sweep(portfolio.scored(spark, d))), DIGITS)


@query("f7_ranked_sweep", with_ctes(SWEEP + """,
b AS (SELECT rmse AS base FROM sw WHERE position=0), gp AS (SELECT position, name, rmse, r2, abs(rmse-base)/base AS gap FROM sw, b),
o AS (SELECT position, avg(CASE WHEN price>y_true THEN 1.0 ELSE 0.0 END) AS ov FROM e0 GROUP BY position)
SELECT row_number() OVER (ORDER BY round(gap,8), gp.position) AS rank, name, round(gap,6) AS gap, round(r2,6) AS r2, round(ov,6) AS overpricing_rate,
 gap<=0.20 AS gap_ok, r2>=0.70 AS r2_ok, ov<=0.62 AS overpricing_ok, gap<=0.20 AND r2>=0.70 AND ov<=0.62 AS passed
FROM gp JOIN o ON gp.position=o.position WHERE gp.position>0"""))
def ranked_sweep(spark, d):
    from ratebook.operators import selection
    return rounded(selection.ranked_sweep(portfolio.scored(spark, d)), 6)


@query("i29_high_value", with_ctes(f"""
, q AS (SELECT quantile_cont(y_true,0.75) AS c, count(*) AS t FROM scored)
SELECT count(*) AS n, round({rmse_sql('y_true','hybrid_pred')},4) AS rmse, round(avg(abs(hybrid_pred-y_true)),4) AS mae, round({r2_sql('y_true','hybrid_pred')},6) AS r2,
 round(avg(abs(y_true-hybrid_pred)/greatest(y_true,1e-10))*100.0,6) AS mape, round({rmse_sql('y_true','ml_pred')},4) AS baseline_rmse, round(max(c),4) AS threshold,
 round(count(*)*100.0/max(t),6) AS pct_samples, round(({rmse_sql('y_true','ml_pred')}-{rmse_sql('y_true','hybrid_pred')})/{rmse_sql('y_true','ml_pred')}*100.0,6) AS improvement_pct
FROM scored, q WHERE y_true >= c"""))
def high_value(spark, d):
    return rounded(metrics.high_value_segment(portfolio.scored(spark, d)), {
        **DIGITS, "baseline_rmse": 4, "threshold": 4, "pct_samples": 6, "improvement_pct": 6})


@query("i30_model_comparison", with_ctes(f"""
, t AS (SELECT {rmse_sql('y_true','ml_pred')} AS rmse_a, {rmse_sql('y_true','hybrid_pred')} AS rmse_b, {r2_sql('y_true','ml_pred')} AS r2_a, {r2_sql('y_true','hybrid_pred')} AS r2_b,
 avg(abs(ml_pred-y_true)) AS mae_a, avg(abs(hybrid_pred-y_true)) AS mae_b FROM scored)
SELECT round(rmse_a,4) AS rmse_a, round(rmse_b,4) AS rmse_b, round(r2_a,6) AS r2_a, round(r2_b,6) AS r2_b, round(mae_a,4) AS mae_a, round(mae_b,4) AS mae_b,
 round((rmse_a-rmse_b)/rmse_a*100.0,6) AS rmse_improvement_pct, round((r2_b-r2_a)/abs(r2_a)*100.0,6) AS r2_improvement_pct,
 round((mae_a-mae_b)/mae_a*100.0,6) AS mae_improvement_pct, rmse_a>rmse_b AND r2_b>=r2_a AS is_better FROM t"""))
def model_comparison(spark, d):
    out = metrics.model_comparison(portfolio.scored(spark, d))
    return rounded(out, {c: 4 if c[:4] in ("rmse", "mae_") and "improv" not in c else 6 for c in out.columns})


@query("i32_search_scores", with_ctes("""
, q AS (SELECT quantile_cont(y_true,0.25) AS a, quantile_cont(y_true,0.5) AS b, quantile_cont(y_true,0.75) AS c, quantile_cont(y_true,0.9) AS dd FROM scored),
s AS (SELECT CASE WHEN y_true-price>=0 THEN (y_true-price)*0.65 ELSE (y_true-price)*(0.65-1.0) END AS l, (price-y_true)*(price-y_true) AS sq,
  CASE WHEN y_true>dd THEN 1.5*1.8 WHEN y_true>c THEN 1.5 ELSE 1.0 END AS w, CASE WHEN y_true<=a THEN 0 WHEN y_true<=b THEN 1 WHEN y_true<=c THEN 2 ELSE 3 END AS g FROM hy, q),
gg AS (SELECT avg(bl) AS bp, avg(br) AS br FROM (SELECT avg(l) AS bl, sqrt(avg(sq)) AS br FROM s GROUP BY g)),
t AS (SELECT avg(l) AS pin, sum(l*w)/sum(w) AS wpin, sqrt(avg(sq)) AS rmse, sqrt(sum(sq*w)/sum(w)) AS wrmse FROM s)
SELECT round(pin,4) AS pinball, round(wpin,4) AS weighted_pinball, round(bp,4) AS balanced_pinball, round(rmse,4) AS rmse, round(wrmse,4) AS weighted_rmse,
 round(br,4) AS balanced_rmse, round(0.70*pin+0.15*wpin+0.15*rmse,4) AS hybrid_score FROM t, gg""", hy=HYBRID))
def search_scores(spark, d):
    return rounded(metrics.search_scores(hybrid(spark, d)), 4)


_BATCH = "SELECT region, count(*) AS n, avg(hybrid_pred) AS mean_premium, avg(abs(hybrid_pred-charges)) AS mae FROM priced GROUP BY region"


@query("i33_merged_batches", with_ctes("""
SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS n_batches, round(sum(mean_premium*n)/sum(n),6) AS mean_premium, round(sum(mae*n)/sum(n),6) AS mae FROM batches""",
    batches=_BATCH))
def merged_batches(spark, d):
    """Summaries of regional batches merged into the summary of all rows."""
    rows = portfolio.priced(spark, d)
    batches = rows.groupBy("region").agg(
        F.count(F.lit(1)).alias("n"), F.avg("hybrid_pred").alias("mean_premium"), m.mae("charges", "hybrid_pred").alias("mae"))
    return rounded(metrics.merged_batches(batches, "n", ["mean_premium", "mae"]), 6)


@query("i34_range_screen", with_ctes("""
, t AS (SELECT max(y_true) AS top FROM scored)
SELECT round(max(top),4) AS reference_max, count(*) FILTER (hybrid_pred > top*1.5) AS n_out_of_range, round(max(hybrid_pred),4) AS max_hybrid, round(avg(ml_pred),4) AS mean_ml,
 round(avg(hybrid_pred),4) AS mean_hybrid, round(avg(act_pred),4) AS mean_actuarial, round(avg(hybrid_pred)/avg(ml_pred),6) AS ratio, avg(hybrid_pred)/avg(ml_pred)>1.4 AS divergent FROM scored, t"""))
def range_screen(spark, d):
    out = metrics.range_screen(portfolio.scored(spark, d), (None, 0.0, 3e6))
    return rounded(out, {c: 6 if c == "ratio" else 4 for c in out.columns})


@query("i35_report_kpis", with_ctes(f"""
, k AS (SELECT model, sum(net_profit) AS np, {PPP} AS ppp, count(*) FILTER (error<0)*100.0/count(*) AS up, sum(underpricing_penalty) AS pen, {CHURN}*100.0 AS ch,
  {rmse_sql()} AS rmse, avg(abs(ln(y_true)-ln(price))) AS male, avg(abs(error)/((y_true+price)/2.0))*100.0 AS smape, {r2_sql()} AS r2 FROM economics GROUP BY model),
wt AS (SELECT avg(CASE WHEN ml_pred*0.5+act_pred*0.5>=7500 THEN 1.0 WHEN act_pred<=6500 THEN 0.70 ELSE 0.70+0.30*((act_pred-6500.0)/1000.0) END) AS w FROM scored)
SELECT round(h.np-m.np,2) AS profit_delta, round((h.ppp-m.ppp)/abs(m.ppp)*100.0,6) AS profit_delta_pct, round(m.up,6) AS underpriced_pct_ml, round(h.up,6) AS underpriced_pct_hybrid,
 round(m.pen-h.pen,2) AS penalty_saved, round(h.ch-m.ch,6) AS churn_delta, round(h.rmse-m.rmse,4) AS rmse_delta, round(h.male-m.male,6) AS male_delta, round(h.smape-m.smape,6) AS smape_delta,
 round(w,6) AS effective_weight, abs(w-0.70)>0.15 AS weight_gap_alarm, m.r2<0 AS negative_r2_alarm FROM k h, k m, wt WHERE h.model='hybrid' AND m.model='ml'"""))
def report_kpis(spark, d):
    from ratebook.operators import reports
    out = reports.kpis(portfolio.scored(spark, d))
    return rounded(out, {c: 2 if c in ("profit_delta", "penalty_saved") else 4 if c == "rmse_delta" else 6 for c in out.columns})


@query("i35_segment_alarms", with_ctes(f"""
, s AS (SELECT {SEGMENT} AS segment, y_true, act_pred AS price FROM scored), g AS (SELECT segment, count(*) AS n, avg(abs(price-y_true)/((y_true+price)/2.0))*100.0 AS smape,
 avg(price)/avg(y_true) AS ratio FROM s GROUP BY segment)
SELECT row_number() OVER (ORDER BY smape DESC) AS rank, segment, n, round(smape,6) AS smape, round(ratio,6) AS mean_ratio FROM g WHERE smape > 20"""))
def segment_alarms(spark, d):
    """Segments whose actuarial SMAPE exceeds a limit, worst first (the usual limit is 80)."""
    from ratebook.operators import reports
    rows = portfolio.scored(spark, d).withColumn("price", F.col("act_pred"))
    return rounded(reports.segment_alarms(rows, limit=20.0), 6)


@query("e7_sample_report", with_ctes("""
, s AS (SELECT policy_id, y_true AS actual, hybrid_pred AS predicted FROM scored ORDER BY substr(md5('42:'||policy_id),1,15), policy_id LIMIT 20)
SELECT policy_id, round(actual,4) AS actual, round(predicted,4) AS predicted, round(actual-predicted,4) AS error, round((actual-predicted)/actual,6) AS error_pct FROM s"""))
def sample_report(spark, d):
    return rounded(metrics.sample_report(portfolio.scored(spark, d), 20, p="hybrid_pred"),
                   {"actual": 4, "predicted": 4, "error": 4, "error_pct": 6})
