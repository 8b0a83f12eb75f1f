"""Pricing, blending, routing and bias queries."""

from pyspark.sql import functions as F

from ratebook.config import KEY, Blend
from ratebook.functions import features, pricing as fx
from ratebook.functions.columns import rounded
from ratebook.operators import gates, isotonic, metrics, models, pricing as op, selection, splits
from ratebook.plans.features import AGE_GROUP, BMI_CATEGORY, SCORE_SQL
from ratebook.plans.metrics import hybrid, r2_sql, rmse_sql
from ratebook.plans.registry import query
from ratebook.plans.splits import holdout_sql
from ratebook.plans.sql import ACT, blend_sql, with_ctes
from ratebook.sources import portfolio

SPECIALISTS = {"low": 0.98, "mid": 1.01, "high_mid": 1.02, "very_high": 0.97}
SPECIAL = "SELECT *, " + ", ".join(f"ml_pred*{v} AS {k}" for k, v in SPECIALISTS.items()) + " FROM priced"


def specialists(spark, d):
    return portfolio.priced(spark, d).withColumns({k: F.col("ml_pred") * F.lit(v) for k, v in SPECIALISTS.items()})


@query("g1_actuarial_premium", with_ctes("SELECT policy_id, round(act_pred, 6) AS act_pred FROM rated"))
def actuarial(spark, d):
    return portfolio.policies(spark, d).select(KEY, F.round(fx.actuarial_premium(), 6).alias("act_pred"))


WEIGHT = """CASE WHEN ml_pred*0.5+act_pred*0.5 >= 7500 THEN 1.0 WHEN act_pred <= 6500 THEN 0.70
  ELSE 0.70+(1.0-0.70)*((act_pred-(7500.0-1000.0))/1000.0) END"""
ZONE = """CASE WHEN ml_pred*0.5+act_pred*0.5 >= 7500 THEN 'ml_only' WHEN act_pred <= 6500 THEN 'actuarial_dominant' ELSE 'transition' END"""


@query("g2_hybrid_blend", with_ctes(
    f"SELECT policy_id, {ZONE} AS zone, round({WEIGHT}, 8) AS weight, round(hybrid_pred, 6) AS blended FROM priced"))
def hybrid_blend(spark, d):
    out = op.blended(portfolio.priced(spark, d)).select(KEY, "zone", "weight", "blended")
    return rounded(out, {"weight": 8, "blended": 6})


@query("g3_hard_blend", with_ctes("""
SELECT policy_id, CASE WHEN ml_pred*0.5+act_pred*0.5 >= 7500 THEN 'ml_only' ELSE 'below' END AS zone,
 round(greatest(least(CASE WHEN ml_pred*0.5+act_pred*0.5 >= 7500 THEN ml_pred ELSE 0.70*ml_pred+(1.0-0.70)*act_pred END, ml_pred*1.10), ml_pred*0.75), 6) AS blended FROM priced"""))
def hard_blend(spark, d):
    out = op.blended(portfolio.priced(spark, d), Blend(window=None)).select(KEY, "zone", "blended")
    return rounded(out, {"blended": 6})


@query("g4_calibration_factor", with_ctes(
    f"SELECT policy_id, round({blend_sql('(ml_pred*1.08)')}, 6) AS ml_only, round(({blend_sql()})*1.08, 6) AS whole FROM priced"))
def calibration_factor(spark, d):
    out = portfolio.priced(spark, d).select(
        KEY, fx.hybrid(rule=Blend(factor=1.08)).alias("ml_only"),
        fx.hybrid(rule=Blend(factor=1.08, factor_on_ml_only=False)).alias("whole"))
    return rounded(out, 6)


@query("g5_blend_diagnostics", with_ctes(f"""
, z AS (SELECT {ZONE} AS zone, {WEIGHT} AS w FROM priced)
SELECT count(*) AS n, count(*) FILTER (zone='ml_only') AS ml_only, count(*) FILTER (zone='actuarial_dominant') AS actuarial_dominant,
 count(*) FILTER (zone='transition') AS transition, round(avg(w), 8) AS avg_weight FROM z"""))
def blend_diagnostics(spark, d):
    return rounded(op.blend_diagnostics(portfolio.priced(spark, d)), 8)


@query("g6_ratio_alert", with_ctes("""
, t AS (SELECT count(*) AS n, quantile_cont(act_pred/greatest(ml_pred,1e-8),0.5) AS r FROM priced)
SELECT n, round(r,6) AS median_ratio, CASE WHEN r>1.15 THEN 'conservative' WHEN r<0.70 THEN 'aggressive' ELSE 'normal' END AS verdict FROM t"""))
def ratio_alert(spark, d):
    return rounded(op.ratio_alert(portfolio.priced(spark, d)), 6)


@query("g7_correction_guard", with_ctes("""
, t AS (SELECT count(*) AS n, quantile_cont(hybrid_pred/greatest(ml_pred,1e-8),0.5) AS r FROM priced)
SELECT n, round(r,6) AS net_factor, r BETWEEN 0.65 AND 1.45 AS within_range FROM t"""))
def correction_guard(spark, d):
    return rounded(op.correction_guard(portfolio.priced(spark, d)), 6)


def _tail(final):
    return f"""
, t AS (SELECT count(*) AS n, count(*) FILTER ({final} < ml_pred*0.5) AS k, avg((ml_pred*0.5-{final})/greatest(ml_pred*0.5,1e-8)) FILTER ({final} < ml_pred*0.5) AS g FROM priced)
SELECT n, k AS below_floor, round(k*100.0/n,6) AS below_floor_pct, round(g,6) AS mean_gap,
 CASE WHEN k=0 THEN 'NONE' WHEN k*100.0/n>10 THEN 'CRITICAL' WHEN k*100.0/n>5 THEN 'HIGH' ELSE 'MODERATE' END AS severity FROM t"""


@query("g8_tail_risk", with_ctes(_tail("hybrid_pred")))
def tail_risk(spark, d):
    return rounded(op.tail_risk(portfolio.priced(spark, d)), 6)


@query("g8_tail_risk_calibrated", with_ctes(_tail("(hybrid_pred*0.60)")))
def tail_risk_calibrated(spark, d):
    """The alert behind a calibration factor of 0.60, where the blend's own floor no longer hides it."""
    rows = portfolio.priced(spark, d).withColumn("final", F.col("hybrid_pred") * 0.60)
    return rounded(op.tail_risk(rows, final="final"), 6)


_RW = "least(greatest((ml_pred-16701.0*1.08)/(16701.0*1.299-16701.0*1.08),0.0),1.0)"


@query("g9_router", with_ctes(f"""
, w AS (SELECT *, {_RW} AS w FROM special)
SELECT policy_id, CASE WHEN w<=0 THEN 'base' WHEN w>=1 THEN 'specialist' ELSE 'mixed' END AS route,
 round(CASE WHEN w<=0 THEN ml_pred WHEN w>=1 THEN very_high ELSE (1.0-w)*ml_pred+w*very_high END, 6) AS routed FROM w""", special=SPECIAL))
def router(spark, d):
    return rounded(op.routed(specialists(spark, d)).select(KEY, "route", "routed"), {"routed": 6})


@query("g9_router_counts", with_ctes(f"""
, w AS (SELECT {_RW} AS w FROM special)
SELECT count(*) AS n, count(*) FILTER (w<=0) AS n_base, count(*) FILTER (w>0 AND w<1) AS n_mixed, count(*) FILTER (w>=1) AS n_specialist,
 round(count(*) FILTER (w>=1)*100.0/count(*),6) AS pct_specialist, round(count(*) FILTER (w>0 AND w<1)*100.0/count(*),6) AS pct_mixed FROM w""", special=SPECIAL))
def router_counts(spark, d):
    return rounded(op.route_counts(op.routed(specialists(spark, d))), 6)


@query("g10_specialist_blend", with_ctes("""
, w AS (SELECT *, least(greatest((ml_pred-16701.0)/5000.0,0.0),1.0) AS w FROM special)
SELECT policy_id, round((1.0-w)*ml_pred+w*very_high, 6) AS blended FROM w""", special=SPECIAL))
def specialist_blend(spark, d):
    return rounded(specialists(spark, d).select(KEY, op.specialist_blend("ml_pred", "very_high").alias("blended")), 6)


@query("g11_bias_two_tier", with_ctes("""
SELECT policy_id, round(ml_pred*CASE WHEN ml_pred<10000 THEN exp(0.04/2) ELSE exp(0.02/2) END, 6) AS serving,
 round(ml_pred*CASE WHEN ml_pred<=10000 THEN exp(0.04/2) ELSE exp(0.02/2) END, 6) AS training FROM priced"""))
def bias_two_tier(spark, d):
    v = {"low": 0.04, "high": 0.02}
    return rounded(portfolio.priced(spark, d).select(
        KEY, (F.col("ml_pred") * fx.bias_factor("ml_pred", v, 10000.0)).alias("serving"),
        (F.col("ml_pred") * fx.bias_factor("ml_pred", v, 10000.0, closed=True)).alias("training")), 6)


@query("g11_bias_three_tier", with_ctes("""
SELECT policy_id, round(ml_pred*CASE WHEN ml_pred<10000 THEN exp(0.04/2) WHEN ml_pred<14000 THEN exp(0.03/2) ELSE exp(0.02/2) END, 6) AS serving FROM priced"""))
def bias_three_tier(spark, d):
    v = {"low": 0.04, "mid": 0.03, "high": 0.02}
    return rounded(portfolio.priced(spark, d).select(
        KEY, (F.col("ml_pred") * fx.bias_factor("ml_pred", v, 10000.0, 14000.0)).alias("serving")), 6)


@query("g12_variance_bias", with_ctes("""
, q AS (SELECT quantile_cont(y_true,0.5) AS c FROM scored), r AS (SELECT ln(1+y_true)-ln(1+ml_pred) AS e, y_true<c AS lo, c FROM scored, q)
SELECT round(var_samp(e) FILTER (lo),8) AS var_low, round(var_samp(e) FILTER (NOT lo),8) AS var_high, round(max(c),4) AS threshold,
 count(*) FILTER (lo) AS n_low, count(*) FILTER (NOT lo) AS n_high, round(var_samp(e),8) AS var_all FROM r"""))
def variance_bias(spark, d):
    fit = op.fit_variance_bias(portfolio.scored(spark, d), p="ml_pred")
    return rounded(spark.createDataFrame([fit]), {"var_low": 8, "var_high": 8, "var_all": 8, "threshold": 4})


@query("g13_ratio_bias", with_ctes("""
, t AS (SELECT CASE WHEN ml_pred<=10000 THEN 'low' WHEN ml_pred<=14000 THEN 'mid' ELSE 'high' END AS tier, y_true/greatest(ml_pred,1e-8) AS r, ml_pred>y_true AS ov,
  CASE WHEN ml_pred<=10000 THEN y_true<=10000 WHEN ml_pred<=14000 THEN y_true>10000 AND y_true<=14000 ELSE false END AS own FROM scored),
g AS (SELECT tier, count(*) AS n, avg(CASE WHEN ov THEN 1.0 ELSE 0.0 END) AS o, count(*) FILTER (own) AS n_own, quantile_cont(r,0.5) AS ra, quantile_cont(r,0.5) FILTER (own) AS ro FROM t GROUP BY tier),
f AS (SELECT *, CASE WHEN o>=0.45 THEN CASE WHEN n_own>=30 THEN ro ELSE ra END END AS ratio FROM g),
v AS (SELECT *, CASE WHEN ratio>0 THEN greatest(2*ln(least(ratio,1.30)), 2*ln(0.90)) ELSE 0.000001 END AS variance FROM f)
SELECT tier, n, round(o,6) AS overpricing, n_own, round(ratio,6) AS ratio, round(variance,6) AS variance, round(exp(variance/2),6) AS factor FROM v"""))
def ratio_bias(spark, d):
    fit = op.fit_ratio_bias(portfolio.scored(spark, d), p="ml_pred")
    schema = "tier string, n long, overpricing double, n_own long, ratio double, variance double, factor double"
    return rounded(spark.createDataFrame([tuple(r.values()) for r in fit], schema), 6)


@query("g14_prediction_statistics", with_ctes("""
SELECT count(*) AS n, round(avg(x),4) AS mean, round(min(x),4) AS min, round(max(x),4) AS max, round(stddev_pop(x),4) AS std, round(stddev_pop(x)/avg(x),6) AS cv,
 count(*) FILTER (x<5000) AS n_low, count(*) FILTER (x>=5000 AND x<15000) AS n_mid, count(*) FILTER (x>=15000) AS n_high,
 round(count(*) FILTER (x<5000)*100.0/count(*),6) AS pct_low, round(count(*) FILTER (x>=5000 AND x<15000)*100.0/count(*),6) AS pct_mid, round(count(*) FILTER (x>=15000)*100.0/count(*),6) AS pct_high,
 round(quantile_cont(x,0.25),4) AS q25, round(quantile_cont(x,0.5),4) AS median, round(quantile_cont(x,0.75),4) AS q75, round(quantile_cont(x,0.75)-quantile_cont(x,0.25),4) AS iqr
FROM (SELECT hybrid_pred AS x FROM priced)"""))
def prediction_statistics(spark, d):
    out = op.prediction_statistics(portfolio.priced(spark, d))
    return rounded(out, {c: 6 if c[:2] in ("cv", "pc") else 4 for c in out.columns})


@query("g15_reliability", with_ctes("""
SELECT count(*) FILTER (hybrid_pred>100000) AS extreme_count, round(max(hybrid_pred),4) AS max_prediction, max(hybrid_pred)>100000 AS has_extreme FROM priced"""))
def reliability(spark, d):
    return rounded(op.reliability(portfolio.priced(spark, d)), 4)


@query("g16_negative_clip", with_ctes("""
SELECT policy_id, round(greatest(ml_pred-5000.0,0.0),6) AS price, ml_pred-5000.0<0 AS was_negative FROM priced"""))
def negative_clip(spark, d):
    rows = portfolio.priced(spark, d).select(KEY, (F.col("ml_pred") - 5000.0).alias("price"))
    return rounded(op.clipped(rows), {"price": 6})


def _grid_sql(field, smoker="smoker"):
    cells = ",".join(f"{float(v)}e0" for v in op.SWEEP_GRIDS[field])
    cols = ", ".join(f"{'v' if c == field else c} AS {c}" for c in ("age", "bmi", "children"))
    return (f"SELECT policy_id, base_premium, v AS grid_value, {cols}, {smoker} AS smoker, region FROM "
            f"(SELECT *, {ACT} AS base_premium, unnest([{cells}]) AS v FROM policies)")


def _register_sweep(field):
    @query(f"g17_sweep_{field}", with_ctes(f"""
, gr AS ({_grid_sql(field)}), pr AS (SELECT *, {ACT} AS premium FROM gr), ch AS (SELECT *, (premium-base_premium)/base_premium*100.0 AS change_pct FROM pr)
SELECT grid_value, count(*) AS n, round(avg(premium),4) AS mean_premium, round(min(premium),6) AS min_premium, round(max(premium),6) AS max_premium,
 round(avg(change_pct),6) AS mean_change_pct FROM ch GROUP BY grid_value"""))
    def run(spark, d):
        rows = op.sweep(portfolio.policies(spark, d), field)
        return rounded(op.sweep_curve(rows, "grid_value"), {
            "mean_premium": 4, "min_premium": 6, "max_premium": 6, "mean_change_pct": 6})


for _f in op.SWEEP_GRIDS:
    _register_sweep(_f)


@query("g18_sweep_two_way", with_ctes(f"""
, g0 AS ({_grid_sql('age')}), gr AS (SELECT policy_id, base_premium, grid_value, age, bmi, children, unnest(['no','yes']) AS smoker, region FROM g0),
pr AS (SELECT *, {ACT} AS premium FROM gr), ch AS (SELECT *, (premium-base_premium)/base_premium*100.0 AS change_pct FROM pr)
SELECT grid_value, smoker, count(*) AS n, round(avg(premium),4) AS mean_premium, round(min(premium),6) AS min_premium, round(max(premium),6) AS max_premium,
 round(avg(change_pct),6) AS mean_change_pct FROM ch GROUP BY grid_value, smoker"""))
def sweep_two_way(spark, d):
    rows = op.sweep(portfolio.policies(spark, d), "age", by_smoker=True)
    return rounded(op.sweep_curve(rows, "grid_value", "smoker"), {
        "mean_premium": 4, "min_premium": 6, "max_premium": 6, "mean_change_pct": 6})


@query("g19_last_scenarios", with_ctes("""
, r AS (SELECT region, policy_id, row_number() OVER (PARTITION BY region ORDER BY policy_id DESC) AS recency, age, bmi, smoker, hybrid_pred FROM priced)
SELECT region, policy_id, recency, age, round(bmi,4) AS bmi, smoker, round(hybrid_pred,4) AS premium FROM r WHERE recency<=5"""))
def last_scenarios(spark, d):
    rows = portfolio.priced(spark, d).select("region", KEY, "age", "bmi", "smoker", F.col("hybrid_pred").alias("premium"))
    return rounded(op.last_scenarios(rows, "region", KEY, 5), 4)


@query("g19_usage_summary", with_ctes(f"""
SELECT {ZONE} AS zone, count(*) AS n, round(avg(hybrid_pred),4) AS mean_premium, round(min(hybrid_pred),4) AS min_premium, round(max(hybrid_pred),4) AS max_premium
FROM priced GROUP BY 1"""))
def usage_summary(spark, d):
    rows = op.blended(portfolio.priced(spark, d))
    return rounded(rows.groupBy("zone").agg(
        F.count(F.lit(1)).alias("n"), F.avg("blended").alias("mean_premium"), F.min("blended").alias("min_premium"),
        F.max("blended").alias("max_premium")), 4)


@query("g19_risk_histogram", with_ctes(f"""
, l AS (SELECT CASE WHEN sc<30 THEN 'Low' WHEN sc<60 THEN 'Medium' ELSE 'High' END AS risk_level FROM (SELECT {SCORE_SQL} AS sc FROM policies))
SELECT CAST(p AS INT) AS position, v AS risk_level, (SELECT count(*) FROM l WHERE l.risk_level=v) AS n FROM (SELECT unnest([0,1,2]) AS p, unnest(['Low','Medium','High']) AS v)"""))
def risk_histogram(spark, d):
    rows = portfolio.policies(spark, d).select(features.risk_level(features.risk_score()).alias("risk_level"))
    return op.level_histogram(rows, ("Low", "Medium", "High"))


@query("g20_attach_results", with_ctes("""
SELECT r.policy_id, r.age, r.bmi, r.children, round(p.hybrid_pred,6) AS premium FROM raw_records r LEFT JOIN priced p ON p.policy_id=r.policy_id AND p.smoker='yes'"""))
def attach_results(spark, d):
    """Scored rows joined back to the raw records they came from; unscored ones stay."""
    results = portfolio.priced(spark, d).where(F.col("smoker") == "yes").select(KEY, F.col("hybrid_pred").alias("premium"))
    raw = portfolio.raw_records(spark, d).select(KEY, "age", "bmi", "children")
    return rounded(raw.join(results, KEY, "left"), {"premium": 6})


@query("i36_calibration_effect", with_ctes(f"""
SELECT round(avg({blend_sql('(ml_pred*1.08)')}-hybrid_pred),4) AS mean_effect, round(sum({blend_sql('(ml_pred*1.08)')}-hybrid_pred),2) AS total_effect FROM priced"""))
def calibration_effect(spark, d):
    effect = fx.hybrid(rule=Blend(factor=1.08)) - F.col("hybrid_pred")
    rows = portfolio.priced(spark, d).select(effect.alias("effect"))
    return rounded(rows.agg(F.avg("effect").alias("mean_effect"), F.sum("effect").alias("total_effect")),
                   {"mean_effect": 4, "total_effect": 2})


_CELLS = f"SELECT policy_id, charges, ml_pred, {BMI_CATEGORY} AS bmi_category, {AGE_GROUP} AS age_group, smoker FROM priced"
_BACKOFF = """cell3 AS (SELECT age_group, bmi_category, smoker, count(*) AS n, quantile_cont(charges,0.30) AS q FROM cells GROUP BY ALL),
cell2 AS (SELECT age_group, smoker, count(*) AS n, quantile_cont(charges,0.30) AS q FROM cells GROUP BY ALL),
cell1 AS (SELECT smoker, quantile_cont(charges,0.30) AS q FROM cells GROUP BY ALL),
risk AS (SELECT c.policy_id, c.charges, c.ml_pred, CASE WHEN a.n>=20 THEN a.q WHEN b.n>=20 THEN b.q ELSE e.q END AS risk_premium, CASE WHEN a.n>=20 THEN 3 WHEN b.n>=20 THEN 2 ELSE 1 END AS level
 FROM cells c LEFT JOIN cell3 a ON a.age_group=c.age_group AND a.bmi_category=c.bmi_category AND a.smoker=c.smoker
 LEFT JOIN cell2 b ON b.age_group=c.age_group AND b.smoker=c.smoker LEFT JOIN cell1 e ON e.smoker=c.smoker)"""


@query("f4_quantile_premium", with_ctes(f", {_BACKOFF} SELECT policy_id, round(risk_premium,6) AS risk_premium, level FROM risk", cells=_CELLS))
def quantile_premium(spark, d):
    df = portfolio.priced(spark, d)
    out = models.QuantileTable.fit(df, alpha=0.30).transform(df)
    return rounded(out.select(KEY, "risk_premium", "level"), {"risk_premium": 6})


@query("f5_two_model_premium", with_ctes(f""", {_BACKOFF}
SELECT policy_id, round(ml_pred,6) AS base, round(greatest(ml_pred*1.10, risk_premium),6) AS loaded, round(greatest(ml_pred*1.10, risk_premium)-ml_pred,6) AS delta FROM risk""", cells=_CELLS))
def two_model_premium(spark, d):
    df = portfolio.priced(spark, d)
    out = models.QuantileTable.fit(df, alpha=0.30).transform(df)
    loaded = fx.loaded_premium("ml_pred", "risk_premium")
    return rounded(out.select(KEY, F.col("ml_pred").alias("base"), loaded.alias("loaded"),
                              (loaded - F.col("ml_pred")).alias("delta")), 6)


_CANDIDATES = {"ml": "ml_pred", "actuarial": "act_pred", "hybrid": "hybrid_pred"}


@query("f9_best_model", with_ctes(f"""
, c AS (SELECT 'ml' AS model, {rmse_sql('y_true','ml_pred')} AS v, {r2_sql('y_true','ml_pred')} AS r FROM scored UNION ALL
 SELECT 'actuarial', {rmse_sql('y_true','act_pred')}, {r2_sql('y_true','act_pred')} FROM scored UNION ALL
 SELECT 'hybrid', {rmse_sql('y_true','hybrid_pred')}, {r2_sql('y_true','hybrid_pred')} FROM scored)
SELECT model, round(v,4) AS val_rmse, round(r,6) AS val_r2 FROM c ORDER BY v, model LIMIT 1"""))
def best_model(spark, d):
    scores = selection.model_scores(portfolio.scored(spark, d), _CANDIDATES)
    return rounded(selection.best_model(scores, ("hybrid", "ml", "actuarial")), {"val_rmse": 4, "val_r2": 6})


_LIN = """, l AS (SELECT count(*) AS n, least(greatest(regr_slope(y_true,ml_pred),0.0),2.0) AS a, regr_intercept(y_true,ml_pred) AS b FROM scored)"""


@query("f10_linear_calibrator", with_ctes(_LIN + """
SELECT n, round(a,8) AS slope, round(b,4) AS intercept FROM l"""))
def linear_calibrator(spark, d):
    fit = models.LinearCalibrator.fit(portfolio.scored(spark, d), "ml_pred")
    return rounded(spark.createDataFrame([(fit.n, fit.slope, fit.intercept)], "n long, slope double, intercept double"),
                   {"slope": 8, "intercept": 4})


# Calibrators are fitted on the table cal and judged on the table hold.
PARTS = f"""{holdout_sql("scored", "y_true")},
cal AS (SELECT s.* FROM scored s JOIN hp ON hp.policy_id=s.policy_id WHERE part='calibration'),
hold AS (SELECT s.* FROM scored s JOIN hp ON hp.policy_id=s.policy_id WHERE part='holdout')"""


def adoption_sql(table):
    """The verdict on ``calibrated`` against ml_pred over a table."""
    return f"""m AS (SELECT {rmse_sql('y_true','ml_pred')} AS r0, {r2_sql('y_true','ml_pred')} AS q0, avg(abs(ml_pred-y_true)) AS m0,
 {rmse_sql('y_true','calibrated')} AS r1, {r2_sql('y_true','calibrated')} AS q1, avg(abs(calibrated-y_true)) AS m1 FROM {table})
SELECT round(r0,4) AS rmse_before, round(r1,4) AS rmse_after, round(q0,6) AS r2_before, round(q1,6) AS r2_after, round(m0,4) AS mae_before, round(m1,4) AS mae_after,
 r1<r0*0.99 AS rmse_gain, q1>=q0 AS r2_kept, m1<=m0*1.02 AS mae_kept, r1<r0*0.99 AND q1>=q0 AND m1<=m0*1.02 AS adopt FROM m"""


def _verdict(rows):
    out = models.adoption(rows, "ml_pred", "calibrated")
    return rounded(out, {c: 6 if c.startswith("r2") else 4 for c in out.columns})


@query("f12_calibration_adoption", with_ctes(f""", {PARTS},
l AS (SELECT least(greatest(regr_slope(y_true,ml_pred),0.0),2.0) AS a, regr_intercept(y_true,ml_pred) AS b FROM cal),
c AS (SELECT y_true, ml_pred, a*ml_pred+b AS calibrated FROM hold, l), {adoption_sql("c")}"""))
def calibration_adoption(spark, d):
    df = splits.stored(splits.holdout(portfolio.scored(spark, d), "y_true"), "holdout")
    fit = models.LinearCalibrator.fit(df.where("part = 'calibration'"), "ml_pred")
    return _verdict(fit.transform(df.where("part = 'holdout'"), "calibrated"))


@query("f11_isotonic_calibrator", with_ctes(f""", {PARTS},
pt AS (SELECT ml_pred AS x, avg(y_true) AS y, count(*)*1.0 AS w, row_number() OVER (ORDER BY ml_pred) AS i FROM cal GROUP BY ml_pred),
cu AS (SELECT *, sum(w) OVER (ORDER BY i) AS cw, sum(w*y) OVER (ORDER BY i) AS cs FROM pt),
ab AS (SELECT a.i AS a, b.i AS b, (b.cs-a.cs+a.w*a.y)/(b.cw-a.cw+a.w) AS v FROM cu a JOIN cu b ON b.i>=a.i),
lows AS (SELECT a, b, min(v) OVER (PARTITION BY a ORDER BY b DESC) AS v FROM ab),
kn AS (SELECT x, g FROM pt JOIN (SELECT b AS i, max(v) AS g FROM lows GROUP BY b) z ON z.i=pt.i),
nb AS (SELECT y_true, ml_pred, k0.x AS x0, k0.g AS g0, k1.x AS x1, k1.g AS g1 FROM hold ASOF LEFT JOIN kn k0 ON ml_pred>=k0.x ASOF LEFT JOIN kn k1 ON ml_pred<=k1.x),
c AS (SELECT y_true, ml_pred, CASE WHEN x0 IS NULL THEN g1 WHEN x1 IS NULL OR x0=x1 THEN g0 ELSE g0+(g1-g0)*(ml_pred-x0)/(x1-x0) END AS calibrated FROM nb), {adoption_sql("c")}"""))
def isotonic_calibrator(spark, d):
    """Fitted on calibration rows, judged on the holdout. The SQL is the min-max form of the monotone fit."""
    df = splits.stored(splits.holdout(portfolio.scored(spark, d), "y_true"), "holdout")
    fit = isotonic.IsotonicCalibrator.fit(df.where("part = 'calibration'"), "ml_pred")
    return _verdict(fit.transform(df.where("part = 'holdout'"), "calibrated"))


def _route_case():
    x, out = "ml_pred", "ml_pred"
    for name, lo, hi in op.SPECIALIST_TIERS:
        last = hi == float("inf")
        parts = [f"WHEN {x}>={lo}" + ("" if last else f" AND {x}<{hi}") + f" THEN {name}",
                 f"WHEN {x}>={lo - 250.0} AND {x}<{lo} THEN (1.0-least(greatest(({x}-({lo - 250.0}))/250.0,0.0),1.0))*{x}"
                 f"+least(greatest(({x}-({lo - 250.0}))/250.0,0.0),1.0)*{name}"]
        if not last:
            parts.append(f"WHEN {x}>={hi} AND {x}<{hi + 250.0} THEN (1.0-least(greatest(1.0-({x}-{hi})/250.0,0.0),1.0))*{x}"
                         f"+least(greatest(1.0-({x}-{hi})/250.0,0.0),1.0)*{name}")
        out = f"CASE {' '.join(parts)} ELSE {out} END"
    return out


@query("f14_tier_routing", with_ctes(f"SELECT policy_id, round({_route_case()}, 6) AS routed FROM special", special=SPECIAL))
def tier_routing(spark, d):
    return rounded(specialists(spark, d).select(KEY, op.tier_routed().alias("routed")), 6)


@query("f15_smoker_lift", with_ctes("""
SELECT policy_id, round(CASE WHEN smoker='yes' AND ml_pred<10000 THEN 0.65*ml_pred+(1.0-0.65)*high_mid ELSE ml_pred END, 6) AS lifted FROM special""", special=SPECIAL))
def smoker_lift(spark, d):
    return rounded(specialists(spark, d).select(KEY, fx.smoker_lift("ml_pred", "high_mid").alias("lifted")), 6)


@query("f16_routing_guard", with_ctes(f"""
, r AS (SELECT charges AS y_true, ml_pred AS base, {_route_case()} AS routed FROM special),
t AS (SELECT {r2_sql('y_true','base')} AS a, {r2_sql('y_true','routed')} AS b FROM r)
SELECT round(a,6) AS r2_base, round(b,6) AS r2_routed, b>=a-0.005 AS accepted FROM t""", special=SPECIAL))
def routing_guard(spark, d):
    rows = specialists(spark, d).select(
        F.col("charges").alias("y_true"), F.col("ml_pred").alias("base"), op.tier_routed().alias("routed"))
    return rounded(gates.routing_guard(rows), 6)


@query("e8_specialist_feasibility", with_ctes("""
SELECT count(*) FILTER (charges>16701) AS n_high, count(*) FILTER (charges>16701)>=200 AS feasible FROM policies"""))
def specialist_feasibility(spark, d):
    return portfolio.policies(spark, d).agg(
        F.count_if(F.col("charges") > 16701.0).alias("n_high")).withColumn("feasible", F.col("n_high") >= 200)
