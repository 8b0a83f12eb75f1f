"""Prediction interval queries."""

from pyspark.sql import functions as F

from ratebook.config import KEY
from ratebook.functions.columns import rounded
from ratebook.operators import intervals as iv, transforms as t
from ratebook.plans.registry import query
from ratebook.plans.sql import with_ctes
from ratebook.sources import portfolio


def calibration(spark, d):
    return portfolio.priced(spark, d).withColumns({
        "pred_z": F.log1p("ml_pred"), "residual_z": F.log1p("charges") - F.log1p("ml_pred")})


CALIB = "SELECT *, ln(1+ml_pred) AS pred_z, ln(1+charges)-ln(1+ml_pred) AS residual_z FROM priced"
_K = "least(CAST(ceil((n+1)*0.9) AS BIGINT)+1, n)"


@query("h1_conformal_width", with_ctes(f"""
, r AS (SELECT abs(residual_z) AS a, row_number() OVER (ORDER BY abs(residual_z)) AS rn, count(*) OVER () AS n FROM calib)
SELECT n, round(a,8) AS half_width FROM r WHERE rn={_K}""", calib=CALIB))
def conformal_width(spark, d):
    n, width = iv.conformal_half_width(calibration(spark, d), "residual_z")
    return rounded(spark.createDataFrame([(n, width)], "n long, half_width double"), 8)


BINS = f"""ov AS (SELECT a AS overall, n FROM (SELECT abs(residual_z) AS a, row_number() OVER (ORDER BY abs(residual_z)) AS rn, count(*) OVER () AS n FROM calib) WHERE rn={_K}),
cp AS (SELECT quantile_cont(abs(residual_z),0.95) AS cap FROM calib),
sd AS (SELECT residual_z>0 AS pos, abs(residual_z) AS a, row_number() OVER (PARTITION BY residual_z>0 ORDER BY abs(residual_z)) AS rn, count(*) OVER (PARTITION BY residual_z>0) AS k FROM calib WHERE residual_z<>0),
lv AS (SELECT ceil((n+1)*0.9)/n AS lev, overall FROM ov),
asym AS (SELECT max(a) FILTER (pos)/max(overall) AS up, max(a) FILTER (NOT pos)/max(overall) AS down FROM sd, lv WHERE rn=least(CAST(ceil((k-1)*lev) AS BIGINT)+1,k)),
sl AS (SELECT list_sort(list(pred_z)) AS s, count(*) AS m, greatest(1, least(10, count(*)//30)) AS nb FROM calib),
ed AS (SELECT nb, list_transform(range(1,nb+1), lambda i: s[CAST(floor(i/nb*(m-1)) AS BIGINT)+1] + (s[least(CAST(floor(i/nb*(m-1)) AS BIGINT)+2,m)]
  - s[CAST(floor(i/nb*(m-1)) AS BIGINT)+1])*(i/nb*(m-1)-floor(i/nb*(m-1)))) AS e FROM sl),
bn AS (SELECT c.*, least(len(list_filter(e, lambda x: pred_z > x)),nb-1) AS bin FROM calib c, ed),
bw AS (SELECT bin, a AS w FROM (SELECT bin, abs(residual_z) AS a, row_number() OVER (PARTITION BY bin ORDER BY abs(residual_z)) AS rn, count(*) OVER (PARTITION BY bin) AS n FROM bn) WHERE rn={_K}),
tb AS (SELECT bin, least(w,cap) AS width, e[bin+1] AS edge FROM bw, cp, ed)"""


def bins(df):
    return iv.ConformalBins.fit(df, "pred_z", "residual_z")


@query("h2_conformal_bins", with_ctes(f", {BINS} SELECT CAST(bin AS INT) AS bin, round(edge,8) AS right_edge, round(width,8) AS width, round(up,6) AS up, round(down,6) AS down FROM tb, asym", calib=CALIB))
def conformal_bins(spark, d):
    fit = bins(calibration(spark, d))
    rows = [(i, e, w, fit.up, fit.down) for i, (e, w) in enumerate(zip(fit.edges, fit.widths))]
    return rounded(spark.createDataFrame(rows, "bin int, right_edge double, width double, up double, down double"),
                   {"right_edge": 8, "width": 8, "up": 6, "down": 6})


APPLY = f"""{BINS}, f AS (SELECT min(charges)*0.6 AS lo, max(charges)*1.4 AS hi, avg(ln(1+charges))-3.0*stddev_samp(ln(1+charges)) AS zl, avg(ln(1+charges))+3.0*stddev_samp(ln(1+charges)) AS zh FROM policies),
ap AS (SELECT b.policy_id, b.charges AS y_true, b.ml_pred, b.hybrid_pred, greatest(exp(b.pred_z-width*down)-1,0.0) AS l, least(exp(b.pred_z+width*up)-1,hi*3.0) AS u,
 least(greatest(b.hybrid_pred/greatest(least(greatest(exp(least(greatest(b.pred_z,zl),zh))-1,lo),hi),1e-8),0.5),2.0) AS shift FROM bn b JOIN tb ON tb.bin=b.bin, asym, f),
iv AS (SELECT policy_id, y_true, ml_pred, hybrid_pred, l*shift AS lower, u*shift AS upper FROM ap)"""


def with_intervals(spark, d):
    df = calibration(spark, d)
    shape = t.TargetTransform.fit(df, method="log1p")
    return bins(df).transform(df, "pred_z", "hybrid_pred", shape).withColumn("y_true", F.col("charges"))


@query("h3_apply_bins", with_ctes(f", {APPLY} SELECT policy_id, round(lower,4) AS lower, round(upper,4) AS upper FROM iv", calib=CALIB))
def apply_bins(spark, d):
    return rounded(with_intervals(spark, d).select(KEY, "lower", "upper"), 4)


@query("h4_gaussian_width", with_ctes("SELECT count(*) AS n, round(1.6448536269514722*stddev_pop(residual_z),8) AS half_width FROM calib", calib=CALIB))
def gaussian_width(spark, d):
    df = calibration(spark, d)
    width = iv.gaussian_half_width(df, "residual_z")
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("half_width", F.round(F.lit(width), 8))


def _heur(name, spread):
    return (f"SELECT policy_id, '{name}' AS family, round(greatest(hybrid_pred-1.6448536269514722*{spread},0.0),4) AS lower, "
            f"round(hybrid_pred+1.6448536269514722*{spread},4) AS upper FROM priced")


@query("h5_heuristic_intervals", with_ctes(" UNION ALL ".join([
    _heur("boosted", "(hybrid_pred*0.15)"), _heur("linear", "((SELECT stddev_pop(hybrid_pred) FROM priced)*0.1)"), _heur("residual", "(hybrid_pred*0.2)")])))
def heuristic_intervals(spark, d):
    df = portfolio.priced(spark, d)
    parts = [iv.heuristic(df, "hybrid_pred", f).select(KEY, F.lit(f).alias("family"), "lower", "upper")
             for f in ("boosted", "linear", "residual")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 4)


# Bins from the calibration rows, applied to the others.
CALIB_FIT = CALIB + " WHERE policy_id%5<>0"
REST = CALIB + " WHERE policy_id%5=0"
APPLY_REST = APPLY.replace("FROM bn b JOIN tb", "FROM br b JOIN tb").replace("FROM policies)", "FROM calib)").replace(
    "ap AS (", "br AS (SELECT c.*, least(len(list_filter(e, lambda x: pred_z > x)),nb-1) AS bin FROM rest c, ed),\nap AS (")


@query("h7_coverage", with_ctes(f""", {APPLY_REST}, c AS (SELECT count(*) AS n, count(*) FILTER (y_true BETWEEN lower AND upper) AS k, avg(upper-lower) AS w, quantile_cont(upper-lower,0.5) AS m FROM iv)
SELECT n, k AS n_covered, round(k/n,6) AS empirical, round(w,4) AS mean_width, round(m,4) AS median_width, round(k/n-0.90,6) AS gap, k/n>=0.88 AS valid,
 CASE WHEN k/n BETWEEN 0.9*0.98 AND 0.9*1.02 THEN 'on_target' WHEN k/n BETWEEN 0.9*0.95 AND 0.9*1.05 THEN 'near_target' WHEN k/n<0.9*0.95 THEN 'under' ELSE 'over' END AS label FROM c""", calib=CALIB_FIT, rest=REST))
def coverage(spark, d):
    """Coverage of every fifth policy by bins fitted on the others."""
    df = calibration(spark, d)
    fit = df.where("policy_id % 5 <> 0")
    shape = t.TargetTransform.fit(fit, method="log1p")
    rest = bins(fit).transform(df.where("policy_id % 5 = 0"), "pred_z", "hybrid_pred", shape)
    out = iv.coverage(rest.withColumn("y_true", F.col("charges")))
    return rounded(out, {"empirical": 6, "gap": 6, "mean_width": 4, "median_width": 4})


@query("h8_width_guardrail", with_ctes(f""", {APPLY}, c AS (SELECT avg(upper-lower) AS w, quantile_cont(hybrid_pred,0.5) AS m FROM iv)
SELECT round(w,4) AS mean_width, round(m,4) AS median_prediction, round(w/m,6) AS width_ratio, w/m<=1.5 AS passed, w/m<=2.0 AS within_cap FROM c""", calib=CALIB))
def width_guardrail(spark, d):
    return rounded(iv.width_guardrail(with_intervals(spark, d), "hybrid_pred"),
                   {"mean_width": 4, "median_prediction": 4, "width_ratio": 6})


@query("h9_rescaled_interval", with_ctes("""
, i AS (SELECT policy_id, ml_pred, hybrid_pred, greatest(ml_pred-1.6448536269514722*(ml_pred*0.2),0.0)*(hybrid_pred/ml_pred) AS lower, (ml_pred+1.6448536269514722*(ml_pred*0.2))*(hybrid_pred/ml_pred) AS upper FROM priced)
SELECT policy_id, round(lower,4) AS lower, round(upper,4) AS upper, round((upper-lower)/hybrid_pred*100.0,4) AS width_pct, (upper-lower)/hybrid_pred*100.0>80 AS unreliable FROM i"""))
def rescaled_interval(spark, d):
    rows = iv.heuristic(portfolio.priced(spark, d), "ml_pred", "residual")
    return rounded(iv.rescaled(rows, "ml_pred", "hybrid_pred").select(KEY, "lower", "upper", "width_pct", "unreliable"), 4)


# Student's quantile by its expansion in the normal one (Hill), which agrees to ten digits from fifty rows on.
_T = "(z+(z*z*z+z)/(4*v)+(5*power(z,5)+16*power(z,3)+3*z)/(96*v*v)+(3*power(z,7)+19*power(z,5)+17*power(z,3)-15*z)/(384*v*v*v)+(79*power(z,9)+776*power(z,7)+1482*power(z,5)-1920*power(z,3)-945*z)/(92160*v*v*v*v))"


@query("h10_mean_interval", with_ctes(f"""
, s AS (SELECT count(charges) AS n, avg(charges) AS m, stddev_samp(charges) AS sd, count(charges)-1.0 AS v, 1.959963984540054 AS z FROM policies)
SELECT n, round(m,4) AS mean, round(m-{_T}*sd/sqrt(n),4) AS lower, round(m+{_T}*sd/sqrt(n),4) AS upper FROM s"""))
def mean_interval(spark, d):
    return rounded(iv.mean_interval(portfolio.policies(spark, d), "charges"), 4)


_BOUNDS = "SELECT policy_id, charges, 0.85*ml_pred AS lower, 1.10*ml_pred AS upper, policy_id%5=0 AS apart FROM priced"


@query("h1_quantile_bounds", with_ctes(f"""
, r AS (SELECT greatest(lower-charges, charges-upper) AS a, row_number() OVER (ORDER BY greatest(lower-charges, charges-upper)) AS rn, count(*) OVER () AS n FROM bounds WHERE NOT apart),
s AS (SELECT n, a FROM r WHERE rn={_K}),
m AS (SELECT charges, greatest(lower-a,0.0) AS l, greatest(upper+a,0.0) AS u FROM bounds, s WHERE apart)
SELECT max(s.n) AS n, round(max(s.a),4) AS shift, count(*) AS n_apart, round(avg(CASE WHEN charges BETWEEN l AND u THEN 1.0 ELSE 0.0 END),6) AS empirical, round(avg(u-l),4) AS mean_width FROM m, s""", bounds=_BOUNDS))
def quantile_bounds(spark, d):
    """Given bounds, adjusted on four fifths of the policies and judged on the last one."""
    df = portfolio.priced(spark, d).select(KEY, "charges", (F.col("ml_pred") * 0.85).alias("lower"), (F.col("ml_pred") * 1.10).alias("upper"))
    fit = iv.ConformalBounds.fit(df.where("policy_id % 5 <> 0"), "charges", "lower", "upper")
    out = iv.coverage(fit.transform(df.where("policy_id % 5 = 0"), "lower", "upper"), "charges")
    return rounded(out.select(F.lit(fit.n).cast("long").alias("n"), F.lit(fit.below).alias("shift"), F.col("n").alias("n_apart"), "empirical", "mean_width"),
                   {"shift": 4, "empirical": 6, "mean_width": 4})
