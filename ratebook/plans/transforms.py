"""Fitted transform queries."""

from pyspark.sql import functions as F

from ratebook.config import KEY
from ratebook.functions import features as fx
from ratebook.functions.columns import rounded
from ratebook.operators import pipeline, quantiles as q, transforms as t, validation
from ratebook.plans.features import AGE_GROUP, BMI_CATEGORY, SQL_FEATURES
from ratebook.plans.registry import query
from ratebook.plans.sql import with_ctes
from ratebook.sources import portfolio

NUM = "TRY_CAST(trim({0}) AS DOUBLE)"
GAPPY = f"""SELECT policy_id, trunc({NUM.format('age')}) AS age, CASE WHEN lower(trim(sex)) IN ('male','female') THEN lower(trim(sex)) END AS sex, {NUM.format('bmi')} AS bmi,
 trunc({NUM.format('children')}) AS children, smoker, CASE WHEN region IN ('northeast','northwest','southeast','southwest') THEN region END AS region,
 {NUM.format('bmi')}*{NUM.format('bmi')} AS bmi_squared FROM raw_records"""


def gappy(spark, d):
    """Records with unreadable numbers and unknown regions as nulls, and one derived column."""
    rows = validation.typed(portfolio.raw_records(spark, d))
    known = F.col("region").isin("northeast", "northwest", "southeast", "southwest")
    return rows.withColumns({"region": F.when(known, F.col("region")), "bmi_squared": F.col("bmi") * F.col("bmi")})


@query("d1_impute", with_ctes("""
, m AS (SELECT quantile_cont(age,0.5) AS age, quantile_cont(bmi,0.5) AS bmi, quantile_cont(children,0.5) AS kids, avg(bmi_squared) AS b2 FROM gappy),
mode_r AS (SELECT region FROM gappy WHERE region IS NOT NULL GROUP BY region ORDER BY count(*) DESC, region LIMIT 1),
mode_s AS (SELECT sex FROM gappy WHERE sex IS NOT NULL GROUP BY sex ORDER BY count(*) DESC, sex LIMIT 1)
SELECT policy_id, coalesce(g.age,m.age) AS age, coalesce(g.sex,mode_s.sex) AS sex, coalesce(g.bmi,m.bmi) AS bmi, coalesce(g.children,kids) AS children, smoker,
 coalesce(g.region,mode_r.region) AS region, round(coalesce(g.bmi_squared,b2),6) AS bmi_squared FROM gappy g, m, mode_r, mode_s""", gappy=GAPPY))
def impute(spark, d):
    rows = gappy(spark, d)
    return rounded(t.Imputer.fit(rows).transform(rows), {"bmi_squared": 6})


def featured(spark, d):
    return fx.featured(portfolio.policies(spark, d))


_FLAGS = {k: v for g in ("interactions", "compound", "obesity_flags") for k, v in SQL_FEATURES[g].items()}
_RISK = "SELECT *, CASE WHEN smoker='yes' THEN 1 ELSE 0 END AS s, CASE WHEN smoker='yes' THEN 0 ELSE 1 END AS n FROM policies"


@query("d2_low_variance", with_ctes("SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{k}' AS feature, round(var_pop({v.lstrip('=')}),4) AS variance, var_pop({v.lstrip('=')}) <= 1e-6 AS dropped FROM risk"
    for k, v in {**_FLAGS, "constant": "=0*age"}.items()) + ")", risk=_RISK))
def low_variance(spark, d):
    rows = featured(spark, d).select(*_FLAGS).withColumn("constant", F.lit(0))
    fit = t.VarianceFilter.fit(rows)
    out = [(k, v, k in fit.dropped) for k, v in fit.variances.items()]
    return rounded(spark.createDataFrame(out, "feature string, variance double, dropped boolean"), 4)


@query("d3_label_encode", with_ctes("""
SELECT policy_id, CASE lower(trim(sex)) WHEN 'female' THEN 0 WHEN 'male' THEN 1 ELSE (SELECT CASE sex WHEN 'female' THEN 0 ELSE 1 END FROM policies GROUP BY sex ORDER BY count(*) DESC, sex LIMIT 1) END AS sex,
 CASE smoker WHEN 'no' THEN 0 WHEN 'yes' THEN 1 END AS smoker FROM raw_records"""))
def label_encode(spark, d):
    """Classes learned on clean policies and replayed on raw records."""
    fit = t.LabelEncoder.fit(portfolio.policies(spark, d))
    raw = validation.typed(portfolio.raw_records(spark, d)).select(KEY, "sex", "smoker")
    return fit.transform(raw)


@query("d4_one_hot", with_ctes(f"""
, b AS (SELECT policy_id, region, {BMI_CATEGORY} AS bc, {AGE_GROUP} AS ag FROM policies),
h AS (SELECT r.policy_id, r.region, bc, ag FROM raw_records r JOIN b ON r.policy_id=b.policy_id)
SELECT policy_id, {", ".join(f"CAST(region='{r}' AS INT) AS region_{r}" for r in ("northwest", "southeast", "southwest"))},
 {", ".join(f"CAST(bc='{r}' AS INT) AS bmi_category_{r}" for r in ("obese_1", "obese_2", "overweight", "underweight"))},
 {", ".join(f"CAST(ag='{r}' AS INT) AS age_group_{r}" for r in ("elderly", "middle_aged", "senior", "young"))} FROM h"""))
def one_hot(spark, d):
    """Learned on clean policies; the unknown region of a raw record gives zeros."""
    clean = featured(spark, d).select(KEY, "region", "bmi_category", "age_group")
    fit = t.OneHot.fit(clean)
    raw = portfolio.raw_records(spark, d).select(KEY, "region").join(clean.drop("region"), KEY)
    return fit.transform(raw)


@query("d5_encoding_guard", with_ctes("SELECT count(*) AS n_rows, 0 AS n_nulls FROM policies"))
def encoding_guard(spark, d):
    rows = featured(spark, d).select(KEY, "age", "bmi", "children", "sex", "smoker", "region", "bmi_category", "age_group")
    encoded = t.OneHot.fit(rows).transform(t.LabelEncoder.fit(rows).transform(rows))
    return t.encoding_guard(rows, encoded)


_POLY = ("age", "bmi", "children", "bmi_squared", "age_squared", "family_size")
_POLY_SQL = {"age": "age", "bmi": "bmi", "children": "children", "bmi_squared": "(bmi*bmi)", "age_squared": "(age*age)", "family_size": "(children+1)"}


@query("d6_product_features", with_ctes("SELECT feature, round(v/1e9, 6) AS variance, row_number() OVER (ORDER BY v DESC) <= 10 AS kept FROM (" + " UNION ALL ".join(
    f"SELECT '{a}_x_{b}' AS feature, var_pop(CAST({_POLY_SQL[a]} AS DOUBLE)*{_POLY_SQL[b]}) AS v FROM policies"
    for i, a in enumerate(_POLY) for b in _POLY[i + 1:]) + ")"))
def product_features(spark, d):
    fit = t.Products.fit(featured(spark, d), _POLY, keep=10)
    kept = {fit.name(p) for p in fit.pairs}
    rows = [(k, v / 1e9, k in kept) for k, v in fit.variances.items()]  # in billions: up to 1e13 fits no fixed decimals
    return rounded(spark.createDataFrame(rows, "feature string, variance double, kept boolean"), 6)


_CORR = ("age", "bmi", "children", "charges", "smoker_bmi", "age_bmi", "smoker_age", "bmi_squared")
_CORR_SQL = {"age": "age", "bmi": "bmi", "children": "children", "charges": "charges", "smoker_bmi": "(s*bmi)", "age_bmi": "(age*bmi)",
             "smoker_age": "(s*age)", "bmi_squared": "(bmi*bmi)"}


@query("d7_correlations", with_ctes(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({_CORR_SQL[a]}, {_CORR_SQL[b]}), 8) AS correlation FROM risk"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]), risk=_RISK))
def correlations(spark, d):
    return rounded(t.correlations(featured(spark, d), _CORR), 8)


@query("d7_d8_collinear_drops")
def collinear_drops(spark, d):
    """Which features pruning removes, and by which rule."""
    rows = featured(spark, d).drop("bmi_category", "age_group", "sex", "region")
    rows = t.LabelEncoder.fit(rows, ["smoker"]).transform(rows)
    fit = t.CollinearityFilter.fit(rows, target="charges")
    out = [(c, "correlation", i) for i, c in enumerate(fit.correlation_drops)]
    out += [(c, "inflation", i) for i, c in enumerate(fit.inflation_drops)]
    return spark.createDataFrame(out, "feature string, rule string, position int")


_SCALED = ("age", "bmi", "children", "smoker_bmi", "is_senior")
_SCALED_SQL = {"age": "age", "bmi": "bmi", "children": "children", "smoker_bmi": "(CASE WHEN smoker='yes' THEN bmi ELSE 0.0 END)"}


@query("d9_scale", with_ctes("SELECT policy_id, CAST(age>=65 AS INT) AS is_senior, " + ", ".join(
    f"round(({v}-avg({v}) OVER ())/stddev_pop({v}) OVER (), 8) AS {k}" for k, v in _SCALED_SQL.items()) + " FROM policies"))
def scale(spark, d):
    rows = featured(spark, d).select(KEY, *_SCALED)
    return rounded(t.Scaler.fit(rows).transform(rows), 8)


@query("d11_iqr_outliers", with_ctes("""
, q AS (SELECT quantile_cont(charges,0.25) AS a, quantile_cont(charges,0.75) AS b FROM policies)
SELECT policy_id, charges < a-1.5*(b-a) OR charges > b+1.5*(b-a) AS outlier FROM policies, q"""))
def iqr_outliers(spark, d):
    return t.iqr_outliers(portfolio.policies(spark, d), "charges").select(KEY, "outlier")


@query("d12_fit_log1p", with_ctes("""
SELECT 'log1p' AS method, round(min(charges),4) AS min, round(max(charges),4) AS max, round(min(charges)*0.6,4) AS safe_min, round(max(charges)*1.4,4) AS safe_max,
 round(min(ln(1+charges)),8) AS z_min, round(max(ln(1+charges)),8) AS z_max, round(avg(ln(1+charges)),8) AS z_mean, round(stddev_samp(ln(1+charges)),8) AS z_std FROM policies"""))
def fit_log1p(spark, d):
    fit = t.TargetTransform.fit(portfolio.policies(spark, d), method="log1p")
    row = {k: v for k, v in vars(fit).items() if k != "lam"}
    out = spark.createDataFrame([tuple(row.values())], "method string, " + ", ".join(f"{k} double" for k in list(row)[1:]))
    return rounded(out, {k: 8 if k.startswith("z") else 4 for k in row})


@query("d12_fit_power")
def fit_power(spark, d):
    """Yeo-Johnson and Box-Cox shape parameters by maximum likelihood."""
    df = portfolio.policies(spark, d)
    rows = []
    for method in ("yeo-johnson", "boxcox"):
        f = t.TargetTransform.fit(df, method=method)
        rows.append((method, f.lam, f.safe_min, f.safe_max, f.z_mean, f.z_std))
    return rounded(spark.createDataFrame(
        rows, "method string, lam double, safe_min double, safe_max double, z_mean double, z_std double"), 4)


_POWERS = """, g AS (SELECT unnest([-0.5,0.0,0.25,0.5,1.0]) AS lam),
v AS (SELECT lam, CASE WHEN lam=0 THEN ln(charges+1) ELSE (pow(charges+1.0,lam)-1.0)/lam END AS yj, CASE WHEN lam=0 THEN ln(charges) ELSE (pow(charges,lam)-1.0)/lam END AS bc, charges FROM policies, g),
k AS (SELECT 'yeo-johnson' AS method, lam, -count(*)/2.0*ln(var_pop(yj))+(lam-1.0)*sum(ln(1+charges)) AS l FROM v GROUP BY lam
 UNION ALL SELECT 'boxcox', lam, -count(*)/2.0*ln(var_pop(bc))+(lam-1.0)*sum(ln(charges)) FROM v GROUP BY lam)"""


@query("d12_likelihood_grid", with_ctes(f"""{_POWERS}
SELECT method, CAST(lam AS DOUBLE) AS lam, round(l,3) AS log_likelihood, l=max(l) OVER (PARTITION BY method) AS best FROM k"""))
def likelihood_grid(spark, d):
    """What the shape parameter is chosen by, on a fixed grid that holds both logarithms."""
    df, points = portfolio.policies(spark, d), [-0.5, 0.0, 0.25, 0.5, 1.0]
    rows = []
    with q.kept(df.select("charges")) as narrow:
        for method in ("yeo-johnson", "boxcox"):
            found = t.log_likelihoods(narrow, "charges", method, points)
            rows += [(method, p, value, value == max(found)) for p, value in zip(points, found)]
    return rounded(spark.createDataFrame(rows, "method string, lam double, log_likelihood double, best boolean"), {"log_likelihood": 3})


_YJ = "CASE WHEN x>=0 THEN (pow(x+1.0,0.3)-1.0)/0.3 ELSE -(pow(1.0-x,1.7)-1.0)/1.7 END"


@query("d13_yeo_johnson", with_ctes(f"""
, v AS (SELECT policy_id, (charges-avg(charges) OVER ())/1000.0 AS x FROM policies), z AS (SELECT policy_id, x, {_YJ} AS z FROM v)
SELECT policy_id, round(z,8) AS z, round(CASE WHEN z>=0 THEN pow(z*0.3+1.0, 1.0/0.3)-1.0 ELSE 1.0-pow(1.0-z*1.7, 1.0/1.7) END,6) AS back FROM z"""))
def yeo_johnson(spark, d):
    """All four branches over both signs, and back."""
    from ratebook.functions import targets
    df = portfolio.policies(spark, d)
    mean = df.agg(F.avg("charges")).first()[0]
    rows = df.select(KEY, ((F.col("charges") - F.lit(mean)) / 1000.0).alias("x"))
    rows = rows.select(KEY, targets.yeo_johnson("x", 0.3).alias("z"))
    return rounded(rows.withColumn("back", targets.yeo_johnson_inverse("z", 0.3)), {"z": 8, "back": 6})


@query("d14_inverse_transform", with_ctes("""
, f AS (SELECT min(charges)*0.6 AS lo, max(charges)*1.4 AS hi, avg(ln(1+charges))-3.0*stddev_samp(ln(1+charges)) AS zl, avg(ln(1+charges))+3.0*stddev_samp(ln(1+charges)) AS zh FROM policies),
z AS (SELECT policy_id, ln(1+ml_pred)*1.05 AS z FROM learned)
SELECT policy_id, round(least(greatest(exp(least(greatest(z,zl),zh))-1,lo),hi),4) AS safe, round(exp(z)-1,4) AS free FROM z, f"""))
def inverse_transform(spark, d):
    rows = portfolio.with_ml_prediction(portfolio.policies(spark, d))
    fit = t.TargetTransform.fit(rows, method="log1p")
    z = F.log1p("ml_pred") * 1.05
    return rounded(rows.select(KEY, fit.invert(z).alias("safe"), fit.invert(z, safe=False).alias("free")), 4)


@query("d15_scale_check", with_ctes("""
SELECT 'original' AS scale, round(min(ml_pred),4) AS min, round(max(ml_pred),4) AS max, round(avg(ml_pred),4) AS mean, CASE WHEN max(ml_pred)<100 THEN 'transformed_scale' ELSE 'ok' END AS verdict, max(ml_pred)>=100 AS valid FROM learned
UNION ALL SELECT 'log', round(min(ln(1+ml_pred)),4), round(max(ln(1+ml_pred)),4), round(avg(ln(1+ml_pred)),4), CASE WHEN max(ln(1+ml_pred))>30 THEN 'original_scale' WHEN max(ln(1+ml_pred))<1 THEN 'too_small' ELSE 'ok' END,
 max(ln(1+ml_pred)) BETWEEN 1 AND 30 FROM learned"""))
def scale_check(spark, d):
    rows = portfolio.with_ml_prediction(portfolio.policies(spark, d)).select("ml_pred", F.log1p("ml_pred").alias("z"))
    out = t.scale_check(rows, "ml_pred").withColumn("scale", F.lit("original")).unionByName(
        t.scale_check(rows, "z", "log").withColumn("scale", F.lit("log")))
    return rounded(out, 4)


@query("d16_extrapolation", with_ctes("""
, f AS (SELECT min(charges) AS lo, max(charges) AS hi, max(charges)*1.4 AS sh FROM policies)
SELECT count(*) AS n, round(min(p),4) AS lowest, round(max(p),4) AS highest, count(*) FILTER (p<lo) AS n_below_min, count(*) FILTER (p>hi) AS n_above_max, count(*) FILTER (p>sh) AS n_above_safe_max,
 round(count(*) FILTER (p<lo)*100.0/count(*),6) AS pct_below_min, round(count(*) FILTER (p>hi)*100.0/count(*),6) AS pct_above_max, round(count(*) FILTER (p>sh)*100.0/count(*),6) AS pct_above_safe_max,
 round((max(p)-max(hi))/max(hi)*100.0,6) AS beyond_max_pct FROM (SELECT ml_pred*1.3 AS p FROM learned), f"""))
def extrapolation(spark, d):
    rows = portfolio.with_ml_prediction(portfolio.policies(spark, d))
    fit = t.TargetTransform.fit(rows, method="none")
    out = t.extrapolation(rows.select((F.col("ml_pred") * 1.3).alias("p")), "p", fit)
    return rounded(out, {c: 6 if "pct" in c else 4 for c in out.columns})


@query("d17_feature_pipeline")
def feature_pipeline(spark, d):
    """The whole pipeline fitted on policies and replayed on them."""
    p = portfolio.policies(spark, d)
    fit = pipeline.FeaturePipeline.fit(p)
    return rounded(fit.transform(p), 6)


@query("d17_whole_pipeline")
def whole_pipeline(spark, d):
    """With outliers left out of the fit and products of the continuous columns; which columns come out, and their scale."""
    p = portfolio.policies(spark, d)
    fit = pipeline.FeaturePipeline.fit(p, products=True, outliers=0.02)
    z = fit.transform(p)
    columns = list(fit.columns)
    stats = t.aggregate(z, {(c, k): f(c) for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_pop))})
    rows = [(c, i, stats[c, "mean"], stats[c, "std"]) for i, c in enumerate(columns)]
    return rounded(spark.createDataFrame(rows, "feature string, position int, mean double, std double"), 6)
