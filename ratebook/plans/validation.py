"""Validation and cleaning queries."""

from pyspark.sql import functions as F

from ratebook.config import KEY, POLICY_COLUMNS, TARGET
from ratebook.functions import checks
from ratebook.functions.columns import rounded
from ratebook.functions.pricing import actuarial_premium
from ratebook.operators import validation as v
from ratebook.plans.registry import query
from ratebook.plans.sql import ACT, with_ctes
from ratebook.sources import portfolio

NUM = "TRY_CAST(trim({0}) AS DOUBLE)"
_age, _bmi, _kids = (NUM.format(c) for c in ("age", "bmi", "children"))
ERRORS = f"""concat_ws('|',
  CASE WHEN age IS NULL THEN 'age_missing' WHEN {_age} IS NULL THEN 'age_not_numeric' END,
  CASE WHEN {_age} < 18 OR {_age} > 120 THEN 'age_out_of_range' END,
  CASE WHEN {_age} <> trunc({_age}) THEN 'age_not_integer' END,
  CASE WHEN lower(trim(sex)) IN ('male','female') THEN NULL ELSE 'sex_unknown' END,
  CASE WHEN bmi IS NULL THEN 'bmi_missing' WHEN {_bmi} IS NULL THEN 'bmi_not_numeric' END,
  CASE WHEN {_bmi} < 10 OR {_bmi} > 100 THEN 'bmi_out_of_range' END,
  CASE WHEN children IS NULL THEN 'children_missing' WHEN {_kids} IS NULL THEN 'children_not_numeric' END,
  CASE WHEN {_kids} < 0 OR {_kids} > 20 THEN 'children_out_of_range' END,
  CASE WHEN {_kids} <> trunc({_kids}) THEN 'children_not_integer' END,
  CASE WHEN lower(trim(smoker)) IN ('yes','no') THEN NULL ELSE 'smoker_unknown' END,
  CASE WHEN lower(trim(region)) IN ('northeast','northwest','southeast','southwest') THEN NULL ELSE 'region_unknown' END)"""
CHECKED = f"SELECT *, {ERRORS} AS errors FROM raw_records"


@query("a3_cast_report", with_ctes(f"""
SELECT col AS "column", count(*) AS n_rows, count(*) FILTER (raw IS NOT NULL AND TRY_CAST(trim(raw) AS DOUBLE) IS NULL) AS non_numeric,
  min(raw) FILTER (raw IS NOT NULL AND TRY_CAST(trim(raw) AS DOUBLE) IS NULL) AS example
FROM (SELECT 'age' AS col, age AS raw FROM raw_records UNION ALL SELECT 'bmi', bmi FROM raw_records
      UNION ALL SELECT 'children', children FROM raw_records) GROUP BY col"""))
def cast_report(spark, d):
    return v.cast_failures(portfolio.raw_records(spark, d))


@query("a3_cast_values", with_ctes(f"""
SELECT policy_id, CAST(trunc({_age}) AS INT) AS age, {_bmi} AS bmi, CAST(trunc({_kids}) AS INT) AS children,
  lower(trim(sex)) AS sex, lower(trim(smoker)) AS smoker, lower(trim(region)) AS region FROM raw_records"""))
def cast_values(spark, d):
    return v.typed(portfolio.raw_records(spark, d))


@query("b1_validate_keep", with_ctes(f"""
SELECT policy_id, CAST({_age} AS INT) AS age, lower(trim(sex)) AS sex, {_bmi} AS bmi, CAST({_kids} AS INT) AS children,
  lower(trim(smoker)) AS smoker, lower(trim(region)) AS region FROM checked WHERE errors = ''""", checked=CHECKED))
def validate_keep(spark, d):
    return v.split_valid(portfolio.raw_records(spark, d))[0]


@query("b1_validate_quarantine", with_ctes(
    "SELECT policy_id, age, sex, bmi, children, smoker, region, errors FROM checked WHERE errors <> ''", checked=CHECKED))
def validate_quarantine(spark, d):
    bad = v.split_valid(portfolio.raw_records(spark, d))[1]
    return bad.withColumn("errors", F.concat_ws("|", "errors"))


@query("b2_strict_offenders", with_ctes(
    "SELECT policy_id, errors FROM checked WHERE errors <> '' ORDER BY policy_id LIMIT 20", checked=CHECKED))
def strict_offenders(spark, d):
    return v.offending_rows(portfolio.raw_records(spark, d))


@query("b3_normalise", with_ctes(
    "SELECT policy_id, lower(trim(sex)) AS sex, lower(trim(smoker)) AS smoker, lower(trim(region)) AS region FROM raw_records"))
def normalise(spark, d):
    return portfolio.raw_records(spark, d).select(
        KEY, *[checks.normal(c).alias(c) for c in ("sex", "smoker", "region")])


@query("b4_deduplicate", with_ctes("""
SELECT min(policy_id) AS policy_id, age, sex, bmi, children, smoker, region, round(charges, 6) AS charges
FROM duplicated GROUP BY age, sex, bmi, children, smoker, region, charges"""))
def deduplicate(spark, d):
    return rounded(v.without_duplicates(portfolio.duplicated(spark, d)), {"charges": 6})


@query("b5_drop_nulls", with_ctes(f"""
SELECT policy_id, CAST(trunc({_age}) AS INT) AS age, lower(trim(sex)) AS sex, {_bmi} AS bmi,
  CAST(trunc({_kids}) AS INT) AS children, lower(trim(smoker)) AS smoker, lower(trim(region)) AS region
FROM raw_records WHERE {_age} IS NOT NULL AND {_bmi} IS NOT NULL AND {_kids} IS NOT NULL"""))
def drop_nulls(spark, d):
    return v.without_nulls(v.typed(portfolio.raw_records(spark, d)), POLICY_COLUMNS)


@query("b6_quality_profile", with_ctes("""
, dup AS (SELECT sum(n-1) AS duplicates FROM (SELECT count(*) AS n FROM duplicated
          GROUP BY age, sex, bmi, children, smoker, region, charges)),
t AS (SELECT count(*) AS n_rows, min(charges) AS mn, max(charges) AS mx, avg(charges) AS av,
      quantile_cont(charges, 0.5) AS md, stddev_samp(charges) AS sd FROM duplicated),
c AS (SELECT unnest(['age','sex','bmi','children','smoker','region','charges']) AS name,
      unnest([count(*)-count(age), count(*)-count(sex), count(*)-count(bmi), count(*)-count(children),
              count(*)-count(smoker), count(*)-count(region), count(*)-count(charges)]) AS nulls FROM duplicated)
SELECT name AS "column", n_rows, nulls, round(nulls*100.0/n_rows, 4) AS null_pct, CAST(duplicates AS BIGINT) AS duplicates,
  round(CASE WHEN name='charges' THEN mn END, 4) AS min, round(CASE WHEN name='charges' THEN mx END, 4) AS max,
  round(CASE WHEN name='charges' THEN av END, 4) AS mean, round(CASE WHEN name='charges' THEN md END, 4) AS median,
  round(CASE WHEN name='charges' THEN sd END, 4) AS std FROM c, dup, t"""))
def quality_profile(spark, d):
    return rounded(v.quality_profile(portfolio.duplicated(spark, d)), 4)


_LONG = """SELECT 'age' AS feature, CAST(age AS DOUBLE) AS value FROM policies UNION ALL SELECT 'bmi', bmi FROM policies
  UNION ALL SELECT 'children', CAST(children AS DOUBLE) FROM policies UNION ALL SELECT 'charges', charges FROM policies"""


@query("b7_describe", with_ctes("""
SELECT feature, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max FROM melted GROUP BY feature""", melted=_LONG))
def describe(spark, d):
    return rounded(v.describe(portfolio.policies(spark, d)), 6)


@query("b7_value_counts", with_ctes("""
SELECT 'sex' AS feature, sex AS value, count(*) AS n FROM policies GROUP BY sex
UNION ALL SELECT 'smoker', smoker, count(*) FROM policies GROUP BY smoker
UNION ALL SELECT 'region', region, count(*) FROM policies GROUP BY region"""))
def value_counts(spark, d):
    return v.value_counts(portfolio.policies(spark, d))


@query("b8_fill_defaults", with_ctes(f"""
, f AS (SELECT policy_id, concat_ws(',', CASE WHEN age IS NULL OR trim(age)='' THEN 'age' END, CASE WHEN sex IS NULL OR trim(sex)='' THEN 'sex' END,
    CASE WHEN bmi IS NULL OR trim(bmi)='' THEN 'bmi' END, CASE WHEN children IS NULL OR trim(children)='' THEN 'children' END,
    CASE WHEN smoker IS NULL OR trim(smoker)='' THEN 'smoker' END, CASE WHEN region IS NULL OR trim(region)='' THEN 'region' END) AS imputed_fields,
  coalesce(CAST(trunc({_age}) AS INT), 30) AS age, coalesce(lower(trim(sex)), 'male') AS sex, coalesce({_bmi}, 25.0) AS bmi,
  coalesce(CAST(trunc({_kids}) AS INT), 0) AS children, coalesce(lower(trim(smoker)), 'no') AS smoker,
  coalesce(lower(trim(region)), 'northeast') AS region FROM raw_records)
SELECT *, CASE WHEN imputed_fields = '' THEN 'success' ELSE 'success_with_imputation' END AS status FROM f"""))
def fill_defaults(spark, d):
    return v.filled(portfolio.raw_records(spark, d))


@query("b9_formula_screen", with_ctes(r"""
, t AS (SELECT policy_id, regexp_replace(note, '^\s+|\s+$', '', 'g') AS n FROM noted)
SELECT policy_id, 'note' AS columns FROM t WHERE n <> '' AND TRY_CAST(n AS DOUBLE) IS NULL AND
 (left(n,1) IN ('=','+','-','@','|','#','%','~','^') OR contains(lower(n),'cmd|') OR contains(lower(n),'powershell')
  OR contains(lower(n),'system(') OR contains(lower(n),'exec(') OR contains(lower(n),'eval(') OR contains(lower(n),'@sum')
  OR contains(lower(n),'@if') OR contains(lower(n),'@cmd') OR contains(lower(n),'dde') OR contains(lower(n),'|calc')
  OR contains(lower(n),'|cmd'))"""))
def formula_screen(spark, d):
    return v.unsafe_cells(portfolio.noted(spark, d))


@query("b10_bmi_from_measures", with_ctes("""
, m AS (SELECT policy_id, 45.0 + (policy_id*17) % 211 AS height_cm, 15.0 + (policy_id*29) % 290 AS weight_kg FROM policies),
c AS (SELECT *, round_even(weight_kg/((height_cm/100.0)*(height_cm/100.0)), 1) AS b FROM m),
e AS (SELECT *, CASE WHEN height_cm NOT BETWEEN 50 AND 250 THEN 'height_out_of_range'
   WHEN weight_kg NOT BETWEEN 20 AND 300 THEN 'weight_out_of_range' WHEN b NOT BETWEEN 10 AND 60 THEN 'bmi_out_of_range' END AS error FROM c)
SELECT policy_id, height_cm, weight_kg, CASE WHEN error IS NULL THEN b END AS bmi, error FROM e"""))
def bmi_from_measures(spark, d):
    key = F.col(KEY)
    measured = portfolio.policies(spark, d).select(
        KEY, (F.lit(45.0) + (key * 17) % 211).alias("height_cm"), (F.lit(15.0) + (key * 29) % 290).alias("weight_kg"))
    bmi, error = checks.bmi_from_measures("height_cm", "weight_kg")
    return measured.withColumns({"bmi": bmi, "error": error})


@query("b11_batch_status", with_ctes("""
SELECT count(*) AS total, count(*) FILTER (errors = '') AS successful, count(*) FILTER (errors <> '') AS failed FROM checked""",
    checked=CHECKED))
def batch_status(spark, d):
    return v.checked(portfolio.raw_records(spark, d)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "error").alias("failed"))


@query("b11_batch_records", with_ctes(f"""
, ok AS (SELECT policy_id, CAST({_age} AS INT) AS age, {_bmi} AS bmi, CAST({_kids} AS INT) AS children, smoker, region, errors FROM checked WHERE errors = '')
SELECT policy_id, 'success' AS status, round({ACT}, 6) AS prediction, CAST(NULL AS VARCHAR) AS error FROM ok
UNION ALL SELECT policy_id, 'error', NULL, errors FROM checked WHERE errors <> ''""", checked=CHECKED))
def batch_records(spark, d):
    rows = v.checked(portfolio.raw_records(spark, d))
    price = actuarial_premium(checks.as_int("age"), checks.as_number("bmi"), checks.as_int("children"))
    good = F.col("status") == "success"
    return rows.select(
        KEY, "status", F.round(F.when(good, price), 6).alias("prediction"),
        F.when(~good, F.concat_ws("|", "errors")).alias("error"))


@query("b12_fingerprint", with_ctes("""
SELECT policy_id, substr(sha256(concat_ws('|', 'age='||coalesce(lower(trim(age)),''), 'bmi='||coalesce(lower(trim(bmi)),''),
  'children='||coalesce(lower(trim(children)),''), 'region='||coalesce(lower(trim(region)),''), 'sex='||coalesce(lower(trim(sex)),''),
  'smoker='||coalesce(lower(trim(smoker)),''))), 1, 12) AS fingerprint FROM raw_records"""))
def fingerprint(spark, d):
    return portfolio.raw_records(spark, d).select(KEY, checks.fingerprint().alias("fingerprint"))


@query("b13_advisories", with_ctes("""
SELECT policy_id, concat_ws('|', CASE WHEN age > 65 THEN 'senior_premium' END, CASE WHEN bmi > 30 THEN 'obesity_range' END,
  CASE WHEN children > 3 THEN 'large_family' END) AS advisories FROM policies"""))
def advisories(spark, d):
    return portfolio.policies(spark, d).select(KEY, F.concat_ws("|", checks.advisories()).alias("advisories"))


@query("b14_range_screen", with_ctes(f"""
SELECT policy_id, coalesce({_bmi} BETWEEN 10 AND 100 AND trunc({_age}) BETWEEN 18 AND 120 AND lower(trim(smoker)) IN ('yes','no'), false) AS in_range
FROM raw_records"""))
def range_screen(spark, d):
    return v.typed(portfolio.raw_records(spark, d)).select(KEY, checks.in_feature_range().alias("in_range"))
