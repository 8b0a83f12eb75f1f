"""Row-local feature queries."""

from pyspark.sql import functions as F

from ratebook.config import KEY
from ratebook.functions import features as f
from ratebook.functions.columns import rounded
from ratebook.plans.registry import query
from ratebook.plans.sql import with_ctes
from ratebook.sources import portfolio

RISK = "SELECT *, CASE WHEN smoker='yes' THEN 1 ELSE 0 END AS s, CASE WHEN smoker='yes' THEN 0 ELSE 1 END AS n FROM policies"
PLACES = 8

BMI_CATEGORY = """CASE WHEN bmi <= 0 THEN NULL WHEN bmi <= 18.5 THEN 'underweight' WHEN bmi <= 25 THEN 'normal'
  WHEN bmi <= 30 THEN 'overweight' WHEN bmi <= 35 THEN 'obese_1' ELSE 'obese_2' END"""
AGE_GROUP = """CASE WHEN age <= 0 THEN NULL WHEN age <= 25 THEN 'young' WHEN age <= 35 THEN 'adult'
  WHEN age <= 50 THEN 'middle_aged' WHEN age <= 65 THEN 'senior' ELSE 'elderly' END"""
BMI_SEVERITY = """CASE WHEN bmi <= 0 THEN NULL WHEN bmi <= 18.5 THEN 1 WHEN bmi <= 25 THEN 2 WHEN bmi <= 30 THEN 4
  WHEN bmi <= 35 THEN 7 WHEN bmi <= 40 THEN 11 WHEN bmi <= 100 THEN 16 END"""
AGE_TIER = """CASE WHEN age <= 0 THEN NULL WHEN age <= 30 THEN 1 WHEN age <= 40 THEN 2 WHEN age <= 50 THEN 4
  WHEN age <= 60 THEN 7 WHEN age <= 70 THEN 11 WHEN age <= 100 THEN 15 END"""


def i(cond: str) -> str:
    return f"CAST(({cond}) AS INT)"


CHRONIC = f"({i('age>45 AND bmi>30')}*3 + {i('age>55 AND bmi>32')}*5 + {i('age>60 AND bmi>28')}*4)"

# name -> SQL; a leading "=" marks an integer or text column that is not rounded.
SQL_FEATURES = {
    "bands": {"bmi_category": "=" + BMI_CATEGORY, "age_group": "=" + AGE_GROUP},
    "unified_score": {"unified_risk_score":
        f"age/64.0*0.2 + bmi/50.0*0.2 + s*0.4 + children/5.0*0.1 + {i('bmi>35')}*0.1"},
    "interactions": {
        "smoker_bmi": "s*bmi", "age_bmi": "age*bmi", "smoker_age": "=s*age", "family_size": "=children+1",
        "bmi_squared": "bmi*bmi", "age_decade": "=CAST(age//10*10 AS INT)", "is_senior": "=" + i("age>=65"),
        "high_bmi": "=" + i("bmi>30"), "smoker_senior": f"=s*{i('age>=65')}", "smoker_children": "=s*(children+1)",
        "age_squared": "=age*age", "bmi_age_interaction": "(bmi-25.0)*(age-40)",
        "is_high_risk": "=" + i("bmi>30 AND s=1 AND age>50")},
    "compound": {
        "compound_risk_multiplicative": "s*(bmi/30.0)*(age/50.0)",
        "extreme_risk_flag": f"={i('s=1 AND bmi>30 AND age>50')}*(1+{i('bmi>35')}+{i('age>60')})",
        "smoker_bmi_squared": "s*(bmi*bmi)/1000.0", "smoker_age_exponential": "s*exp((age-40)/20.0)",
        "age_bmi_smoker_interaction": "age*bmi*s/1000.0"},
    "obesity_flags": {
        "senior_obese_smoker": "=" + i("age>55 AND bmi>30 AND s=1"),
        "very_obese_senior": "=" + i("bmi>35 AND age>55 AND s=0")},
    "nonsmoker_risk": {
        "nonsmoker_compound_risk": "n*greatest((age-25)/50.0,0.0)*greatest((bmi-18.0)/35.0,0.0)*(1.0+children*0.3)",
        "nonsmoker_chronic_proxy": f"n*{i('age>=45 AND bmi>30')}*age*bmi/1000.0"},
    "severity": {"bmi_severity_score": "=" + BMI_SEVERITY, "age_risk_tier": "=" + AGE_TIER},
    "health_proxies": {
        "family_health_burden": f"children*(1.0+{i('bmi>30')}*0.5)*(1.0+s*0.3)",
        "chronic_condition_proxy": "=" + CHRONIC,
        "age_bmi_exp": "least(greatest(exp(0.01*(age-40)*(bmi-25.0)),0.0),10.0)",
        "smoker_adjusted_bmi": "bmi*(1.0+s*0.5)",
        "hidden_health_risk": f"={i('age>50 AND bmi>32 AND s=0')}*3"},
    "premium_tier": {
        "minimal_risk_profile": "=" + i("age<30 AND bmi<25 AND s=0 AND children=0"),
        "age_cost_floor": "=CASE WHEN age<30 THEN 1500 WHEN age<40 THEN 2500 ELSE 4000 END",
        "youth_nonsmoker_discount": f"{i('age<35 AND s=0')}*(35-age)/35.0"},
    "tail_severity": {
        "extreme_health_burden": "s*greatest(bmi-32.0,0.0)*greatest(age-50.0,0.0)/500.0",
        "high_bmi_age_acceleration": f"{i('bmi>35')}*s*greatest(age-45.0,0.0)/20.0",
        "age_bmi_stress": "s*(greatest(age-40.0,0.0)*greatest(age-40.0,0.0))*(greatest(bmi-28.0,0.0)*greatest(bmi-28.0,0.0))/5000.0",
        "severe_risk_profile": "=" + i("s=1 AND bmi>38 AND age>58"),
        "high_value_severity": f"age/70.0*0.25 + bmi/50.0*0.25 + s*0.35 + {i('bmi>35')}*0.10 + {i('age>60')}*0.05",
        "smoker_extreme_bmi_age": "=" + i("s=1 AND bmi>35 AND age>45")},
    "domain_interactions": {
        "smoker_age_bmi": "s*age*bmi", "bmi_age_ratio": "bmi/(age+1)",
        "non_smoker_high_bmi_age": f"=n*{i('bmi>30')}*age", "non_smoker_senior": f"=n*{i('age>=65')}",
        "smoker_senior_interaction": f"=s*{i('age>=65')}", "extreme_bmi": "=" + i("bmi>35"),
        "non_smoker_multi_children": f"=n*{i('children>=2')}",
        "potential_catastrophic": "=" + i("age>40 AND bmi>35 AND children>=2"),
        "nonsmoker_age_bmi_quad": "n*((age-40)*(age-40))*((bmi-25.0)*(bmi-25.0))/10000.0",
        "age_severity_interaction": f"=age*({BMI_SEVERITY})",
        "chronic_risk_amplified": f"{CHRONIC}*(1.0+{i('age>55')}*0.5)",
        "nonsmoker_hidden_risk": f"n*{i('age>50 AND bmi>32')}*age*bmi/1000.0",
        "senior_bmi_penalty": f"{i('age>60')}*pow(greatest(bmi-25.0,0.0),1.5)"},
}


def feature_sql(*groups: str) -> str:
    columns = []
    for g in groups:
        for name, sql in SQL_FEATURES[g].items():
            columns.append(f"{sql[1:]} AS {name}" if sql.startswith("=") else f"round({sql}, {PLACES}) AS {name}")
    return with_ctes(f"SELECT policy_id, {', '.join(columns)} FROM risk", risk=RISK)


def _register(query_name: str, group: str):
    build = getattr(f, group)

    @query(query_name, feature_sql(group))
    def run(spark, d):
        df = portfolio.policies(spark, d).select(KEY, *[c.alias(n) for n, c in build().items()])
        return rounded(df, PLACES)


for _id, _group in {
    "c1_c2_bands": "bands", "c3_unified_score": "unified_score", "c4_interactions": "interactions",
    "c5_compound_risk": "compound", "c6_obesity_flags": "obesity_flags", "c7_nonsmoker_risk": "nonsmoker_risk",
    "c8_severity_tiers": "severity", "c9_health_proxies": "health_proxies", "c10_premium_tier": "premium_tier",
    "c11_tail_severity": "tail_severity", "c12_domain_interactions": "domain_interactions",
}.items():
    _register(_id, _group)


@query("c_all_features", feature_sql(*[g for g in SQL_FEATURES if g != "domain_interactions"]))
def all_features(spark, d):
    p = portfolio.policies(spark, d)
    return rounded(f.featured(p).drop(*[c for c in p.columns if c != KEY]), PLACES)


@query("c13_display_bmi", with_ctes("""
SELECT policy_id, CASE WHEN bmi<18.5 THEN 'Underweight' WHEN bmi<25 THEN 'Normal' WHEN bmi<30 THEN 'Overweight' ELSE 'Obese' END AS bmi_label
FROM policies"""))
def display_bmi(spark, d):
    return portfolio.policies(spark, d).select(KEY, f.display_bmi().alias("bmi_label"))


SCORE_SQL = """least(100, CASE WHEN smoker='yes' THEN 40 ELSE 0 END + CASE WHEN bmi>30 THEN 20 WHEN bmi>25 THEN 10 ELSE 0 END
  + CASE WHEN age>65 THEN 25 WHEN age>50 THEN 15 ELSE 0 END + CASE WHEN children>3 THEN 10 ELSE 0 END)"""


@query("c14_risk_score", with_ctes(f"""
SELECT policy_id, risk_score, CASE WHEN risk_score<30 THEN 'Low' WHEN risk_score<60 THEN 'Medium' ELSE 'High' END AS risk_level
FROM (SELECT policy_id, {SCORE_SQL} AS risk_score FROM policies)"""))
def risk_score(spark, d):
    return portfolio.policies(spark, d).select(KEY, f.risk_score().alias("risk_score")).withColumn(
        "risk_level", f.risk_level(F.col("risk_score")))
