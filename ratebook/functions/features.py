"""Risk features as row-local expressions.

Each group returns named columns over age, bmi, children and smoker, so one
``select`` carries them all through a single generated stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratebook.config import AGE_EDGES, AGE_LABELS, BMI_EDGES, BMI_LABELS
from ratebook.functions.columns import above, band, clip, flag
from ratebook.functions.pricing import is_smoker

def _inputs():
    smoking = is_smoker()
    return F.col("age"), F.col("bmi"), F.col("children"), smoking, flag(smoking), flag(~smoking)


def bands() -> dict[str, Column]:
    return {
        "bmi_category": band("bmi", BMI_EDGES, BMI_LABELS),
        "age_group": band("age", AGE_EDGES, AGE_LABELS),
    }


def unified_score() -> dict[str, Column]:
    age, bmi, kids, _, s, _ = _inputs()
    return {"unified_risk_score":
            age / 64.0 * 0.2 + bmi / 50.0 * 0.2 + s * 0.4 + kids / 5.0 * 0.1 + flag(bmi > 35) * 0.1}


def interactions() -> dict[str, Column]:
    age, bmi, kids, smoking, s, _ = _inputs()
    return {
        "smoker_bmi": s * bmi,
        "age_bmi": age * bmi,
        "smoker_age": s * age,
        "family_size": kids + 1,
        "bmi_squared": bmi * bmi,
        "age_decade": (F.floor(age / 10) * 10).cast("int"),
        "is_senior": flag(age >= 65),
        "high_bmi": flag(bmi > 30),
        "smoker_senior": s * flag(age >= 65),
        "smoker_children": s * (kids + 1),
        "age_squared": age * age,
        "bmi_age_interaction": (bmi - 25.0) * (age - 40),
        "is_high_risk": flag((bmi > 30) & smoking & (age > 50)),
    }


def compound() -> dict[str, Column]:
    age, bmi, _, smoking, s, _ = _inputs()
    return {
        "compound_risk_multiplicative": s * (bmi / 30.0) * (age / 50.0),
        "extreme_risk_flag": F.when(
            smoking & (bmi > 30) & (age > 50), 1 + flag(bmi > 35) + flag(age > 60)).otherwise(0),
        "smoker_bmi_squared": s * (bmi * bmi) / 1000.0,
        "smoker_age_exponential": s * F.exp((age - 40) / 20.0),
        "age_bmi_smoker_interaction": age * bmi * s / 1000.0,
    }


def obesity_flags() -> dict[str, Column]:
    age, bmi, _, smoking, _, _ = _inputs()
    return {
        "senior_obese_smoker": flag((age > 55) & (bmi > 30) & smoking),
        "very_obese_senior": flag((bmi > 35) & (age > 55) & ~smoking),
    }


def nonsmoker_risk() -> dict[str, Column]:
    age, bmi, kids, _, _, n = _inputs()
    return {
        "nonsmoker_compound_risk":
            n * F.greatest((age - 25) / 50.0, F.lit(0.0)) * F.greatest((bmi - 18.0) / 35.0, F.lit(0.0))
            * (1.0 + kids * 0.3),
        "nonsmoker_chronic_proxy": n * flag((age >= 45) & (bmi > 30)) * age * bmi / 1000.0,
    }


def severity() -> dict[str, Column]:
    """Ordinal severity; values outside the outer edges have no tier and stay null."""
    return {
        "bmi_severity_score": band("bmi", (0.0, 18.5, 25.0, 30.0, 35.0, 40.0, 100.0), (1, 2, 4, 7, 11, 16)),
        "age_risk_tier": band("age", (0.0, 30.0, 40.0, 50.0, 60.0, 70.0, 100.0), (1, 2, 4, 7, 11, 15)),
    }


def chronic_proxy() -> Column:
    age, bmi = F.col("age"), F.col("bmi")
    return (flag((age > 45) & (bmi > 30)) * 3 + flag((age > 55) & (bmi > 32)) * 5
            + flag((age > 60) & (bmi > 28)) * 4)


def health_proxies() -> dict[str, Column]:
    age, bmi, kids, smoking, s, _ = _inputs()
    return {
        "family_health_burden": kids * (1.0 + flag(bmi > 30) * 0.5) * (1.0 + s * 0.3),
        "chronic_condition_proxy": chronic_proxy(),
        "age_bmi_exp": clip(F.exp(0.01 * (age - 40) * (bmi - 25.0)), 0.0, 10.0),
        "smoker_adjusted_bmi": bmi * (1.0 + s * 0.5),
        "hidden_health_risk": flag((age > 50) & (bmi > 32) & ~smoking) * 3,
    }


def premium_tier(floors=(1500, 2500, 4000), breaks=(30, 40)) -> dict[str, Column]:
    age, bmi, kids, smoking, _, _ = _inputs()
    return {
        "minimal_risk_profile": flag((age < 30) & (bmi < 25) & ~smoking & (kids == 0)),
        "age_cost_floor": F.when(age < breaks[0], floors[0]).when(age < breaks[1], floors[1]).otherwise(floors[2]),
        "youth_nonsmoker_discount": flag((age < 35) & ~smoking) * (35 - age) / 35.0,
    }


def tail_severity() -> dict[str, Column]:
    age, bmi, _, smoking, s, _ = _inputs()
    return {
        "extreme_health_burden": s * above(bmi, 32.0) * above(age, 50.0) / 500.0,
        "high_bmi_age_acceleration": flag(bmi > 35) * s * above(age, 45.0) / 20.0,
        "age_bmi_stress":
            s * (above(age, 40.0) * above(age, 40.0)) * (above(bmi, 28.0) * above(bmi, 28.0)) / 5000.0,
        "severe_risk_profile": flag(smoking & (bmi > 38) & (age > 58)),
        "high_value_severity":
            age / 70.0 * 0.25 + bmi / 50.0 * 0.25 + s * 0.35 + flag(bmi > 35) * 0.10 + flag(age > 60) * 0.05,
        "smoker_extreme_bmi_age": flag(smoking & (bmi > 35) & (age > 45)),
    }


def domain_interactions() -> dict[str, Column]:
    """Built after encoding in the fitted pipeline; here smoker may be text or 0/1."""
    age, bmi, kids, smoking, s, n = _inputs()
    return {
        "smoker_age_bmi": s * age * bmi,
        "bmi_age_ratio": bmi / (age + 1),
        "non_smoker_high_bmi_age": n * flag(bmi > 30) * age,
        "non_smoker_senior": n * flag(age >= 65),
        "smoker_senior_interaction": s * flag(age >= 65),
        "extreme_bmi": flag(bmi > 35),
        "non_smoker_multi_children": n * flag(kids >= 2),
        "potential_catastrophic": flag((age > 40) & (bmi > 35) & (kids >= 2)),
        "nonsmoker_age_bmi_quad":
            n * ((age - 40) * (age - 40)) * ((bmi - 25.0) * (bmi - 25.0)) / 10000.0,
        "age_severity_interaction": age * severity()["bmi_severity_score"],
        "chronic_risk_amplified": chronic_proxy() * (1.0 + flag(age > 55) * 0.5),
        "nonsmoker_hidden_risk": n * flag((age > 50) & (bmi > 32)) * age * bmi / 1000.0,
        "senior_bmi_penalty": flag(age > 60) * F.pow(above(bmi, 25.0), F.lit(1.5)),
    }


def display_bmi() -> Column:
    """Left-closed labels for display."""
    bmi = F.col("bmi")
    return (F.when(bmi.isNull(), "Invalid").when(bmi < 18.5, "Underweight").when(bmi < 25, "Normal")
            .when(bmi < 30, "Overweight").otherwise("Obese"))


def risk_score() -> Column:
    age, bmi, kids, smoking, _, _ = _inputs()
    return F.least(
        F.lit(100),
        F.when(smoking, 40).otherwise(0)
        + F.when(bmi > 30, 20).when(bmi > 25, 10).otherwise(0)
        + F.when(age > 65, 25).when(age > 50, 15).otherwise(0)
        + F.when(kids > 3, 10).otherwise(0))


def risk_level(score: Column) -> Column:
    return F.when(score < 30, "Low").when(score < 60, "Medium").otherwise("High")


BASE_GROUPS = (
    bands, unified_score, interactions, compound, obesity_flags, nonsmoker_risk,
    severity, health_proxies, premium_tier, tail_severity,
)


def all_features() -> dict[str, Column]:
    out: dict[str, Column] = {}
    for group in BASE_GROUPS:
        out.update(group())
    return out


def featured(df: DataFrame) -> DataFrame:
    """Input columns plus every base feature in one projection."""
    return df.select("*", *[c.alias(n) for n, c in all_features().items()])


def with_domain_interactions(df: DataFrame) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in domain_interactions().items()])
