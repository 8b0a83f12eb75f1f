"""Rating, economics and gate parameters as small immutable objects.

The numbers below are fixed values: they must equal the published rating
configuration for premiums, profits and gate verdicts to come out the same.
"""

from __future__ import annotations

from dataclasses import dataclass, field

INF = float("inf")

# The categorical domains and defaults of a policy record.
SEXES = ("female", "male")
SMOKER_VALUES = ("no", "yes")
REGIONS = ("northeast", "northwest", "southeast", "southwest")
POLICY_COLUMNS = ("age", "sex", "bmi", "children", "smoker", "region")
TARGET = "charges"
KEY = "policy_id"
RECORD_DEFAULTS = {
    "age": 30,
    "sex": "male",
    "bmi": 25.0,
    "children": 0,
    "smoker": "no",
    "region": "northeast",
}

# Band edges.
BMI_EDGES = (0.0, 18.5, 25.0, 30.0, 35.0, INF)
BMI_LABELS = ("underweight", "normal", "overweight", "obese_1", "obese_2")
AGE_EDGES = (0.0, 25.0, 35.0, 50.0, 65.0, INF)
AGE_LABELS = ("young", "adult", "middle_aged", "senior", "elderly")
HIGH_VALUE = 16701.0


@dataclass(frozen=True)
class Bounds:
    bmi_min: float = 10.0
    bmi_max: float = 100.0
    age_min: int = 18
    age_max: int = 120
    children_min: int = 0
    children_max: int = 20


@dataclass(frozen=True)
class Actuarial:
    base: float = 3038.0
    age_coefficient: float = 59.0
    bmi_threshold: float = 25.0
    bmi_penalty: float = 118.2
    children_cost: float = 675.0
    smoker_multiplier: float = 3.5
    smoker_bmi_age: float = 8.0
    regions: dict = field(
        default_factory=lambda: {
            "northeast": 1.05,
            "southeast": 1.02,
            "northwest": 0.97,
            "southwest": 1.00,
        }
    )


@dataclass(frozen=True)
class Blend:
    threshold: float = 7500.0
    ml_ratio: float = 0.70
    window: float | None = 1000.0
    cap: float = 1.10
    floor: float = 0.75
    factor: float = 1.0
    factor_on_ml_only: bool = True
    clamp_weight: bool = False


@dataclass(frozen=True)
class Economics:
    margin: float = 0.15
    admin: float = 25.0
    churn_threshold: float = 0.40
    churn_sensitivity: float = 1.0
    churn_cap: float = 0.80
    acquisition_cost: float = 200.0
    lifetime_multiplier: float = 1.5
    underpricing_share: float = 0.3
    underpricing_cap: float = 0.2
    severe_share: float = 0.50
    severe_penalty: float = 200.0
    error_band: float = 0.30
    accuracy_bonus: float = 150.0
    profit_target: float = 680.0
    churn_low: float = 0.10
    churn_high: float = 0.20
    retention_max: float = 30.0
    quality_weight: float = 20.0


@dataclass(frozen=True)
class Tiers:
    """A named set of right-closed bands; the first edge belongs to the first band."""

    edges: tuple
    labels: tuple
    weights: tuple = ()


SEGMENTS = Tiers((-INF, 4500.0, 15000.0, 30000.0, INF),
                 ("low_risk", "standard", "high_risk", "catastrophic"))
GATE_TIERS = Tiers((0.0, 5000.0, 10000.0, 14000.0, HIGH_VALUE, INF),
                   ("Low", "Mid", "High", "High+", "Very High"),
                   (1.0, 1.5, 2.5, 3.2, 4.0))
FOUR_TIERS = Tiers((0.0, 5000.0, 10000.0, HIGH_VALUE, INF),
                   ("Low", "Mid", "High", "Very High"),
                   (1.0, 1.5, 2.5, 4.0))
PREDICTION_BINS = Tiers((0.0, 5000.0, 10000.0, 20000.0, INF),
                        ("0-5000", "5000-10000", "10000-20000", "20000+"))

# Sample-weight tiers over the target quantiles.
WEIGHT_QUANTILES = (0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
WEIGHT_TIERS = (1.0, 1.0, 1.05, 1.15, 1.5, 1.7, 2.0)
SPLIT_QUANTILES = (0.25, 0.50, 0.75, 0.90, 0.95, 0.99)

# Two-sided normal quantiles for the usual confidence levels.
Z_VALUES = {0.80: 1.2815515655446004, 0.90: 1.6448536269514722,
            0.95: 1.959963984540054, 0.99: 2.5758293035489004}
