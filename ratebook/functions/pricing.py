"""Premium formulas: actuarial base, blend with a learned premium, routing, bias factors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratebook.config import HIGH_VALUE, Actuarial, Blend
from ratebook.functions.columns import above, clip, col, lookup


def is_smoker(smoker="smoker") -> Column:
    return F.lower(F.trim(col(smoker))).isin("yes", "1", "true")


def actuarial_premium(
    age="age", bmi="bmi", children="children", smoker="smoker", region="region",
    rates: Actuarial | None = None,
) -> Column:
    r = rates or Actuarial()
    age, bmi, children = (col(c) for c in (age, bmi, children))
    excess = above(bmi, r.bmi_threshold)
    plain = (
        F.lit(r.base) + age * F.lit(r.age_coefficient) + excess * F.lit(r.bmi_penalty)
        + children * F.lit(r.children_cost))
    smoking = (plain + excess * age * F.lit(r.smoker_bmi_age)) * F.lit(r.smoker_multiplier)
    factor = lookup(F.lower(F.trim(col(region))), r.regions, 1.0)
    return F.when(is_smoker(smoker), smoking).otherwise(plain) * factor


@dataclass(frozen=True)
class Blended:
    zone: Column
    weight: Column
    final: Column


def blend(ml="ml_pred", act="act_pred", rule: Blend | None = None, **override) -> Blended:
    """Weight the learned against the actuarial premium.

    The learned premium alone counts when the mean of both reaches the threshold.
    Below that the actuarial premium decides: far below, a fixed share; inside the
    window, a share that rises linearly. As the two tests look at different signals
    the weight may leave [0, 1]; ``clamp_weight`` stops that. Parameters may be
    columns, so that a whole grid of rules can be priced in one pass.
    """
    rule = rule or Blend()
    p = {k: override.get(k, getattr(rule, k)) for k in ("threshold", "ml_ratio", "window", "cap", "floor")}
    threshold, ratio, cap, floor = (_value(p[k]) for k in ("threshold", "ml_ratio", "cap", "floor"))
    ml, act = col(ml), col(act)
    learned = ml * F.lit(0.5) + act * F.lit(0.5) >= threshold
    if p["window"] is None:
        zone = F.when(learned, "ml_only").otherwise("below")
        weight = F.when(learned, F.lit(1.0)).otherwise(ratio)
    else:
        window = _value(p["window"])
        start = threshold - window
        zone = F.when(learned, "ml_only").when(act <= start, "actuarial_dominant").otherwise("transition")
        rising = ratio + (F.lit(1.0) - ratio) * ((act - start) / window)
        weight = F.when(learned, F.lit(1.0)).when(act <= start, ratio).otherwise(rising)
    if rule.clamp_weight:
        weight = clip(weight, 0.0, 1.0)
    mixed = weight * ml + (F.lit(1.0) - weight) * act
    return Blended(zone, weight, F.greatest(F.least(mixed, ml * cap), ml * floor))


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def hybrid(ml="ml_pred", act="act_pred", rule: Blend | None = None) -> Column:
    """Blend with the calibration factor on the learned part only or on the result."""
    rule = rule or Blend()
    if rule.factor_on_ml_only:
        return blend(col(ml) * F.lit(rule.factor), act, rule).final
    return blend(ml, act, rule).final * F.lit(rule.factor)


def loaded_premium(base="base", risk="risk", loading: float = 0.10) -> Column:
    """The dearer of the loaded base premium and the risk premium."""
    return F.greatest(col(base) * F.lit(1.0 + loading), col(risk))


def router_weight(base, threshold: float = HIGH_VALUE, low: float = 1.08, high: float = 1.299) -> Column:
    """Share of the specialist in a routed premium: 0 below, 1 above, linear between."""
    start, stop = threshold * low, threshold * high
    return clip((col(base) - F.lit(start)) / F.lit(stop - start), 0.0, 1.0)


def mix(base, specialist, weight: Column) -> Column:
    return F.when(weight <= 0, col(base)).when(weight >= 1, col(specialist)).otherwise(
        (F.lit(1.0) - weight) * col(base) + weight * col(specialist))


def smoker_lift(base, high_mid, smoker="smoker", limit: float = 10000.0, share: float = 0.65) -> Column:
    base = col(base)
    lifted = F.lit(share) * base + F.lit(1.0 - share) * col(high_mid)
    return F.when(is_smoker(smoker) & (base < F.lit(limit)), lifted).otherwise(base)


def bias_factor(
    prediction, variances: dict[str, float], low: float, high: float | None = None, closed: bool = False
) -> Column:
    """Tier factor e^(variance/2). ``closed`` puts a boundary value into the lower tier."""
    x = col(prediction)

    def below(edge: float) -> Column:
        return x <= F.lit(edge) if closed else x < F.lit(edge)

    def factor(name: str) -> Column:
        return F.exp(F.lit(variances[name] / 2.0))

    if high is None:
        return F.when(below(low), factor("low")).otherwise(factor("high"))
    return F.when(below(low), factor("low")).when(below(high), factor("mid")).otherwise(factor("high"))
