"""Row checks of policy records as column expressions.

One builder makes every check, so that validation, strict mode, the feature range
screen and streaming quarantine cannot drift apart.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratebook.config import RECORD_DEFAULTS, REGIONS, SEXES, SMOKER_VALUES, Bounds
from ratebook.functions.columns import col


def normal(c) -> Column:
    return F.lower(F.trim(col(c)))


def as_number(c) -> Column:
    return F.trim(col(c).cast("string")).try_cast("double")


def as_int(c) -> Column:
    """Integer part of a number written in any way; null when it is not a number."""
    return as_number(c).try_cast("int")


def _unless(ok: Column, code: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.lit(code))


def _number_check(name: str, low, high, whole: bool = False) -> list[Column]:
    x = as_number(name)
    checks = [
        F.when(col(name).isNull(), F.lit(f"{name}_missing")).when(x.isNull(), F.lit(f"{name}_not_numeric")),
        F.when((x < low) | (x > high) | F.isnan(x), F.lit(f"{name}_out_of_range")),
    ]
    return checks + ([F.when(x != F.rint(x), F.lit(f"{name}_not_integer"))] if whole else [])


def record_errors(bounds: Bounds | None = None) -> Column:
    """Array of the codes of everything wrong with a record, in column order."""
    b = bounds or Bounds()
    checks = [
        *_number_check("age", b.age_min, b.age_max, whole=True),
        _unless(normal("sex").isin(*SEXES), "sex_unknown"),
        *_number_check("bmi", b.bmi_min, b.bmi_max),
        *_number_check("children", b.children_min, b.children_max, whole=True),
        _unless(normal("smoker").isin(*SMOKER_VALUES), "smoker_unknown"),
        _unless(normal("region").isin(*REGIONS), "region_unknown"),
    ]
    return F.array_compact(F.array(*checks))


def in_feature_range(bounds: Bounds | None = None) -> Column:
    """Closed range screen of typed records before features are built."""
    b = bounds or Bounds()
    test = (
        F.col("bmi").between(b.bmi_min, b.bmi_max)
        & F.col("age").between(b.age_min, b.age_max)
        & normal("smoker").isin(*SMOKER_VALUES))
    return F.coalesce(test, F.lit(False))


def filled_record() -> dict[str, Column]:
    """Every field converted, with its default where it is missing or unreadable."""
    out = {}
    for name, default in RECORD_DEFAULTS.items():
        if isinstance(default, str):
            out[name] = F.coalesce(normal(name), F.lit(default))
        elif isinstance(default, float):
            out[name] = F.coalesce(as_number(name), F.lit(default))
        else:
            out[name] = F.coalesce(as_int(name), F.lit(default))
    return out


def imputed_fields() -> Column:
    """Names of the fields that were absent or blank."""
    return F.concat_ws(",", *[
        F.when(col(name).isNull() | (F.trim(col(name).cast("string")) == ""), F.lit(name))
        for name in RECORD_DEFAULTS])


# What marks a spreadsheet formula or a command.
FORMULA_STARTS = r"=+\-@\t\r\n|#%~^"
COMMAND_PATTERNS = (
    "cmd|", "powershell", "system(", "exec(", "eval(", "@sum", "@if", "@cmd", "dde", "|calc", "|cmd",
)


def unsafe_cell(c) -> Column:
    """A text cell that a spreadsheet could run."""
    raw = col(c)
    # The marks look at the text as it is, once each; only marked cells are trimmed and tried as a number.
    starts = raw.rlike(rf"^\s*+[{FORMULA_STARTS}]")
    holds = F.lower(raw).rlike("|".join(re.escape(p) for p in COMMAND_PATTERNS))
    number = F.regexp_replace(raw, r"^\s+|\s+$", "").try_cast("double")
    suspicious = F.when(starts | holds, number.isNull())
    return F.coalesce(suspicious, F.lit(False))


def unsafe_header(name: str) -> bool:
    return name.strip()[:1] in set("=+-@|#%~^") and bool(name.strip())


def bmi_from_measures(height_cm, weight_kg) -> tuple[Column, Column]:
    """(bmi to one decimal, error): exactly one of the two is null."""
    h, w = col(height_cm), col(weight_kg)
    value = F.bround(F.try_divide(w, (h / 100.0) * (h / 100.0)), 1)
    error = (
        F.when(h.isNull() | w.isNull(), "not_a_number")
        .when((h <= 0) | (w <= 0), "not_positive")
        .when(~h.between(50, 250), "height_out_of_range")
        .when(~w.between(20, 300), "weight_out_of_range")
        .when(~value.between(10, 60), "bmi_out_of_range"))
    return F.when(error.isNull(), value), error


def advisories() -> Column:
    notes = F.array(
        F.when(F.col("age") > 65, "senior_premium"),
        F.when(F.col("bmi") > 30, "obesity_range"),
        F.when(F.col("children") > 3, "large_family"))
    return F.filter(notes, lambda x: x.isNotNull())


def fingerprint() -> Column:
    """Twelve hex digits of a digest over the canonical record."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(normal(F.col(c).cast("string")), F.lit("")))
             for c in sorted(RECORD_DEFAULTS)]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)
