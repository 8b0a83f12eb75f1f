import pytest
from pyspark.sql import functions as F

from ratebook.functions import checks, features as fx
from ratebook.operators import validation as v

RAW = "policy_id long, age string, sex string, bmi string, children string, smoker string, region string"


@pytest.fixture
def raw(spark):
    def make(*rows):
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RAW)

    return make


GOOD = ("40", " MALE ", "27.5", "2", "Yes", "NorthEast")


def errors(df):
    return [r["e"] for r in v.checked(df).orderBy("policy_id").select(F.concat_ws("|", "errors").alias("e")).collect()]


def test_codes_and_bounds(raw):
    df = raw(
        GOOD, ("18", "male", "10", "0", "no", "southwest"), ("120", "male", "100", "20", "no", "southwest"),
        ("17", "male", "9.99", "-1", "no", "southwest"), ("abc", "x", None, "21", "maybe", "north"),
        ("25.7", "male", "27", "2.9", "no", "southwest"), ("25.0", "male", "27", "2.0", "no", "southwest"))
    assert errors(df) == [
        "", "", "", "age_out_of_range|bmi_out_of_range|children_out_of_range",
        "age_not_numeric|sex_unknown|bmi_missing|children_out_of_range|smoker_unknown|region_unknown",
        "age_not_integer|children_not_integer", ""]


def test_split_keeps_every_row_once(raw):
    df = raw(GOOD, ("abc", *GOOD[1:]))
    good, bad = v.split_valid(df)
    assert good.collect()[0].asDict() == {
        "policy_id": 0, "age": 40, "sex": "male", "bmi": 27.5, "children": 2, "smoker": "yes", "region": "northeast"}
    assert [r["policy_id"] for r in bad.collect()] == [1]


def test_all_invalid_and_empty(raw, spark):
    good, bad = v.split_valid(raw(("x",) * 6))
    assert good.isEmpty() and bad.count() == 1
    good, bad = v.split_valid(spark.createDataFrame([], RAW))
    assert good.isEmpty() and bad.isEmpty()


def test_strict_mode_names_rows(raw):
    assert v.require_valid(raw(GOOD)).count() == 1
    with pytest.raises(ValueError, match=r"1 \(age_not_numeric\)"):
        v.require_valid(raw(GOOD, ("abc", *GOOD[1:])))


def test_missing_column(raw):
    with pytest.raises(ValueError, match="bmi"):
        v.split_valid(raw(GOOD).drop("bmi"))


def test_duplicates_keep_the_first_key(policy_frame):
    df = policy_frame({"policy_id": 9}, {"policy_id": 3}, {"policy_id": 5, "age": 41})
    assert sorted(r["policy_id"] for r in v.without_duplicates(df).collect()) == [3, 5]


def test_cleaning_fails_on_nothing_left(policy_frame):
    with pytest.raises(ValueError):
        v.cleaned(policy_frame({"bmi": None}))


def test_defaults_are_listed_only_when_absent(raw):
    rows = v.filled(raw(("", None, "oops", "3.7", "no", "southeast"))).collect()[0]
    assert rows["imputed_fields"] == "age,sex"
    assert (rows["age"], rows["sex"], rows["bmi"], rows["children"]) == (30, "male", 25.0, 3)


@pytest.mark.parametrize("cell,unsafe", [
    ("=SUM(A1)", True), ("-5", False), ("+1.5e3", False), ("-x", True), ("  @home", True), ("run PowerShell", True),
    ("a|calc", True), ("plain", False), ("", False), ("   ", False), (None, False), ("address", False), ("add exec(1)", True), ("odder", True), ("dde link", True)])
def test_formula_cells(spark, cell, unsafe):
    """Patterns are plain substrings: "odder" holds one."""
    df = spark.createDataFrame([(cell,)], "note string")
    assert df.select(checks.unsafe_cell("note")).first()[0] is unsafe


def test_unsafe_header_flags_all_rows(spark):
    df = spark.createDataFrame([(1, "a")], "policy_id long, `=x` string")
    assert v.unsafe_cells(df).first()["columns"] == "<header>"


@pytest.mark.parametrize("h,w,bmi,error", [
    (180.0, 80.0, 24.7, None), (49.0, 80.0, None, "height_out_of_range"), (180.0, 301.0, None, "weight_out_of_range"),
    (250.0, 20.0, None, "bmi_out_of_range"), (0.0, 80.0, None, "not_positive"), (None, 80.0, None, "not_a_number")])
def test_bmi_from_measures(spark, h, w, bmi, error):
    df = spark.createDataFrame([(h, w)], "h double, w double")
    assert tuple(df.select(*checks.bmi_from_measures("h", "w")).first()) == (bmi, error)


@pytest.mark.parametrize("bmi,category,label,severity", [
    (18.5, "underweight", "Normal", 1), (18.51, "normal", "Normal", 2), (25.0, "normal", "Overweight", 2),
    (30.0, "overweight", "Obese", 4), (35.0, "obese_1", "Obese", 7), (35.01, "obese_2", "Obese", 11), (100.0, "obese_2", "Obese", 16),
    (100.5, "obese_2", "Obese", None)])
def test_bmi_edges(policy_frame, bmi, category, label, severity):
    row = policy_frame({"bmi": bmi}).select(
        fx.bands()["bmi_category"].alias("c"), fx.display_bmi().alias("d"), fx.severity()["bmi_severity_score"].alias("s")).first()
    assert tuple(row) == (category, label, severity)


def test_age_over_hundred_has_no_tier(policy_frame):
    assert policy_frame({"age": 101}).select(fx.severity()["age_risk_tier"]).first()[0] is None
