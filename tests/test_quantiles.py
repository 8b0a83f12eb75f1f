import numpy as np
import pandas as pd
import pytest

from ratebook.operators import quantiles as q

PROBS = [0, 0.01, 0.25, 0.3, 0.5, 0.9, 0.999, 1]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.full(3000, 5.0), rng.lognormal(3, 2, 4000), rng.normal(0, 1e-6, 1500), -rng.lognormal(1, 4, 1500)])
    g = np.where(rng.random(len(v)) < 0.5, 0, rng.integers(0, 3, len(v)))
    pdf = pd.DataFrame({"g": [None if x == 2 else f"g{x}" for x in g], "v": v})
    return pdf, spark.createDataFrame(pdf).cache()


@pytest.mark.parametrize("limit", [500_000, 50, 1])
def test_exact_whatever_the_bracket_limit(skewed, monkeypatch, limit):
    """A third of the rows share one value, and one group holds two thirds."""
    monkeypatch.setattr(q, "SMALL_BRACKET", limit)
    monkeypatch.setattr(q, "SLICES", 16)
    pdf, df = skewed
    assert np.allclose(q.exact_quantiles(df, "v", PROBS)[()], np.quantile(pdf.v, PROBS), rtol=1e-13, atol=0)
    got = q.exact_quantiles(df, "v", PROBS, ["g"])
    for k in ("g0", "g1", None):
        part = pdf[pdf.g.isna() if k is None else pdf.g == k]
        assert np.allclose(got[(k,)], np.quantile(part.v, PROBS), rtol=1e-13, atol=0)


@pytest.mark.parametrize("literal", [0, 32])
def test_brackets_as_literals_or_joined(skewed, monkeypatch, literal):
    monkeypatch.setattr(q, "SMALL_BRACKET", 50)
    monkeypatch.setattr(q, "LITERAL_RANKS", literal)
    pdf, df = skewed
    got = q.exact_quantiles(df, "v", PROBS, ["g"])
    for k in ("g0", "g1", None):
        part = pdf[pdf.g.isna() if k is None else pdf.g == k]
        assert np.allclose(got[(k,)], np.quantile(part.v, PROBS), rtol=1e-13, atol=0)


def test_ranks_planned_over_all_groups(skewed):
    """The rank in one group hangs on the size of another, and a group may be left out."""
    pdf, df = skewed
    sizes = pdf.groupby("g", dropna=False).size()
    found = q.planned_order_statistics(df, "v", lambda n: {("g0",): [n["g1",]], ("g1",): []}, ["g"])
    values = np.sort(pdf.v[pdf.g == "g0"])
    assert found["g0",] == (sizes["g0"], {int(sizes["g1"]): values[sizes["g1"] - 1]})
    assert found["g1",][1] == {} and found[None,][1] == {}


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "v double")
    assert q.quantiles(empty, "v", [0.5]) == [None]
    one = spark.createDataFrame([(3.0,), (None,)], "v double")
    assert q.quantiles(one, "v", [0.1, 0.9]) == [3.0, 3.0]


@pytest.mark.parametrize("limit", [500_000, 1])
def test_long_values_keep_every_digit(spark, monkeypatch, limit):
    monkeypatch.setattr(q, "SMALL_BRACKET", limit)
    big = 2**60
    df = spark.createDataFrame([(big + i,) for i in range(10)] + [(-(2**63),), (2**63 - 1,)], "v long")
    n, found = q.order_statistics(df, "v", lambda n: [1, 3, 11, 12])[()]
    assert n == 12 and found == {1: -(2**63), 3: big + 1, 11: big + 9, 12: 2**63 - 1}


def test_extreme_doubles(spark, monkeypatch):
    monkeypatch.setattr(q, "SMALL_BRACKET", 1)
    values = [-1.7e308, -5e-324, 0.0, 5e-324, 1.0, 1.7e308]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    n, found = q.order_statistics(df, "v", lambda n: range(1, n + 1))[()]
    assert [found[k] for k in range(1, 7)] == values
    with pytest.raises(ValueError):
        q.quantiles(spark.createDataFrame([(1.0,), (float("inf"),)], "v double"), "v", [0.5])
