"""Tables as they lie on a cluster: headers in any order, folders of part files, unknown values."""

import math

import pytest
from pyspark.sql import functions as F

from ratebook.operators import transforms
from ratebook.sources import files
from ratebook.streaming import monitors


def test_csv_columns_go_by_their_names(policy_frame, tmp_path, spark):
    df = policy_frame(dict(age=31, children=2), dict(age=44, children=0))
    shuffled = df.select("charges", "children", "region", "sex", F.lit("x").alias("note"), "bmi", "age", "smoker", "policy_id")
    shuffled.write.option("header", True).csv(str(tmp_path / "p"))
    got = files.read_policies(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, got.select(df.columns).collect())) == sorted(map(tuple, df.collect())) and "note" not in got.columns
    shuffled.drop("age").write.option("header", True).csv(str(tmp_path / "q"))
    with pytest.raises(Exception, match="age"):
        files.read_policies(spark, str(tmp_path / "q"))


def test_streams_read_folders_of_part_files(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for folder in (data, str(tmp_path)):
        query = monitors.stream_table(spark, folder, "events").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table("seen").count() == events.count()


def test_correlations_leave_out_only_their_own_unknown_values(spark):
    rows = [(1.0, 2.0, None), (2.0, 1.0, 3.0), (3.0, 4.0, float("nan")), (4.0, 3.0, 1.0), (5.0, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.a, r.b): r.correlation for r in transforms.correlations(df, ["a", "b", "c"]).collect()}
    want = df.select(F.corr("a", "b")).first()[0]
    assert math.isclose(got["a", "b"], want) and math.isclose(want, -0.2) and got["a", "c"] is not None
    for a, b in (("a", "c"), ("b", "c")):
        sound = df.where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND NOT isnan({b})")
        assert math.isclose(got[a, b], sound.select(F.corr(a, b)).first()[0])
    big = spark.range(500).selectExpr("id AS policy_id", "1e9 + id AS x", "CASE WHEN id % 7 > 0 THEN 3e9 - 2 * id END AS y", "id * 7919 % 101 AS w", "5 AS flat")
    fit = transforms.CollinearityFilter.fit(big)
    assert fit.correlation_drops == ("y",) or fit.correlation_drops == ("x",)
    pairs = [r.correlation for r in transforms.correlations(big, ["x", "y", "flat"]).collect()]
    assert math.isclose(pairs[0], -1.0) and pairs[1:] == [None, None]


def test_drift_of_more_categories_than_columns_could_hold(spark):
    old = spark.range(6000).selectExpr("concat('k', id % 3000) AS event_type", "CAST(id AS double) AS value")
    new = spark.range(3000).selectExpr("timestamp'2024-01-01 05:00:00' AS ts", "CASE WHEN id < 1500 THEN concat('k', id) WHEN id < 2000 THEN 'new' END AS event_type", "3000.0D AS value")
    counts = monitors.windowed_counts(new)  # the same plan on a table
    got = monitors.drift_figures(counts, monitors.event_baseline(old)).first()
    want = 0.5 * (1500 * abs(1 / 3000 - 1 / 3000) + 500 / 3000 + 1000 / 3000 + 1500 / 3000)
    assert got["n"] == 3000 and math.isclose(got["tvd"], want) and got["mix_drifted"] and math.isclose(got["new_mean"], 3000.0)
