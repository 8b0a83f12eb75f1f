"""A learning curve is judged with one scan a fraction, whatever the number of folds."""

from pyspark.sql import functions as F

from ratebook.operators import learners


def test_one_scan_a_fraction(spark):
    rows = spark.range(300).select(F.col("id").alias("policy_id"), (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") * 2.0 + 1).alias("label"), *[
        ((F.col("id") * (i + 3)) % (7 + 2 * i)).cast("double").alias(c) for i, c in enumerate(learners.INPUTS)])
    out = learners.learning_curve(rows, "linear", fractions=(0.5, 1.0), folds=3)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 300") == 2
    got = {(r.fraction, r.part): r.n for r in out.collect()}
    assert got[1.0, "val"] == got[0.5, "val"] == 300 and got[1.0, "train"] == 600 and got[0.5, "train"] == 300
