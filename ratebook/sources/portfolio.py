"""Policy tables derived from the warehouse tables.

A policy is a customer: age, body mass index and smoking follow from the key and
the market segment, the number of children from the number of orders, the region
from the nation. Orders are counted per customer before the join, so the join sees
one row per key; the nation table joins by whatever strategy its size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratebook.functions.columns import above
from ratebook.functions.pricing import actuarial_premium, blend

POLICY_SCHEMA = T.StructType([
    T.StructField("policy_id", T.LongType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("sex", T.StringType()),
    T.StructField("bmi", T.DoubleType()),
    T.StructField("children", T.IntegerType()),
    T.StructField("smoker", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("charges", T.DoubleType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def policies_from(customer: DataFrame, orders: DataFrame, nation: DataFrame) -> DataFrame:
    per_customer = orders.groupBy(F.col("o_custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    key = F.col("c_custkey")
    region = F.col("n_regionkey") % 4
    base = (
        customer.join(per_customer, F.col("o_custkey") == key, "left")
        .join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
        .select(
            key.alias("policy_id"),
            (18 + (key * 37) % 63).cast("int").alias("age"),
            F.when(key % 2 == 0, "male").otherwise("female").alias("sex"),
            (F.lit(16.0) + ((key * 7919) % 3100) / F.lit(100.0)).alias("bmi"),
            (F.coalesce("n_orders", F.lit(0)) % 6).cast("int").alias("children"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "yes").otherwise("no").alias("smoker"),
            F.when(region == 0, "northeast").when(region == 1, "northwest")
            .when(region == 2, "southeast").otherwise("southwest").alias("region"),
            "c_acctbal",
        )
    )
    risk = F.lit(1500.0) + F.lit(95.0) * F.col("age") + F.lit(60.0) * above(F.col("bmi"), 25.0) \
        + F.lit(400.0) * F.col("children")
    loaded = risk * F.when(F.col("smoker") == "yes", 3.4).otherwise(1.0) + F.lit(0.12) * F.col("c_acctbal")
    return base.select(
        "policy_id", "age", "sex", "bmi", "children", "smoker", "region",
        F.greatest(F.lit(1121.0), loaded).alias("charges"))


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies_from(
        table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "nation"))


def with_ml_prediction(df: DataFrame) -> DataFrame:
    """A learned model's stand-in: charges scaled by a key-dependent error of -30% to +30%."""
    return df.withColumn(
        "ml_pred", F.col("charges") * (F.lit(0.70) + ((F.col("policy_id") * 13) % 61) / F.lit(100.0)))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies with the learned, actuarial and blended premium."""
    df = with_ml_prediction(policies(spark, sf_dir)).withColumn("act_pred", actuarial_premium())
    return df.withColumn("hybrid_pred", blend("ml_pred", "act_pred").final)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return priced(spark, sf_dir).select(
        "policy_id", F.col("charges").alias("y_true"), "ml_pred", "act_pred", "hybrid_pred")


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies as text with typical defects: the input of validation."""
    return raw_from(policies(spark, sf_dir))


def raw_from(p: DataFrame) -> DataFrame:
    key = F.col("policy_id")

    def defect(column: str, modulus: int, bad):
        return F.when(key % modulus == 0, F.lit(bad)).otherwise(F.col(column).cast("string")).alias(column)

    age = F.when(key % 29 == 0, "abc").when(key % 41 == 0, "130").when(key % 47 == 0, "25.7").otherwise(F.col("age").cast("string"))
    return p.select(
        "policy_id",
        age.alias("age"),
        defect("sex", 31, " MALE "),
        F.when(key % 23 == 0, F.lit(None)).otherwise(
            F.format_string("%.2f", "bmi")).alias("bmi"),
        F.when(key % 43 == 0, "21").when(key % 53 == 0, "2.9").otherwise(F.col("children").cast("string")).alias("children"),
        "smoker",
        defect("region", 37, "north"),
    )


def duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies in which every smoker's record was delivered twice under a later key."""
    p = policies(spark, sf_dir)
    again = p.where(F.col("smoker") == "yes").withColumn("policy_id", F.col("policy_id") + 1000000000000)
    return p.unionByName(again)


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies with a free-text note, some of which try to inject spreadsheet formulas."""
    kind = F.col("policy_id") % 11
    note = (
        F.when(kind == 0, "=SUM(A1)").when(kind == 1, "-5").when(kind == 2, "cmd|calc")
        .when(kind == 3, " @home").when(kind == 4, "Use PowerShell now").when(kind == 5, "  ")
        .when(kind == 6, F.lit(None)).otherwise("renewal"))
    return policies(spark, sf_dir).withColumn("note", note)


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests: one event each, its value read as a latency; sign-ups stand for
    requests turned away before they were scored."""
    return requests_from(table(spark, sf_dir, "events"))


def requests_from(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "ts", "event_type", F.col("value").alias("latency"),
        (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "signup").alias("rejected"))


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later, drifted delivery: everyone three years older, many moved south-east."""
    return policies(spark, sf_dir).select(
        "policy_id", (F.col("age") + 3).cast("int").alias("age"), "sex", "bmi", "children", "smoker",
        F.when(F.col("policy_id") % 4 == 0, "southeast").otherwise(F.col("region")).alias("region"),
        "charges")
