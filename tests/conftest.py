import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]").appName("ratebook-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", str(shared)).config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def scored_frame(spark):
    """A small scored table from (y_true, price) pairs."""

    def make(*pairs):
        rows = [(i, float(y), float(p)) for i, (y, p) in enumerate(pairs)]
        return spark.createDataFrame(rows, "policy_id long, y_true double, price double")

    return make


@pytest.fixture
def policy_frame(spark):
    """Policies from dicts; what a dict leaves out takes an ordinary value."""

    def make(*records):
        rows = []
        for i, r in enumerate(records):
            base = dict(policy_id=i, age=40, sex="male", bmi=27.0, children=1, smoker="no", region="northeast", charges=9000.0)
            base.update(r)
            rows.append(tuple(base[k] for k in ("policy_id", "age", "sex", "bmi", "children", "smoker", "region", "charges")))
        return spark.createDataFrame(
            rows, "policy_id long, age int, sex string, bmi double, children int, smoker string, region string, charges double")

    return make
