import os
import sys
import tempfile
from datetime import date

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rolewright-test-"))
    return s


@pytest.fixture(scope="session")
def skills(spark):
    from rolewright.functions import vocab as V

    return V.starter_skills(spark).cache()


@pytest.fixture(scope="session")
def aliases(skills):
    from rolewright.cluster import cut_lineage
    from rolewright.functions import vocab as V

    return cut_lineage(V.alias_table(skills))


@pytest.fixture(scope="session")
def run(spark, skills):
    import samples
    from rolewright.plans.match import Settings, run_match
    from rolewright.schemas import POSTING

    cvs = spark.createDataFrame(samples.cv_rows(), "cv_id string, text string")
    jobs = spark.createDataFrame(samples.posting_rows(), POSTING)
    prefs = spark.createDataFrame([("backend", "Berlin")], "cv_id string, location string")
    return run_match(cvs, jobs, skills, Settings(as_of=date(2025, 3, 1)), prefs=prefs)
