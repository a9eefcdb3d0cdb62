import os
import tempfile

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[8]")).appName("tempora-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
         .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-"))
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return s


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF
