import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from riskledger.session import get_session

    SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    s = get_session("tests", "local[8]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
