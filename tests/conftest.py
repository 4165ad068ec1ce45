import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from skarn.session import spark_session

    s = spark_session(4, 4, "tests", **{"spark.driver.memory": "3g", "spark.sql.autoBroadcastJoinThreshold": "1m"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture()
def workspace(spark, tmp_path):
    from skarn.session import Workspace

    ws = Workspace(spark, str(tmp_path / "ws"))
    yield ws
    ws.close()


@pytest.fixture(scope="session")
def sf():
    return SF
