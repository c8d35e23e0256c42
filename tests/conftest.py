import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("REGIONLAB_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from regionlab.session import get_spark

    s = get_spark("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def tiny():
    """The folder of the smallest tables."""
    d = f"{DATA}/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    return d
