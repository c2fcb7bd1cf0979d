import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from studycorpus import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session.build("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                              "spark.ui.showConsoleProgress": "false",
                                              "spark.studycorpus.spread": "8",
                                              "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    s.sparkContext.setLogLevel("ERROR")
    from bindings.base import ship
    ship(s)
    yield s
    s.stop()
