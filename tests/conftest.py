import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TESTDATA = "/root/testdata"


def sf_dir(sf: str) -> str:
    return f"{TESTDATA}/sf{sf}"


@pytest.fixture(scope="session")
def spark():
    from shelfwise.session import build_session
    s = build_session(master="local[8]", shuffle_partitions=8,
                      extra={"spark.driver.memory": "6g"})
    yield s
    s.stop()
