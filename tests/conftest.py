import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

import pytest  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from sparkloom.session import local_session

    return local_session(4, memory="3g", shuffle_partitions=4)


@pytest.fixture(scope="session")
def folder():
    return DATA
