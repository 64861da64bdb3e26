import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark():
    import compare

    return compare.session()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
