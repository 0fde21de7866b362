import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    import __spark_entry__ as contract
    from flowloom.session import local_session

    session = local_session(8, partitions=8)
    contract._ready(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
