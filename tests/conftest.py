import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from scrubjay.session import local_session

    session = local_session(4, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not SF.is_dir():
        pytest.skip("no test tables")
    return str(SF)
