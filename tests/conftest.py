import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from terrastrat.session import local_session

    session = local_session("4", 4, spark__sql__execution__arrow__maxRecordsPerBatch="64")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
