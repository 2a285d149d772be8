import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

TABLES_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from banterscope.session import local_session

    session = local_session(4, shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables():
    if not Path(TABLES_DIR).exists():
        pytest.skip("the given tables are not here")
    return TABLES_DIR
