import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parent.parent)]

from looseleaf.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build("local[8]", **{"spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
