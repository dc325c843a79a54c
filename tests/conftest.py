import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.runtime import release, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session("tests", cores=4, memory="4g", spark__sql__shuffle__partitions="4")
    found.sparkContext.setLogLevel("ERROR")
    yield found
    release()
    found.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"
