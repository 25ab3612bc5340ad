import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from rdfloom.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    out = session("local[4]", 4, spark__ui__showConsoleProgress="false", spark__sql__session__timeZone="UTC")
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()
