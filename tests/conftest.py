import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from abacora.session import build

    home = tempfile.mkdtemp(prefix="abacora-test-")
    s = build("tests", "local[4]", 4, "4g", **{"spark__ui__enabled": "false", "spark__ui__showConsoleProgress": "false", "spark__sql__warehouse__dir": f"{home}/warehouse", "spark__checkpoint__dir": f"file://{home}/shared"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA
