import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quillwave.session import build_session

    session = build_session("tests", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__default__parallelism="8")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
