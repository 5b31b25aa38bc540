import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from plumbline.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("4", 4, "4g")
    s.sparkContext.setLogLevel("ERROR")
    return s
