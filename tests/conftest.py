from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tallywright.session import local_session

    return local_session("8", "tests")


@pytest.fixture(scope="session")
def fixtures():
    return os.path.join(ROOT, "tests", "fixtures")


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
