from __future__ import annotations

import os

import pytest

from oddlines.session import local_session

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=os.environ.get("TEST_CPUS", "8"), partitions=4, memory="6g")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables here")
    return SF_DIR
