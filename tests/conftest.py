from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("CORPUSLOOM_DRIVER_MEMORY", "4g")


@pytest.fixture(scope="session")
def spark():
    from corpusloom.session import build_session

    s = build_session(4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
