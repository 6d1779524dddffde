import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from caseflow.session import build_session

    # The session keeps any spark.checkpoint.dir it is given; when none is set,
    # caseflow.session.checkpoint_dir falls back to a private folder (local mode only).
    s = build_session(master="local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def smoke_dir():
    return SMOKE
