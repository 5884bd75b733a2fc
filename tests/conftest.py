import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from larder.session import build_session
    scratch = tempfile.mkdtemp(prefix="larder-test-")
    s = build_session("local[4]", 4, app="larder-tests", extra={
        "spark.local.dir": scratch, "spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    yield s
    s.stop()


@pytest.fixture()
def scratch_dir():
    return tempfile.mkdtemp(prefix="larder-case-")


SF = "/root/testdata/sf0.001"
