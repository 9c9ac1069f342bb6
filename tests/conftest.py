import datetime as dt
import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from resgov.session import build_session, shared_dir  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    # the shared folder comes from the session (spark.checkpoint.dir); a private
    # one is created by shared_dir() only when the environment sets none
    s = build_session("local[4]", 4, app_name="resgov-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def run_dir(spark):
    """A fresh folder under the shared checkpoint folder for this test run."""
    return shared_dir(spark, f"resgov-tests-{uuid.uuid4().hex[:12]}")


def ts(text):
    return dt.datetime.fromisoformat(text)
