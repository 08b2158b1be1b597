import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"
DATA = os.path.join(ROOT, "tests", "data")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from hourglass.session import local_session

    s = local_session(8)
    # tests only: the checkpoint folder is unset locally, so give it a scratch one
    if not s.conf.get("spark.checkpoint.dir", None):
        d = str(tmp_path_factory.mktemp("ckpt"))
        s.sparkContext.setCheckpointDir(d)
    yield s
    s.stop()
