import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMOKE = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from rollcall.session import local_session, shared_dir

    session = local_session(cores=4, shuffle_partitions=8, app="rollcall-tests")
    # tests set their own shared folder only when the session names none
    if not session.sparkContext.getCheckpointDir():
        configured = session.sparkContext.getConf().get("spark.checkpoint.dir", None)
        session.sparkContext.setCheckpointDir(configured or tempfile.mkdtemp(prefix="rollcall-tests-"))
    shared_dir(session)
    yield session


@pytest.fixture()
def scratch(tmp_path):
    return str(tmp_path)
