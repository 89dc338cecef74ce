import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from termspark.session import local_session
    s = local_session(4, 4, app="termspark-tests", driver_memory="4g",
                      checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_run(tmp_path):
    return str(tmp_path)
