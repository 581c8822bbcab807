import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tests.session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = make_session()
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield session
    session.stop()
