import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from signaldeck.session import local_session

    session = local_session(cpus=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    return session
