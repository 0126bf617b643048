import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillstream.session import build_session

    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = build_session("local[4]", 4, spark__sql__warehouse__dir=warehouse, spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
