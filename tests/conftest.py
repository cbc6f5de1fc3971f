import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from waymark.runtime import local_session

    # tables are tiny here: interpreting plans is faster than compiling them
    s = local_session(4, spark__sql__shuffle__partitions="2", spark__sql__codegen__wholeStage="false", spark__sql__codegen__factoryMode="NO_CODEGEN")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
