import os

import pytest

from siteweave.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYTHONHASHSEED", "0")
    s = session(
        "tests",
        "local[4]",
        **{
            "spark__sql__shuffle__partitions": "4",
            "spark__ui__enabled": "false",
            "spark__driver__memory": "4g",
            "spark__checkpoint__dir": str(tmp_path_factory.mktemp("shared")),
            "spark__sql__warehouse__dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
