import os

import pytest

os.environ.setdefault("PYSPARK_DRIVER_PYTHON", "python")


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local

    session = local(8, 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
