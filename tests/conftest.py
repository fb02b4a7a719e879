import pytest

from leasebook import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("leasebook-tests", cpus=4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    return session
