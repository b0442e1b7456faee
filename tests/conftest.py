import pytest

from tests.harness import DATA, duck, session


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def con(small):
    return duck(small)
