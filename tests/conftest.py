import pytest

from lexigrain.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("lexigrain-tests", cpus=4, shuffle=4)
