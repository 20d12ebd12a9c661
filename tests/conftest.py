import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loomspark.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    return ship_package(local_session("4", 4, "3g"))
