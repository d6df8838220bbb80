import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from farepanel.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "tests", "4g")


@pytest.fixture(scope="session")
def panel(spark):
    from farepanel.sources.panel import Panel

    return Panel(spark, SF)
