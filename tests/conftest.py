import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import standins  # noqa: E402
from pyspark import cloudpickle  # noqa: E402

from citegraph.session import local_session, ship  # noqa: E402

# Back ends for tests travel to the workers by value.
cloudpickle.register_pickle_by_value(standins)


@pytest.fixture(scope="session")
def spark():
    return ship(local_session(4, "citegraph-tests", **{"spark.sql.shuffle.partitions": "4"}))
