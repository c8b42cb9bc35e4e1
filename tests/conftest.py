import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gradelattice.operators.context import Context  # noqa: E402
from gradelattice.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", shuffle_partitions=4)


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, scale=10):
        rows = np.asarray(rows).astype(int).tolist()
        frame = spark.createDataFrame(list(enumerate(rows)), "obj bigint, grades array<int>")
        return Context(frame, len(rows[0]), scale)
    return build
