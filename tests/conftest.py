import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from oosgauge.session import local_session

    s = local_session(8, "tests")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame ``id, features, proj, label`` from matrices."""

    def build(x, p=None, labels=None, first=0):
        x = np.asarray(x, dtype=float)
        p = x[:, :2] if p is None else p
        labels = [None] * len(x) if labels is None else labels
        rows = [
            (first + i, [float(v) for v in x[i]], [float(v) for v in p[i]], None if labels[i] is None else int(labels[i]))
            for i in range(len(x))
        ]
        return spark.createDataFrame(rows, "id bigint, features array<double>, proj array<double>, label int")

    return build


@pytest.fixture()
def rng():
    return np.random.default_rng(7)
