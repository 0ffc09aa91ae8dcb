import json
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from guardlens import schema as sc  # noqa: E402
from guardlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4, "8g", "guardlens-tests")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def trace(spark):
    """Build an event trace from (hookpoint, payload[, step, rank, run]) tuples."""
    def make(*events):
        rows = []
        for i, e in enumerate(events):
            hook, payload, *rest = e
            step, rank, run = (list(rest) + [None] * 3)[:3]
            rows.append((i + 1, step or 0, rank or 0, hook, (i + 1) * 1000, 1,
                         payload if isinstance(payload, str) else json.dumps(payload), run or "run0"))
        schema = sc.T.StructType([*sc.ENVELOPE.fields, sc.T.StructField("run", sc.S)])
        return spark.createDataFrame(rows, schema)
    return make
