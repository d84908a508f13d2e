import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from missaware.session import local_session

    s = local_session("*", 8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fx_t(spark):
    """FX_T: eight rows checkable by hand (a has two nulls), zero-imputed with masks."""
    from missaware.operators import prep

    rows = [
        (1, 1.0, 1.0, 0),
        (2, None, 2.0, 0),
        (3, 1.0, 3.0, 0),
        (4, None, 6.0, 0),
        (5, 5.0, 5.0, 1),
        (6, 6.0, 7.0, 1),
        (7, 7.0, 8.0, 1),
        (8, 8.0, 9.0, 1),
    ]
    df = spark.createDataFrame(rows, "k long, a double, b double, label int")
    return prep.prepare(df, ["a", "b"], impute="zero")
