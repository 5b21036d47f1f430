import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cellseason.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "cellseason-tests", "8g")
    s.sparkContext.setLogLevel("OFF")
    yield s
    s.stop()


def rows(df, *order):
    """Collected rows as tuples, sorted when asked."""
    out = [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return out
