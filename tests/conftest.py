import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from linestream.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests", "8g")


@pytest.fixture
def rows():
    """Rows of a data frame as a sorted list of tuples."""

    def get(df, *cols):
        out = (df.select(*cols) if cols else df).collect()
        return sorted((tuple(r) for r in out), key=repr)

    return get
