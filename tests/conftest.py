import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_session()


def rows(df, *order):
    """All rows as tuples, sorted."""
    out = [tuple(r) for r in (df.select(*order) if order else df).collect()]
    return sorted(out, key=repr)
