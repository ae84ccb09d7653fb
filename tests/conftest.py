import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from fleetspark.session import get_spark
    s = get_spark("local[4]", 4, app_name="fleetspark-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collected rows as sorted tuples (order-free comparison)."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=repr)
