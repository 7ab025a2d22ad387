import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from examloom.session import get_spark

    return get_spark(4, "tests", shuffle_partitions=4, spark__driver__memory="6g")


@pytest.fixture(scope="session")
def rows():
    def collect(df, *order):
        out = [r.asDict(recursive=True) for r in df.collect()]
        return sorted(out, key=lambda r: tuple(str(r[c]) for c in order)) if order else out

    return collect
