import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from snapline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("snapline-tests", cpus=8, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Rows of a frame as sorted tuples, floats rounded."""

    def read(df, *columns):
        picked = df.select(*columns) if columns else df
        out = [
            tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in picked.collect()
        ]
        return sorted(out, key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))

    return read
