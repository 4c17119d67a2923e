import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from kymora import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "kymora-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def rows(spark):
    """Rows of a DataFrame as a list of plain tuples, sorted."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
