import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ratecube.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus=4)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Rows of a table as a list of tuples, sorted, in the order of the given columns."""

    def collect(table, *columns):
        picked = table.select(*columns) if columns else table
        return sorted((tuple(r) for r in picked.collect()), key=repr)

    return collect
