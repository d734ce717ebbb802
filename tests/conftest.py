import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from quillmill.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return get_spark("tests", cpus=8, partitions=3)


def rows(df, *columns):
    """The rows of some columns, sorted by their text."""
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
