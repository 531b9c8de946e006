import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from larder.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of an expression over one row of text columns."""

    def evaluate(expression, **columns):
        names = ", ".join(f"{n} string" for n in columns) or "x string"
        row = tuple(columns.values()) or (None,)
        return spark.createDataFrame([row], names).select(expression().alias("v")).first()["v"]

    return evaluate
