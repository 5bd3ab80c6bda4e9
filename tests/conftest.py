import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leafclock.session import build_session  # noqa: E402
from leafclock.sources.scratch import use_local_workdir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
           "spark.driver.memory": "6g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    use_local_workdir(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Result rows as a sorted list of tuples."""

    def collect(df, *columns):
        out = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
        return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))

    return collect
