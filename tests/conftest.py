import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def spark():
    from cadencekit.session import build_session

    session = build_session(partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def hot(spark):
    """Set the row limit of a stream for one test; the default comes back after it."""
    from cadencekit.session import HOT_ROWS_CONF

    yield lambda rows: spark.conf.set(HOT_ROWS_CONF, str(rows))
    spark.conf.unset(HOT_ROWS_CONF)


@pytest.fixture
def rows(spark):
    """Collect chosen columns as a sorted list of tuples."""
    def collect(df, *columns):
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    return collect
