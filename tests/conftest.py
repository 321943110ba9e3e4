import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from almanac.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "almanac-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Complete daily series from {(code, name): values}; None is a gap."""
    import datetime as dt

    def build(series, start=dt.date(2020, 1, 1)):
        rows = [
            (c, n, start + dt.timedelta(days=i), i + 1, None if v is None else float(v))
            for (c, n), vs in series.items() for i, v in enumerate(vs)
        ]
        return spark.createDataFrame(rows, "station_code int, station string, date date, pos bigint, value double")
    return build
