import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tapeloom.session import local_session

    session = local_session("4", shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """bars(ticker, dt, i, open, high, low, close, volume) from lists of tuples per ticker."""
    import datetime as dt

    def make(series: dict, start="2020-01-01"):
        first = dt.date.fromisoformat(start)
        rows = []
        for ticker, values in series.items():
            for i, v in enumerate(values):
                day = v[5] if len(v) > 5 else first + dt.timedelta(days=i)
                rows.append((ticker, day, i, *map(float, v[:5])))
        schema = "ticker string, dt date, i bigint, open double, high double, low double, close double, volume double"
        return spark.createDataFrame(rows, schema)

    return make
