import datetime as dt

import pytest

from candlewick.session import session


@pytest.fixture(scope="session")
def spark():
    s = session(
        "tests", "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make_bars(spark):
    """Daily bars from closes per ticker; open, high, low and volume follow the close unless given."""

    def build(closes, volumes=None, timeframe="1d"):
        rows = []
        for ticker, values in closes.items():
            for i, close in enumerate(values):
                volume = volumes[ticker][i] if volumes else 100
                ts = dt.datetime(2000, 1, 1) + dt.timedelta(days=i)
                rows.append((ticker, timeframe, ts, float(close), float(close), float(close),
                             float(close), int(volume)))
        return spark.createDataFrame(
            rows,
            "ticker STRING, timeframe STRING, ts TIMESTAMP, open DOUBLE, high DOUBLE, low DOUBLE, "
            "close DOUBLE, volume BIGINT",
        )

    return build
