"""Small fixed tables. Their size is that of the lists in ``constants``, so a
broadcast of one never grows with the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from candlewick import constants as C


def _literal(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float):
        return repr(value)
    if isinstance(value, tuple | list):
        return f"array({', '.join(_literal(v) for v in value)})"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline(spark: SparkSession, columns: str, rows: Sequence[Sequence[object]]) -> DataFrame:
    """A literal table the optimizer knows the size of."""
    values = ", ".join(f"({', '.join(_literal(v) for v in row)})" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def watchlist(spark: SparkSession, tickers: Sequence[str] = C.REPORT_WATCHLIST) -> DataFrame:
    return inline(spark, "pos, ticker", list(enumerate(tickers)))


def dual_listed(spark: SparkSession) -> DataFrame:
    return inline(spark, "ticker_us, ticker_tase", C.DUAL_LISTED)


def competitors(spark: SparkSession) -> DataFrame:
    return inline(spark, "ticker, competitors", C.COMPETITORS)


def snapshot_symbols(spark: SparkSession) -> DataFrame:
    return inline(
        spark,
        "pos, ticker, label, market_group, decimals, dollar",
        [(i, *row) for i, row in enumerate(C.SNAPSHOT)],
    )


def sectors(spark: SparkSession) -> DataFrame:
    return inline(spark, "pos, ticker, name", [(i, *row) for i, row in enumerate(C.SECTORS)])


def exchanges(spark: SparkSession) -> DataFrame:
    return inline(spark, "code, exchange", C.EXCHANGES)
