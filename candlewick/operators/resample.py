"""Bars from ticks, and coarser bars from finer ones."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = {"1m": "minute", "1d": "day", "1wk": "week", "1mo": "month"}


def tick_order(ts: str = "ts", event_id: str = "event_id") -> Column:
    """Time, then event id, as one number.

    A number can be the buffer of a hash aggregation; a struct would force sorting.
    """
    micros = F.unix_micros(ts).cast("decimal(18,0)")
    return micros * F.lit(Decimal(10) ** 19) + F.col(event_id).cast("decimal(19,0)")


def bars_from_ticks(ticks: DataFrame, timeframe: str = "1m") -> DataFrame:
    """OHLCV bars; ticks of one instant are ordered by event id."""
    return (
        ticks.withColumn("_order", tick_order())
        .groupBy("ticker", F.date_trunc(UNITS[timeframe], "ts").alias("bar_ts"))
        .agg(
            F.min_by("price", "_order").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_order").alias("close"),
            F.sum("size").alias("volume"),
        )
        .select(
            "ticker", F.col("bar_ts").alias("ts"), F.lit(timeframe).alias("timeframe"),
            "open", "high", "low", "close", "volume",
        )
    )


def resample(bars: DataFrame, timeframe: str, source: str = "1d") -> DataFrame:
    """First open, highest high, lowest low, last close and total volume per period, from bars of one size.

    Bars of one period share a timestamp-ordered key, so partial aggregation
    keeps at most one row per series and period from each map task.
    """
    return (
        bars.where(F.col("timeframe") == source)
        .groupBy("ticker", F.date_trunc(UNITS[timeframe], "ts").alias("period_ts"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select(
            "ticker", F.col("period_ts").alias("ts"), F.lit(timeframe).alias("timeframe"),
            "open", "high", "low", "close", "volume",
        )
    )
