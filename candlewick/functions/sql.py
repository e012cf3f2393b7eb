"""Temporary SQL functions for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

from candlewick import constants as C


def register(spark: SparkSession) -> None:
    """``is_nyse_open(ts)``, ``momentum_label(score)`` and ``price_position(price, low, high)``."""
    opens, closes = C.NYSE_HOURS
    labels = " ".join(f"WHEN score >= {floor} THEN '{name}'" for floor, name in C.MOMENTUM_LABELS)
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION is_nyse_open(ts TIMESTAMP) RETURNS BOOLEAN RETURN
        weekday(from_utc_timestamp(ts, '{C.NEW_YORK}')) <= 4
        AND date_format(from_utc_timestamp(ts, '{C.NEW_YORK}'), 'HH:mm:ss.SSSSSS')
            BETWEEN '{opens}' AND '{closes}'"""
    )
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION momentum_label(score INT) RETURNS STRING RETURN
        CASE {labels} ELSE '{C.MOMENTUM_LOWEST}' END"""
    )
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION price_position(price DOUBLE, low DOUBLE, high DOUBLE)
        RETURNS DOUBLE RETURN
        CASE WHEN high - low > 0 THEN (price - low) / (high - low) * 100 ELSE 0 END"""
    )
