"""The five fixed lookups over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from candlewick.operators.percentile import exact_percentile

MAX_PRICE_ROWS = 1000


def _newest(rows: DataFrame, limit: int, *tie_break: str) -> DataFrame:
    return rows.orderBy(F.desc("ts"), *tie_break).limit(limit)


def price_query(
    bars: DataFrame, ticker: str, from_date: str | None = None, to_date: str | None = None,
    limit: int = 100,
) -> DataFrame:
    """Bars of one ticker, newest first. Dates are midnights, both ends included."""
    if limit > MAX_PRICE_ROWS:
        raise ValueError(f"limit must be at most {MAX_PRICE_ROWS}, got {limit}")
    rows = bars.where(F.col("ticker") == ticker.upper())
    has_part = "part" in bars.columns
    if from_date:
        start = F.lit(from_date).cast("timestamp")
        rows = rows.where(F.col("ts") >= start)
        rows = rows.where(F.col("part") >= F.date_format(start, "yyyy")) if has_part else rows
    if to_date:
        end = F.lit(to_date).cast("timestamp")
        rows = rows.where(F.col("ts") <= end)
        # Years sort before their months, so this keeps all folders of the last year.
        rows = rows.where(F.col("part") <= F.date_format(end, "yyyy-99")) if has_part else rows
    return _newest(rows, limit, "timeframe").select(
        "ts", "open", "high", "low", "close", "volume"
    )


def gap_history(
    gaps: DataFrame, ticker_us: str, min_gap_pct: float | None = None, limit: int = 50
) -> DataFrame:
    rows = gaps.where(F.col("ticker_us") == ticker_us.upper())
    if min_gap_pct is not None:
        rows = rows.where(F.col("gap_pct") >= min_gap_pct)
    return _newest(rows, limit, "ticker_tase").select(
        "ts", "gap_pct", "gap_direction", "price_us_usd", "price_tase_in_usd"
    )


def active_alerts(
    alerts: DataFrame, chat_id: str | None = None, ticker: str | None = None
) -> DataFrame:
    rows = alerts.where("is_active")
    if chat_id:
        rows = rows.where(F.col("chat_id") == chat_id)
    if ticker:
        rows = rows.where(F.col("ticker") == ticker.upper())
    return rows.select("id", "ticker", "alert_type", "threshold", "chat_id")


def sentiment_history(records: DataFrame, ticker: str, limit: int = 30) -> DataFrame:
    rows = records.where(F.col("ticker") == ticker.upper())
    return _newest(rows, limit).select("ts", "score", "headline_count")


def json_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """Each row as one JSON text, for callers that exchange JSON, beside the columns ``keep``."""
    return rows.select(*keep, F.to_json(F.struct("*")).alias("json"))


def volume_top_decile(bars: DataFrame, share: float = 0.9, limit: int = 20) -> DataFrame:
    """Newest bars at or above the volume percentile of their ticker, for every ticker."""
    level = exact_percentile(bars, ["ticker"], "volume", share)
    high = bars.join(level, "ticker").where(F.col("volume") >= F.col("threshold"))
    rank = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("ts"), "timeframe"))
    return high.withColumn("recency", rank).where(F.col("recency") <= limit).select(
        "ticker", "ts", "volume", "close", "threshold", "recency"
    )

