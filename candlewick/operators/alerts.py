"""Price alerts: validation, setting, cancelling, triggering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions import text

ABOVE, BELOW = "PRICE_ABOVE", "PRICE_BELOW"


def validate(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean requests, and rejected ones with the reason."""
    clean = requests.withColumn("ticker", text.ticker_text(F.col("raw_ticker"))).withColumn(
        "threshold", F.col("raw_price").try_cast("double")
    )
    reason = F.when(~text.is_ticker(F.col("ticker")), "invalid ticker").when(
        F.col("threshold").isNull() | F.isnan("threshold") | (F.col("threshold") <= 0),
        "invalid price",
    )
    marked = clean.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(
        F.col("reason").isNotNull()
    )


def alert_type(threshold: Column, price: Column) -> Column:
    """Equality waits for a fall, which has then already happened."""
    return F.when(threshold > price, ABOVE).otherwise(BELOW)


def set_alerts(alerts: DataFrame, requests: DataFrame, prices: DataFrame) -> DataFrame:
    """Alert table after a batch of valid requests.

    A request replaces the active alerts of its chat and ticker; the last one of
    a batch wins. Requests for tickers without a price change nothing.
    """
    pair = ["chat_id", "ticker"]
    last = (
        requests.join(prices.select("ticker", "price"), "ticker")
        .groupBy(*pair)
        .agg(F.max_by(F.struct("request_id", "threshold", "price"), "request_id").alias("_r"))
        .select(*pair, "_r.*")
    )
    kept = (
        alerts.join(last.select(*pair, F.lit(True).alias("_replaced")), pair, "left")
        .withColumn("is_active", F.col("is_active") & F.col("_replaced").isNull())
        .select(*alerts.columns)
    )
    added = last.select(
        F.col("request_id").alias("id"), "chat_id", "ticker",
        alert_type(F.col("threshold"), F.col("price")).alias("alert_type"), "threshold",
        F.lit(True).alias("is_active"), F.lit(None).cast("timestamp").alias("triggered_at"),
    )
    return kept.unionByName(added)


def cancel_alerts(alerts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alert table after cancellations, and requests that matched no active alert."""
    pair = ["chat_id", "ticker"]
    asked = requests.select(*pair).distinct()
    updated = (
        alerts.join(asked.withColumn("_asked", F.lit(True)), pair, "left")
        .withColumn("is_active", F.col("is_active") & F.col("_asked").isNull())
        .select(*alerts.columns)
    )
    missing = asked.join(alerts.where("is_active").select(*pair), pair, "left_anti")
    return updated, missing


def is_triggered(kind: Column, price: Column, threshold: Column) -> Column:
    hit = ((kind == ABOVE) & (price >= threshold)) | ((kind == BELOW) & (price <= threshold))
    return F.coalesce(hit, F.lit(False))


def triggered(alerts: DataFrame, prices: DataFrame) -> DataFrame:
    """Active alerts whose price condition holds; one price per ticker serves all its alerts."""
    hit = is_triggered(F.col("alert_type"), F.col("price"), F.col("threshold"))
    return (
        alerts.where("is_active")
        .join(prices.select("ticker", "price"), "ticker")
        .where(hit)
        .select("id", "chat_id", "ticker", "alert_type", "threshold", "price")
    )


def mark_triggered(alerts: DataFrame, fired: DataFrame, as_of: Column) -> DataFrame:
    """Alert table with fired alerts switched off and stamped."""
    hit = fired.select("id", F.lit(True).alias("_fired")).distinct()
    return (
        alerts.join(hit, "id", "left")
        .withColumn("is_active", F.col("is_active") & F.col("_fired").isNull())
        .withColumn(
            "triggered_at", F.when(F.col("_fired"), as_of).otherwise(F.col("triggered_at"))
        )
        .select(*alerts.columns)
    )
