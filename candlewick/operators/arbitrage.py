"""Price gaps between the two listings of a company."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick import constants as C
from candlewick.operators.asof import value_at
from candlewick.sources import dims

PAIR = "USD/ILS"
#: Gap rows as stored, and what tells them apart.
GAPS = (
    "ticker_us STRING, ticker_tase STRING, timeframe STRING, ts TIMESTAMP, price_us_usd DOUBLE, price_tase_ils DOUBLE, "
    "usd_ils_rate DOUBLE, price_tase_in_usd DOUBLE, gap_pct DOUBLE, gap_direction STRING, is_opportunity BOOLEAN"
)
GAP_KEY = ["ticker_us", "ticker_tase", "timeframe", "ts"]


def local_listing(tickers: DataFrame) -> DataFrame:
    """Local ticker of each US ticker; unlisted ones get the default suffix."""
    known = dims.dual_listed(tickers.sparkSession)
    default = F.concat("ticker_us", F.lit(".TA"))
    return tickers.join(F.broadcast(known), "ticker_us", "left").withColumn(
        "ticker_tase", F.coalesce("ticker_tase", default)
    )


def gap_rows(paired: DataFrame) -> DataFrame:
    """Gap columns for rows with both prices and the rate.

    The stored gap is absolute and rounded; the opportunity flag looks at the
    unrounded one, and a gap of 0 counts as a local premium.
    """
    local = F.col("price_tase_ils") / F.col("usd_ils_rate")
    gap = (F.col("price_us_usd") - F.col("_local")) / F.col("_local") * 100
    return (
        paired.withColumn("_local", local)
        .withColumn("_gap", gap)
        .withColumns(
            {
                "price_tase_in_usd": F.round("_local", 4),
                "gap_pct": F.round(F.abs("_gap"), 4),
                "gap_direction": F.when(F.col("_gap") > 0, "US_PREMIUM").otherwise("TASE_PREMIUM"),
                "is_opportunity": F.abs("_gap") >= C.MIN_GAP_PCT,
            }
        )
        .drop("_local", "_gap")
    )


def paired_prices(bars: DataFrame, fx_rates: DataFrame) -> DataFrame:
    """US bar, local bar of the same time and the exchange rate known then.

    The listing map has a fixed size and is broadcast to both bar scans, so only
    bars of listed companies reach the join on company and time.
    """
    listed = F.broadcast(dims.dual_listed(bars.sparkSession))
    price = bars.select("ticker", "timeframe", "ts", F.col("close").cast("double").alias("close"))
    us = price.join(listed, price["ticker"] == listed["ticker_us"]).select(
        "ticker_us", "ticker_tase", "timeframe", "ts", F.col("close").alias("price_us_usd")
    )
    local = price.join(listed, price["ticker"] == listed["ticker_tase"]).select(
        "ticker_us", "timeframe", "ts", F.col("close").alias("price_tase_ils")
    )
    both = us.join(local, ["ticker_us", "timeframe", "ts"])
    rates = fx_rates.where(F.col("pair") == PAIR)
    at = value_at(both.select(F.lit(PAIR).alias("pair"), "ts"), rates, "pair", "rate").select(
        "ts", F.col("rate").alias("usd_ils_rate")
    )
    return both.join(at, "ts", "left").withColumn(
        "usd_ils_rate", F.coalesce("usd_ils_rate", F.lit(C.FALLBACK_USD_ILS))
    )


def arbitrage_gap(bars: DataFrame, fx_rates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gap rows, and pairs that have no gap because a price or the rate is missing or 0."""
    paired = paired_prices(bars, fx_rates)
    used = lambda name: F.col(name) != 0
    good = F.coalesce(used("price_us_usd") & used("price_tase_ils") & used("usd_ils_rate"), F.lit(False))
    rejected = paired.where(~good).withColumn("reason", F.lit("price or rate is missing or zero"))
    return gap_rows(paired.where(good)), rejected


def competitors_of(tickers: DataFrame) -> DataFrame:
    """One row per competitor; NULL for a ticker without any."""
    known = dims.competitors(tickers.sparkSession)
    return (
        tickers.select(F.upper("ticker").alias("ticker"))
        .join(F.broadcast(known), "ticker", "left")
        .select("ticker", F.posexplode_outer("competitors").alias("rank", "competitor"))
    )
