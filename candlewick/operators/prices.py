"""Scans over bars and quotes: lookbacks, newest rows, changes, key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from candlewick import constants as C
from candlewick.operators import zones as Z
from candlewick.operators.resample import tick_order
from candlewick.operators.series import KEYS

FLAT_BAND = 0.005


def newest(bars: DataFrame, ts: str = "ts") -> Column:
    """The newest timestamp of a table, as a scalar subquery."""
    return bars.select(F.max(ts)).scalar()


def bar_scan(
    bars: DataFrame, period: str = "1y", timeframe: str = "1d", as_of: Column | None = None,
    zones: DataFrame | None = None,
) -> DataFrame:
    """Bars of one size within a lookback that ends at ``as_of`` (default: newest bar, by the zone map where given)."""
    if period not in C.PERIODS:
        raise ValueError(f"period must be one of {sorted(C.PERIODS)}, got {period}")
    bars = bars.where(F.col("timeframe") == timeframe)
    end = as_of if as_of is not None else newest(bars) if zones is None else Z.newest(zones, timeframe)
    since = end - F.expr(f"INTERVAL {C.PERIODS[period]}")
    if as_of is not None:
        bars = bars.where(F.col("ts") <= as_of)
    if "part" in bars.columns:
        form = "yyyy-MM" if timeframe in ("1m", "5m") else "yyyy"
        bars = bars.where(F.col("part") >= F.date_format(since, form)).drop("part")
    return bars.where(F.col("ts") > since)


def last_bar(bars: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Newest bar of every series; one aggregate per column, which keeps the aggregation hash-based.

    With the zone map only the newest folder of each series is read.
    """
    if zones is not None:
        bars = Z.newest_rows(bars, zones, 1).drop("part")
    fields = [c for c in bars.columns if c not in KEYS]
    return bars.groupBy(*KEYS).agg(*[F.max_by(c, "ts").alias(c) for c in fields]).select(*KEYS, *fields)


def last_bars(bars: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` bars of every series; map tasks keep ``n`` per series each."""
    rank = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("ts")))
    return bars.withColumn("recency", rank).where(F.col("recency") <= n)


def latest_quote(quotes: DataFrame) -> DataFrame:
    """Newest quote with a price per ticker."""
    return (
        quotes.where(F.col("last_price").isNotNull())
        .withColumn("_order", tick_order())
        .groupBy("ticker")
        .agg(
            F.max("ts").alias("ts"),
            F.max_by("last_price", "_order").alias("last_price"),
            F.max_by("prev_close", "_order").alias("prev_close"),
        )
    )


def last_two_closes(bars: DataFrame, timeframe: str = "1d", zones: DataFrame | None = None) -> DataFrame:
    """Newest close and the one before it, over bars of one size that have a close; from the zone map alone where given."""
    if zones is not None:
        return Z.last_closes(zones, timeframe)
    bars = bars.where((F.col("timeframe") == timeframe) & F.col("close").isNotNull())
    closes = last_bars(bars.select(*KEYS, "ts", "close"), 2)
    pick = lambda n: F.max(F.when(F.col("recency") == n, F.col("close")))
    return closes.groupBy("ticker").agg(
        pick(1).alias("last_close"), pick(2).alias("close_before")
    )


def quote_or_close(
    tickers: DataFrame, quotes: DataFrame, bars: DataFrame, zones: DataFrame | None = None,
) -> DataFrame:
    """Price and previous close: the quote when complete, else the last two closes.

    NULL for a ticker with neither.
    """
    quote = latest_quote(quotes).select("ticker", "last_price", "prev_close")
    complete = F.col("last_price").isNotNull() & F.col("prev_close").isNotNull()
    has_two = F.col("close_before").isNotNull()
    price = F.when(complete, F.col("last_price")).when(has_two, F.col("last_close"))
    previous = F.when(complete, F.col("prev_close")).when(has_two, F.col("close_before"))
    source = F.when(complete, "quote").when(has_two, "close")
    return (
        tickers.join(quote, "ticker", "left")
        .join(last_two_closes(bars, zones=zones), "ticker", "left")
        .select(*tickers.columns, price.alias("price"), previous.alias("previous"),
                source.alias("price_source"))
    )


def percent_change(new: Column, old: Column) -> Column:
    """Change in percent; 0 when there is nothing to compare with."""
    return F.coalesce(F.when(old != 0, (new - old) / old * 100), F.lit(0.0))


def direction(pct: Column) -> Column:
    return F.when(pct > FLAT_BAND, "up").when(pct < -FLAT_BAND, "down").otherwise("flat")


def bar_change(bars: DataFrame) -> DataFrame:
    """Close against open of the same bar."""
    pct = percent_change(F.col("close"), F.col("open"))
    return bars.withColumn("pct", pct).withColumn("direction", direction(F.col("pct")))


def day_change(bars: DataFrame, quotes: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Live price against its previous close; without a usable one, the last two closes."""
    quote = latest_quote(quotes).select("ticker", "last_price", "prev_close")
    live = F.col("prev_close") > 0
    pct = (
        F.when(live, percent_change(F.col("last_price"), F.col("prev_close")))
        .when(F.col("close_before").isNotNull(),
              percent_change(F.col("last_close"), F.col("close_before")))
    )
    return (
        last_two_closes(bars, zones=zones).join(quote, "ticker", "full_outer")
        .select("ticker", pct.alias("pct"))
        .withColumn("direction", F.when(F.col("pct").isNotNull(), direction(F.col("pct"))))
    )


def live_override(signals: DataFrame, quotes: DataFrame) -> DataFrame:
    """Live price in place of the last close; indicators stay as they are."""
    quote = latest_quote(quotes).select("ticker", "last_price", "prev_close")
    return signals.join(quote, "ticker", "left").withColumn(
        "price", F.coalesce("last_price", "price")
    ).drop("last_price")


def key_metrics(bars: DataFrame) -> DataFrame:
    """Headline figures of each series over the loaded bars."""
    figures = bars.groupBy(*KEYS).agg(
        F.max("high").alias("period_high"),
        F.min("low").alias("period_low"),
        F.floor(F.sum("volume") / F.count("volume")).cast("bigint").alias("avg_volume"),
        F.count(F.lit(1)).alias("data_points"),
    )
    change = F.col("last_close") - F.col("close_before")
    return figures.join(last_two_closes(bars), "ticker").select(
        *KEYS,
        F.col("last_close").alias("last_price"),
        change.alias("change"),
        (F.try_divide(change, F.col("close_before")) * 100).alias("change_pct"),
        "period_high", "period_low", "avg_volume", "data_points",
    )


def fresh_lookup(values: DataFrame, key: str, as_of: Column, ttl: int) -> DataFrame:
    """Newest value per key, if it is at most ``ttl`` seconds old."""
    fields = [c for c in values.columns if c != key]
    age = F.unix_seconds(as_of) - F.unix_seconds("ts")
    # Rows too old to count are left out by the scan; the newest of the rest is the newest of all.
    recent = values.where((F.col("ts") <= as_of) & (age <= ttl))
    return (
        recent.withColumn("_order", tick_order()).groupBy(key)
        .agg(*[F.max_by(c, "_order").alias(c) for c in fields])
    )


def listing_attributes(tickers: DataFrame) -> DataFrame:
    """Exchange, currency and its sign, from the ticker's suffix."""
    local = F.endswith(F.upper("ticker"), F.lit(".TA"))
    return tickers.select(
        "ticker",
        F.when(local, "TASE").otherwise("NYSE").alias("exchange"),
        F.when(local, "ILS").otherwise("USD").alias("currency"),
        F.when(local, "₪").otherwise("$").alias("currency_symbol"),
    )
