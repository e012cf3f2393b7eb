"""Price range, retracement and extension levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from candlewick import constants as C
from candlewick.functions.scores import at_level, price_position
from candlewick.operators import series as S
from candlewick.operators import zones as Z
from candlewick.operators.prices import last_bars


def level_values(high: Column, low: Column) -> dict[str, Column]:
    """Rounded retracement prices, highest first."""
    return {name: F.round(high - (high - low) * r, 4) for name, r in C.RETRACEMENTS}


def extension_values(high: Column, low: Column) -> dict[str, Column]:
    return {name: F.round(low + (high - low) * r, 4) for name, r in C.EXTENSIONS}


def column_name(level: str, kind: str = "level") -> str:
    return f"{kind}_{level.rstrip('%').replace('.', '_')}"


def nearest(high: Column, low: Column, price: Column) -> tuple[Column, Column]:
    """Closest level below and above the price; the range ends where there is none."""
    levels = F.array(*level_values(high, low).values())
    below = F.array_max(F.filter(levels, lambda v: v < price))
    above = F.array_min(F.filter(levels, lambda v: v > price))
    return F.coalesce(below, low), F.coalesce(above, high)


def price_range(bars: DataFrame, window: int = C.RANGE_BARS, zones: DataFrame | None = None) -> DataFrame:
    """Highest and lowest close of the newest ``window`` bars, newest close and trend.

    Only ``window`` bars per series survive the map side, so no series is
    gathered. Series with fewer than two bars or no spread have no range. With the zone map only the
    folders that hold those bars are read.
    """
    if zones is not None:
        bars = Z.newest_rows(bars.select(*S.KEYS, "part", "ts", "close"), zones, max(window, C.TREND_BARS))
    recent = last_bars(bars.select(*S.KEYS, "ts", "close"), max(window, C.TREND_BARS))
    inside = F.col("recency") <= window
    close_at = lambda n: F.max(F.when(F.col("recency") == n, F.col("close")))
    # The trend looks 19 bars back, or at the oldest bar of a shorter series.
    anchor = F.max_by(F.when(F.col("recency") <= C.TREND_BARS, F.col("close")),
                      F.when(F.col("recency") <= C.TREND_BARS, F.col("recency")))
    return recent.groupBy(*S.KEYS).agg(
        F.max(F.when(inside, F.col("close"))).alias("high_52w"),
        F.min(F.when(inside, F.col("close"))).alias("low_52w"),
        close_at(1).alias("current_price"),
        anchor.alias("_anchor"),
        F.count(F.lit(1)).alias("bars_seen"),
    ).withColumn(
        "trend", F.when(F.col("current_price") > F.col("_anchor"), "UPTREND").otherwise("DOWNTREND")
    ).drop("_anchor")


def split_ranges(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable ranges, and rejected series with the reason."""
    short = F.col("bars_seen") < 2
    flat = F.col("high_52w") == F.col("low_52w")
    reason = F.when(short, "fewer than two bars").when(flat, "no price range")
    return ranges.where(~short & ~flat), ranges.withColumn("reason", reason).where(short | flat)


def rolling_range(
    bars: DataFrame, window: int = C.RANGE_BARS, size: int = S.BLOCK_ROWS
) -> DataFrame:
    """Range over the last ``window`` closes at every bar of the full history.

    Cut every ``window`` bars, a frame is the end of one chunk and the start of
    the next, so two running extremes give it at a cost that does not grow with the window.
    """
    series = bars.select(*S.KEYS, "ts", F.col("close").cast("double").alias("close"))
    blocks = S.split_blocks(S.number_series(series), window - 1, size=max(size, window))
    chunk = W.partitionBy(*S.KEYS, "block", "_chunk")
    forward = chunk.orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    backward = chunk.orderBy(F.desc("rn")).rowsBetween(W.unboundedPreceding, 0)
    ends = lambda name: F.lag(name, window - 1).over(S.block_window())
    return (
        blocks.withColumn("_chunk", F.floor(F.col("rn") / window))
        .withColumns({
            "_high_to": F.max("close").over(forward), "_low_to": F.min("close").over(forward),
        })
        .withColumns({
            "_high_from": F.max("close").over(backward), "_low_from": F.min("close").over(backward),
        })
        .withColumn("range_high", F.greatest("_high_to", ends("_high_from")))
        .withColumn("range_low", F.least("_low_to", ends("_low_from")))
        .where(~F.col("halo"))
        .select(*S.KEYS, "ts", "close", "range_high", "range_low")
    )


def fibonacci_levels(bars: DataFrame, window: int = C.RANGE_BARS, zones: DataFrame | None = None) -> DataFrame:
    """One row per series: range, trend, all levels, nearest support and resistance."""
    usable, _ = split_ranges(price_range(bars, window, zones))
    high, low, price = F.col("high_52w"), F.col("low_52w"), F.col("current_price")
    support, resistance = nearest(high, low, price)
    return usable.select(
        *S.KEYS, "high_52w", "low_52w", "current_price", "trend",
        price_position(price, low, high).alias("position_pct"),
        *[v.alias(column_name(n)) for n, v in level_values(high, low).items()],
        *[v.alias(column_name(n, "ext")) for n, v in extension_values(high, low).items()],
        support.alias("nearest_support"),
        resistance.alias("nearest_resistance"),
    )


def fibonacci_rows(bars: DataFrame, window: int = C.RANGE_BARS, zones: DataFrame | None = None) -> DataFrame:
    """One row per level, with its place relative to the price and its role."""
    usable, _ = split_ranges(price_range(bars, window, zones))
    high, low, price = F.col("high_52w"), F.col("low_52w"), F.col("current_price")
    entry = lambda kind, i, name, value: F.struct(
        F.lit(kind).alias("kind"), F.lit(i).alias("level_pos"),
        F.lit(name).alias("level"), value.alias("level_price"),
    )
    rows = [
        entry("retracement", i, n, v) for i, (n, v) in enumerate(level_values(high, low).items())
    ] + [
        entry("extension", i, n, v) for i, (n, v) in enumerate(extension_values(high, low).items())
    ]
    level = F.col("level_price")
    return (
        usable.select(*S.KEYS, "current_price", F.inline(F.array(*rows)))
        .withColumn("marker", F.when(F.col("kind") == "retracement", at_level(level, price)))
        .withColumn("status", F.when(level < price, "Support").otherwise("Resistance"))
    )
