"""Score, band and label columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlewick import constants as C


def momentum_parts(
    price: Column, rsi: Column, histogram: Column, spike: Column, sma200: Column,
    close_before_5: Column | None,
) -> dict[str, Column]:
    """Five parts of up to 20 points; whatever is missing scores 0.

    Without ``close_before_5`` (comparison reports) the 5-bar part is 0.
    """
    no_points = F.lit(0)
    if close_before_5 is None:
        change_points = no_points
    else:
        pct = F.when(close_before_5 != 0, (price - close_before_5) / close_before_5 * 100)
        change_points = (
            F.when(pct > 3.0, 20).when(pct > 1.0, 15).when(pct > 0, 10).otherwise(no_points)
        )
    return {
        "rsi_points": F.when(rsi > 70, 20).when(rsi >= 50, 15).when(rsi >= 40, 10)
        .otherwise(no_points),
        "sma200_points": F.when(price > sma200, 20).otherwise(no_points),
        "macd_points": F.when(histogram > 0, 20).otherwise(no_points),
        "volume_points": F.when(spike, 20).otherwise(no_points),
        "change_points": change_points,
    }


def momentum_label(score: Column) -> Column:
    label = F.lit(C.MOMENTUM_LOWEST)
    for floor, name in reversed(C.MOMENTUM_LABELS):
        label = F.when(score >= floor, name).otherwise(label)
    return label


def sector_band(pct: Column) -> Column:
    return (
        F.when(pct > 1.5, "hot").when(pct >= 0, "up").when(pct >= -0.5, "soft").otherwise("down")
    )


def vix_label(vix: Column) -> Column:
    return (
        F.when(vix < 15, "Low Fear").when(vix < 25, "Moderate").when(vix < 35, "Elevated")
        .otherwise("Extreme Fear")
    )


def sentiment_band(score: Column) -> Column:
    return F.when(score >= 0.3, "positive").when(score <= -0.3, "negative").otherwise("neutral")


def sentiment_bar(score: Column) -> Column:
    """Ten cells; halves round to the even cell."""
    filled = F.greatest(F.lit(0), F.least(F.lit(10), F.bround((score + 1) / 2 * 10).cast("int")))
    return F.concat(F.repeat(F.lit("▓"), filled), F.repeat(F.lit("░"), F.lit(10) - filled))


def price_position(price: Column, low: Column, high: Column) -> Column:
    """Where the price sits between low and high, in percent."""
    return F.coalesce(F.when(high - low > 0, (price - low) / (high - low) * 100), F.lit(0.0))


def at_level(level: Column, price: Column) -> Column:
    near = F.abs(level - price) / F.greatest(price, F.lit(0.001)) < C.AT_LEVEL_TOLERANCE
    return F.when(near, "at").when(price > level, "above").otherwise("below")
