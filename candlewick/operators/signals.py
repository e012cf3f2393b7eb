"""Newest signal of every series, over the lookback of its bar size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from candlewick import constants as C
from candlewick.functions import scores
from candlewick.operators import indicators as I
from candlewick.operators import levels as L
from candlewick.operators import series as S
from candlewick.operators import zones as Z
from candlewick.operators.prices import bar_scan, newest
from candlewick.operators.resample import resample

NUMBERS = ("open", "high", "low", "close", "volume")
PART_NAMES = ("rsi_points", "sma200_points", "macd_points", "volume_points", "change_points")


def signal_frame(bars: DataFrame) -> DataFrame:
    """Newest bar of every series with all indicators, its range and the close five bars back.

    ``bars`` must come from a lookback scan: its series are short, so the one
    shuffle by series serves the averages, the range and the choice of the last bar.
    """
    bars = I.bar_columns(bars, *NUMBERS).where("close IS NOT NULL")
    window = S.block_window()
    everything = W.partitionBy(*S.KEYS, "block")
    in_range = F.when(F.col("rn") >= F.col("length") - C.RANGE_BARS, F.col("close"))
    frame = I.with_indicators(S.whole_series(bars)).withColumns(
        {
            "close_before_5": F.lag("close", 5).over(window),
            "close_before": F.lag("close", 1).over(window),
            "high_52w": F.max(in_range).over(everything),
            "low_52w": F.min(in_range).over(everything),
            "_anchor": F.coalesce(
                F.lag("close", C.TREND_BARS - 1).over(window),
                F.first("close").over(window.rowsBetween(W.unboundedPreceding, 0)),
            ),
        }
    )
    return (
        frame.where(F.col("rn") == F.col("length") - 1)
        .withColumn("bars_seen", F.col("length"))
        .withColumn("trend", F.when(F.col("close") > F.col("_anchor"), "UPTREND")
                    .otherwise("DOWNTREND"))
        .withColumn("rsi_signal", I.rsi_label(F.col("rsi")))
        .withColumn("macd_bullish", F.coalesce(F.col("macd_histogram") > 0, F.lit(False)))
        .withColumn("price", F.col("close"))
        .drop("_anchor", "block", "rn", "j", "halo", "sub", "i", "length")
    )


def signal_snapshot(
    bars: DataFrame, timeframe: str = "1d", period: str | None = None, as_of: Column | None = None,
    zones: DataFrame | None = None,
) -> DataFrame:
    """:func:`signal_frame` over the usual lookback of a bar size."""
    if timeframe not in C.LOOKBACK:
        raise ValueError(f"signals need one of {sorted(C.LOOKBACK)}, got {timeframe}")
    scan = bar_scan(bars, period or C.LOOKBACK[timeframe], timeframe, as_of, zones)
    return signal_frame(scan)


def with_momentum(signals: DataFrame, use_change: bool = True) -> DataFrame:
    """Score parts, score and label; ``use_change=False`` leaves the 5-bar part at 0."""
    parts = scores.momentum_parts(
        F.col("price"), F.col("rsi"), F.col("macd_histogram"), F.col("volume_spike"),
        F.col("sma_200"), F.col("close_before_5") if use_change else None,
    )
    out = signals.withColumns(parts)
    total = sum((F.col(n) for n in PART_NAMES[1:]), F.col(PART_NAMES[0]))
    return out.withColumn("momentum", total).withColumn(
        "momentum_label", scores.momentum_label(F.col("momentum"))
    )


def with_levels(signals: DataFrame) -> DataFrame:
    """Levels from the closes; the position uses the current, maybe live, price."""
    high, low, close = F.col("high_52w"), F.col("low_52w"), F.col("close")
    has_range = (F.col("bars_seen") >= 2) & (high > low)
    support, resistance = L.nearest(high, low, close)
    return signals.withColumns(
        {
            "nearest_support": F.when(has_range, support),
            "nearest_resistance": F.when(has_range, resistance),
            "position_pct": F.when(has_range, scores.price_position(F.col("price"), low, high)),
        }
    )


def ma_relation(signals: DataFrame, periods: tuple[int, ...] = (20, 50, 150, 200)) -> DataFrame:
    """Price against each simple average; missing and zero averages are skipped."""
    rows = [
        F.struct(F.lit(I.ma_name("sma", p)).alias("ma"), F.col(I.ma_name("sma", p)).alias("value"))
        for p in periods
    ]
    relation = F.when(F.col("price") > F.col("value"), "above").otherwise("below")
    return (
        signals.select("ticker", "price", F.inline(F.array(*rows)))
        .where(F.col("value").isNotNull() & (F.col("value") != 0))
        .withColumn("relation", relation)
    )


def rsi_bands(series: DataFrame) -> DataFrame:
    """Label and both band predicates; they differ at exactly 0."""
    rsi = F.col("rsi")
    return series.select(
        *S.KEYS, "ts", "rsi",
        I.rsi_label(rsi).alias("rsi_signal"),
        I.is_overbought(rsi).alias("is_overbought"),
        I.is_oversold(rsi).alias("is_oversold"),
    )


def watch_rules(signals: DataFrame) -> DataFrame:
    """What to watch next session; one ticker may give two rows."""
    rsi, histogram = F.col("rsi"), F.coalesce("macd_histogram", F.lit(0.0))
    rule = lambda name, value, hit: F.struct(
        F.lit(name).alias("rule"), value.alias("value"), F.coalesce(hit, F.lit(False)).alias("hit")
    )
    rules = F.array(
        rule("bounce", rsi, (rsi < 35) & (rsi != 0)),
        rule("pullback", rsi, rsi > 70),
        rule("near_cross", histogram, (F.abs(histogram) < 0.05) & (histogram != 0)),
    )
    return (
        signals.select("ticker", F.inline(F.filter(rules, lambda r: r["hit"]))).drop("hit")
    )


def timeframe_scan(
    bars: DataFrame, as_of: Column | None = None, zones: DataFrame | None = None,
) -> DataFrame:
    """Daily, weekly and monthly bars of the daily series, each over its own lookback."""
    part = [c for c in ("part",) if c in bars.columns]
    daily = bars.where(F.col("timeframe") == "1d").select(*S.KEYS, "ts", *NUMBERS, *part)
    end = as_of if as_of is not None else newest(daily) if zones is None else Z.newest(zones, "1d")

    def scan(timeframe: str, period: str) -> DataFrame:
        recent = bar_scan(daily, period, "1d", end)
        if timeframe == "1d":
            return recent
        # A week or month that starts within the lookback has all its days there.
        return bar_scan(resample(recent, timeframe), period, timeframe, end)

    scans = [scan(t, period) for t, period in C.LOOKBACK.items()]
    return scans[0].unionByName(scans[1]).unionByName(scans[2])


def multi_timeframe(
    bars: DataFrame, as_of: Column | None = None, zones: DataFrame | None = None,
) -> DataFrame:
    """RSI and MACD direction on daily, weekly and monthly bars."""
    return signal_frame(timeframe_scan(bars, as_of, zones)).select(
        *S.KEYS, "rsi", "rsi_signal", "macd_bullish"
    )


def with_timeframes(
    bars: DataFrame, as_of: Column | None = None, zones: DataFrame | None = None,
) -> DataFrame:
    """Daily signals with RSI and MACD direction of the coarser bars alongside.

    All bar sizes share one pass; a ticker has at most three rows to fold.
    """
    signals = signal_frame(timeframe_scan(bars, as_of, zones))
    daily = F.struct(*[c for c in signals.columns if c != "ticker"])
    coarse = [
        F.first(F.when(F.col("timeframe") == t, F.col(c)), ignorenulls=True).alias(f"{name}_{c}")
        for t, name in (("1wk", "weekly"), ("1mo", "monthly"))
        for c in ("rsi", "rsi_signal", "macd_bullish")
    ]
    return (
        signals.groupBy("ticker")
        .agg(
            F.first(F.when(F.col("timeframe") == "1d", daily), ignorenulls=True).alias("_daily"),
            *coarse,
        )
        .where(F.col("_daily").isNotNull())
        .select("ticker", "_daily.*", *[f"{n}_{c}" for n in ("weekly", "monthly")
                                        for c in ("rsi", "rsi_signal", "macd_bullish")])
    )
