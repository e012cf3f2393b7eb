"""Moving averages, RSI, MACD and volume spikes over bar series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick import constants as C
from candlewick.operators import series as S

RSI_LABELS = ("OVERSOLD", "OVERBOUGHT", "NEUTRAL")


def bar_columns(bars: DataFrame, *columns: str) -> DataFrame:
    """Key, time and the given columns as doubles; a NaN counts as missing."""
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    return bars.select(*S.KEYS, "ts", *[number(c) for c in columns])


def _blocks(bars: DataFrame, halo: int, size: int, inner: int | None = None) -> DataFrame:
    return S.split_blocks(S.number_series(bars), halo, size=size, inner=inner)


def _priced(bars: DataFrame, value: str = "close") -> DataFrame:
    """Bars with a value: recursive averages weigh bars by position, so one without has no place in the series."""
    return bars.where(F.col(value).isNotNull())


def _finish(blocks: DataFrame, *columns: str) -> DataFrame:
    return blocks.where(~F.col("halo")).select(*S.KEYS, "ts", *columns)


def sma(
    bars: DataFrame, period: int, value: str = "close", name: str = "sma", size: int = S.BLOCK_ROWS
) -> DataFrame:
    """Simple moving average; NULL until ``period`` bars exist."""
    blocks = _blocks(bar_columns(bars, value), max(period, 1) - 1, max(size, period))
    return _finish(S.with_averages(blocks, {name: (value, period)}), value, name)


def ema(
    bars: DataFrame, period: int, value: str = "close", name: str = "ema", size: int = S.BLOCK_ROWS
) -> DataFrame:
    """Exponential moving average seeded with the first bar; NULL for ``period - 1`` bars."""
    decay = S.span(name, value, period)
    size = S.block_size([decay], size)
    blocks = _blocks(_priced(bar_columns(bars, value), value), 0, size)
    return _finish(S.decayed_averages(blocks, [decay], size=size), value, name)


def _gains(blocks: DataFrame, value: str = "close") -> DataFrame:
    change = F.col(value) - F.lag(value).over(S.block_window())
    return (
        blocks.withColumn("_change", change)
        .withColumn("_gain", F.coalesce(F.greatest("_change", F.lit(0.0)), F.lit(0.0)))
        .withColumn("_loss", F.coalesce(F.greatest(-F.col("_change"), F.lit(0.0)), F.lit(0.0)))
        .drop("_change")
    )


def _rsi_decays(period: int) -> list[S.Decay]:
    # The first change belongs to the second bar.
    return [
        S.wilder("_avg_gain", "_gain", period, start=1),
        S.wilder("_avg_loss", "_loss", period, start=1),
    ]


def _rsi_value() -> Column:
    """No gains at all gives 0 even on a flat series; no losses gives 100."""
    gain, loss = F.col("_avg_gain"), F.col("_avg_loss")
    return (
        F.when(gain.isNull(), F.lit(None).cast("double"))
        .when(gain == 0, F.lit(0.0))
        .when(loss == 0, F.lit(100.0))
        .otherwise(100.0 - 100.0 / (1.0 + gain / loss))
    )


def rsi_label(rsi: Column) -> Column:
    """A value of exactly 0 counts as no signal."""
    return (
        F.when((rsi <= C.RSI_OVERSOLD) & (rsi != 0), "OVERSOLD")
        .when(rsi >= C.RSI_OVERBOUGHT, "OVERBOUGHT")
        .otherwise("NEUTRAL")
    )


def is_overbought(rsi: Column, level: float = C.RSI_OVERBOUGHT) -> Column:
    return F.coalesce(rsi >= level, F.lit(False))


def is_oversold(rsi: Column, level: float = C.RSI_OVERSOLD) -> Column:
    return F.coalesce(rsi <= level, F.lit(False))


def rsi(bars: DataFrame, period: int = C.RSI_PERIOD, size: int = S.BLOCK_ROWS) -> DataFrame:
    """Relative strength index with Wilder smoothing."""
    decays = _rsi_decays(period)
    size = S.block_size(decays, size)
    blocks = _gains(_blocks(_priced(bar_columns(bars, "close")), 1, size))
    out = S.decayed_averages(blocks, decays, size=size)
    return _finish(out.withColumn("rsi", _rsi_value()), "close", "rsi")


def _with_macd(
    blocks: DataFrame, fast: int, slow: int, signal: int, size: int | None, per_block: int = 1
) -> DataFrame:
    """Signal line and histogram, given columns ``_fast`` and ``_slow``."""
    start = max(fast, slow) - 1
    out = blocks.withColumn("macd_line", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    out = S.decayed_averages(out, [S.span("macd_signal", "macd_line", signal, start)], size=size, per_block=per_block)
    return out.withColumn("macd_histogram", F.col("macd_line") - F.col("macd_signal"))


def macd(
    bars: DataFrame,
    fast: int = C.MACD_FAST,
    slow: int = C.MACD_SLOW,
    signal: int = C.MACD_SIGNAL,
    size: int = S.BLOCK_ROWS,
) -> DataFrame:
    """MACD line, signal line and histogram."""
    decays = [S.span("_fast", "close", fast), S.span("_slow", "close", slow)]
    size = S.block_size([*decays, S.span("macd_signal", "close", signal)], size)
    blocks = _blocks(_priced(bar_columns(bars, "close")), 0, size)
    out = _with_macd(S.decayed_averages(blocks, decays, size=size), fast, slow, signal, size)
    return _finish(out, "close", "macd_line", "macd_signal", "macd_histogram")


def _with_spike(blocks: DataFrame, name: str, period: int, multiplier: float) -> DataFrame:
    """The current bar is part of the mean; false while the mean is not defined."""
    hit = F.col("volume") >= F.col("_volume_mean") * multiplier
    return (
        S.with_averages(blocks, {"_volume_mean": ("volume", period)})
        .withColumn(name, F.coalesce(hit, F.lit(False))).drop("_volume_mean")
    )


def volume_spike(
    bars: DataFrame,
    period: int = C.VOLUME_MA_PERIOD,
    multiplier: float = C.VOLUME_SPIKE_MULTIPLIER,
    size: int = S.BLOCK_ROWS,
) -> DataFrame:
    """Bars whose volume reaches ``multiplier`` times its moving average."""
    blocks = _blocks(bar_columns(bars, "volume"), period - 1, max(size, period))
    return _finish(_with_spike(blocks, "is_spike", period, multiplier), "volume", "is_spike")


def ma_name(kind: str, period: int) -> str:
    return f"{kind}_{period}"


def _with_smas(blocks: DataFrame, periods: Sequence[int]) -> DataFrame:
    return S.with_averages(blocks, {ma_name("sma", p): ("close", p) for p in periods})


def _ema_decays(periods: Sequence[int]) -> list[S.Decay]:
    return [S.span(ma_name("ema", p), "close", p) for p in periods]


def ma_columns(periods: Sequence[int] = C.MA_PERIODS) -> list[str]:
    return [ma_name(kind, p) for p in periods for kind in ("sma", "ema")]


def moving_averages(
    bars: DataFrame, periods: Sequence[int] = C.MA_PERIODS, size: int = S.BLOCK_ROWS
) -> DataFrame:
    """All simple and exponential averages in one pass over the blocks, whatever the periods."""
    decays = _ema_decays(periods)
    inner = S.block_size(decays, size)
    size = S.block_rows(size, inner, *periods)
    blocks = _blocks(_priced(bar_columns(bars, "close")), max(periods) - 1, size, inner)
    out = S.decayed_averages(_with_smas(blocks, periods), decays, size=inner, per_block=size // inner)
    return _finish(out, "close", *ma_columns(periods))


def _all_decays(periods: Sequence[int]) -> list[S.Decay]:
    return [
        *_ema_decays(periods),
        S.span("_fast", "close", C.MACD_FAST),
        S.span("_slow", "close", C.MACD_SLOW),
        *_rsi_decays(C.RSI_PERIOD),
    ]


def with_indicators(
    blocks: DataFrame, periods: Sequence[int] = C.MA_PERIODS, size: int | None = None, per_block: int = 1
) -> DataFrame:
    """Every indicator of a signal as a column of each bar of ``blocks``; all bars have a close."""
    frame = _with_spike(
        _with_smas(_gains(blocks), periods), "volume_spike", C.VOLUME_MA_PERIOD,
        C.VOLUME_SPIKE_MULTIPLIER,
    )
    out = S.decayed_averages(frame, _all_decays(periods), size=size, per_block=per_block)
    out = _with_macd(out, C.MACD_FAST, C.MACD_SLOW, C.MACD_SIGNAL, size, per_block)
    return out.withColumn("rsi", _rsi_value()).drop("_gain", "_loss", "_avg_gain", "_avg_loss")


def indicator_series(
    bars: DataFrame, periods: Sequence[int] = C.MA_PERIODS, size: int = S.BLOCK_ROWS
) -> DataFrame:
    """Every indicator on every bar of the full history."""
    bars = _priced(bar_columns(bars, "open", "high", "low", "close", "volume"))
    windows = (*periods, C.VOLUME_MA_PERIOD, 2)
    inner = S.block_size([*_all_decays(periods), S.span("macd_signal", "macd_line", C.MACD_SIGNAL)], size)
    size = S.block_rows(size, inner, *windows)
    blocks = _blocks(bars, max(windows) - 1, size, inner)
    out = with_indicators(blocks, periods, inner, size // inner)
    return out.where(~F.col("halo")).drop("block", "j", "halo", "sub", "i")
