"""Indicators on known values and against pandas, with blocks far smaller than the series."""

import numpy as np
import pandas as pd
import pytest

from candlewick.operators import indicators as I
from candlewick.operators import levels as L
from candlewick.operators import series as S

SIMPLE = [10, 11, 12, 11.5, 13, 14, 13.5, 15, 16, 17]
RSI_PRICES = [44.34, 44.09, 44.15, 43.61, 44.33, 44.83, 45.10, 45.15, 43.61, 44.33, 44.83, 45.10,
              45.15, 45.89, 46.23, 46.08, 45.89, 46.03, 45.61, 46.28]


def column(df, name, ticker="A"):
    pdf = df.where(f"ticker = '{ticker}'").orderBy("ts").toPandas()
    return pdf[name].astype(float).tolist()


def same(got, expected, tol=1e-6):
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        if e is None or np.isnan(e):
            assert g is None or np.isnan(g)
        else:
            assert g == pytest.approx(e, rel=tol, abs=tol)


def test_sma_known_values(make_bars):
    got = column(I.sma(make_bars({"A": SIMPLE}), 3), "sma")
    same(got, [np.nan, np.nan, 11, 11.5, 12.166667, 12.833333, 13.5, 14.166667, 14.833333, 16])


def test_ema_known_values(make_bars):
    got = column(I.ema(make_bars({"A": SIMPLE}), 3), "ema")
    same(got, [np.nan, np.nan, 11.25, 11.375, 12.1875, 13.09375, 13.296875, 14.148438, 15.074219, 16.037109])


def test_ema_of_period_one_is_the_price(make_bars):
    same(column(I.ema(make_bars({"A": SIMPLE}), 1), "ema"), SIMPLE)


def test_rsi_known_values(make_bars):
    got = column(I.rsi(make_bars({"A": RSI_PRICES})), "rsi")
    same(got, [np.nan] * 14 + [53.59481, 52.07111, 50.12711, 51.562084, 47.17665, 53.910918], 1e-5)


@pytest.mark.parametrize("values, last", [
    (range(1, 51), 100.0), (range(50, 0, -1), 0.0), ([5.0] * 20, 0.0),
])
def test_rsi_limits(make_bars, values, last):
    assert column(I.rsi(make_bars({"A": list(values)})), "rsi")[-1] == last


def test_rsi_of_zero_is_oversold_but_no_signal(make_bars):
    from candlewick.operators.signals import rsi_bands

    row = rsi_bands(I.rsi(make_bars({"A": range(50, 0, -1)}))).orderBy("ts").tail(1)[0]
    assert row.is_oversold and row.rsi_signal == "NEUTRAL"


def test_macd_of_a_ramp(make_bars):
    df = I.macd(make_bars({"A": range(1, 101)}))
    assert column(df, "macd_line")[-1] == pytest.approx(6.993863, abs=1e-6)
    assert column(df, "macd_signal")[-1] == pytest.approx(6.990976, abs=1e-6)
    assert column(df, "macd_histogram")[-1] == pytest.approx(0.002887, abs=1e-6)
    line = column(df, "macd_line")
    assert np.isnan(line[24]) and not np.isnan(line[25])
    signal = column(df, "macd_signal")
    assert np.isnan(signal[32]) and not np.isnan(signal[33])


def test_moving_averages_of_a_ramp(make_bars):
    df = I.moving_averages(make_bars({"A": range(1, 251)}))
    expected = {20: 240.5, 50: 225.501156, 100: 200.84021, 150: 178.193253, 200: 158.74937}
    for period, value in expected.items():
        assert column(df, f"ema_{period}")[-1] == pytest.approx(value, abs=1e-5)
    sma = column(df, "sma_150")
    assert sma[149] == 75.5 and np.isnan(sma[148])


def test_volume_spike(make_bars):
    volumes = [1_000_000] * 8 + [2_500_000, 3_000_000]
    df = I.volume_spike(make_bars({"A": [1] * 10}, {"A": volumes}), 8, 2.0)
    assert column(df, "is_spike") == [0.0] * 8 + [1.0, 1.0]


def test_periods_below_one_are_refused(make_bars):
    bars = make_bars({"A": SIMPLE})
    for call in (I.sma, I.ema, I.rsi):
        with pytest.raises(ValueError):
            call(bars, 0)


def wilder(s):
    d = s.diff()
    gain = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    loss = (-d).clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    out = 100 - 100 / (1 + gain / loss)
    out[loss == 0] = 100.0
    out[gain == 0] = 0.0
    return out


def average(span):
    return lambda s: s.ewm(span=span, adjust=False, min_periods=span).mean()


def macd_line(s):
    return average(12)(s) - average(26)(s)


@pytest.fixture(scope="module")
def walks():
    """One series holds most rows; others are short, single, flat or start flat."""
    rng = np.random.default_rng(7)
    walk = lambda n: (100 + rng.normal(size=n).cumsum()).tolist()
    return {
        "A": walk(900), "B": walk(1), "C": walk(5), "D": walk(15), "E": [5.0] * 40,
        "F": [7.5] * 30 + walk(60), "G": walk(64), "H": walk(65),
    }


@pytest.mark.parametrize("size", [16, 64, 1024])
@pytest.mark.parametrize("build, name, expected", [
    (lambda b, n: I.sma(b, 10, size=n), "sma", lambda s: s.rolling(10).mean()),
    (lambda b, n: I.ema(b, 12, size=n), "ema", average(12)),
    (lambda b, n: I.ema(b, 2, size=n), "ema", average(2)),
    (lambda b, n: I.rsi(b, size=n), "rsi", wilder),
    (lambda b, n: I.macd(b, size=n), "macd_signal",
     lambda s: macd_line(s).ewm(span=9, adjust=False, min_periods=9).mean()),
    (lambda b, n: I.moving_averages(b, (5, 200), size=n), "ema_200", average(200)),
    (lambda b, n: I.moving_averages(b, (5, 200), size=n), "sma_200", lambda s: s.rolling(200).mean()),
    (lambda b, n: I.indicator_series(b, (5, 9), size=n), "rsi", wilder),
    (lambda b, n: I.indicator_series(b, (5, 9), size=n), "macd_line", macd_line),
    (lambda b, n: L.rolling_range(b, 12, size=n), "range_high", lambda s: s.rolling(12, min_periods=1).max()),
    (lambda b, n: L.rolling_range(b, 12, size=n), "range_low", lambda s: s.rolling(12, min_periods=1).min()),
])
def test_blocks_equal_pandas(make_bars, walks, size, build, name, expected):
    got = build(make_bars(walks), size).toPandas().sort_values("ts")
    for ticker, values in walks.items():
        mine = got[got.ticker == ticker][name].astype(float).tolist()
        same(mine, expected(pd.Series(values, dtype=float)).tolist(), 1e-9)


def test_rsi_keeps_its_value_on_a_long_flat_stretch(make_bars):
    rng = np.random.default_rng(1)
    values = (100 + rng.normal(size=200).cumsum()).tolist()
    values += [values[-1]] * 1500
    got = column(I.rsi(make_bars({"A": values})), "rsi")
    same(got, wilder(pd.Series(values)).tolist(), 1e-9)
    assert got[-1] == pytest.approx(got[250], abs=1e-9)


def test_a_ticker_does_not_depend_on_others(make_bars, walks):
    alone = column(I.rsi(make_bars({"A": walks["A"]}), size=64), "rsi")
    together = column(I.rsi(make_bars(walks), size=64), "rsi")
    same(together, alone, 1e-12)


def test_numbering_spans_calendar_buckets(make_bars):
    got = column(S.number_series(make_bars({"A": range(4000)})), "rn")
    assert got == list(range(4000))


def test_one_hot_series_is_spread_over_blocks(make_bars):
    blocks = S.split_blocks(S.number_series(make_bars({"A": range(3000)})), 10, size=100)
    sizes = blocks.groupBy("ticker", "block").count().toPandas()
    assert len(sizes) == 31 and sizes["count"].max() <= 110


# Flat prices: rounding noise must not decide what is above or below an average.

def moved_then_flat(moved, flat, price=33.37, seed=3):
    rng = np.random.default_rng(seed)
    return (100 + rng.normal(size=moved).cumsum()).tolist() + [price] * flat


@pytest.mark.parametrize("size", [64, 1024])
def test_flat_from_the_start_is_exact(make_bars, size):
    got = I.indicator_series(make_bars({"A": [100.1] * 700}), (20, 200), size=size).orderBy("ts").toPandas()
    for name in ("sma_20", "sma_200", "ema_20", "ema_200"):
        assert set(got[name].dropna()) == {100.1}
    for name in ("macd_line", "macd_signal", "macd_histogram"):
        assert set(got[name].dropna()) == {0.0}


@pytest.mark.parametrize("size", [64, 256, 1024])
@pytest.mark.parametrize("tail", [[], [35.0, 36.5, 34.25]], ids=["flat at the end", "moving again"])
def test_flat_after_movement_and_across_blocks(make_bars, size, tail):
    values = moved_then_flat(300, 1500) + tail
    s = pd.Series(values)
    sma = column(I.sma(make_bars({"A": values}), 20, size=size), "sma")
    assert sma[319:1800] == [33.37] * 1481 == s.rolling(20).mean()[319:1800].tolist()
    same(sma, s.rolling(20).mean().tolist(), 1e-12)
    ema = column(I.ema(make_bars({"A": values}), 20, size=size), "ema")
    same(ema, average(20)(s).tolist(), 1e-12)
    # The average falls towards the price and ends on it; it never gets below.
    assert all(a >= b >= 33.37 for a, b in zip(ema[300:1800], ema[301:1800])) and ema[1799] == 33.37
    macd = I.macd(make_bars({"A": values}), size=size).orderBy("ts").toPandas()
    assert (macd.macd_line[300:1800] <= 1e-9).all() and abs(macd.macd_line[1799]) < 1e-30 or macd.macd_line[1799] == 0
    same(macd.macd_line.tolist(), macd_line(s).tolist(), 1e-11)


def test_momentum_of_flat_prices_has_no_points_from_noise(make_bars):
    from candlewick.operators import signals as SG

    row = SG.with_momentum(SG.signal_snapshot(make_bars({"A": [100.1] * 300}))).collect()[0]
    assert (row["sma_200"], row["macd_histogram"], row["macd_bullish"]) == (100.1, 0.0, False)


@pytest.mark.parametrize("periods", [(2, 1000), (20, 5000)])
def test_any_periods_go_together(spark, periods):
    rng = np.random.default_rng(5)
    values = 100 + rng.normal(size=20_000).cumsum()
    frame = pd.DataFrame({
        "ticker": "A", "timeframe": "1m", "ts": pd.date_range("2024-01-01", periods=20_000, freq="min"), "open": values,
        "high": values, "low": values, "close": values, "volume": 1})
    bars, s = spark.createDataFrame(frame), pd.Series(values)
    for build in (I.moving_averages, I.indicator_series):
        got = build(bars, periods).orderBy("ts").toPandas()
        assert len(got) == 20_000
        for p in periods:
            same(got[f"sma_{p}"].tolist(), s.rolling(p).mean().tolist(), 1e-9)
            same(got[f"ema_{p}"].tolist(), average(p)(s).tolist(), 1e-9)


def test_bars_without_a_close_have_no_place_in_recursive_averages(make_bars):
    values = [float(v) for v in range(1, 41)]
    holes = values[:11] + [None] + values[11:25] + [float("nan")] + values[25:]
    bars = make_bars({"A": [v if v is not None else 0.0 for v in holes]})
    from pyspark.sql import functions as F
    bars = bars.withColumn("close", F.when(F.col("close") != 0, F.col("close")))
    same(column(I.ema(bars, 3), "ema"), column(I.ema(make_bars({"A": values}), 3), "ema"), 1e-12)
    same(column(I.rsi(bars), "rsi"), column(I.rsi(make_bars({"A": values})), "rsi"), 1e-12)
