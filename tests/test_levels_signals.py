"""Levels, momentum, watch rules and gaps on known cases."""

import pytest
from pyspark.sql import functions as F

from candlewick.operators import arbitrage as AR
from candlewick.operators import levels as L
from candlewick.operators import prices as P
from candlewick.operators import signals as SG
from candlewick.operators.asof import value_at
from candlewick.operators.percentile import exact_percentile, percentile_sketches, sketched_percentile


def test_levels_of_a_known_range(make_bars):
    row = L.fibonacci_levels(make_bars({"A": range(100, 201)})).first()
    names = ["0_0", "23_6", "38_2", "50_0", "61_8", "78_6", "100_0"]
    assert [row[f"level_{n}"] for n in names] == [200, 176.4, 161.8, 150, 138.2, 121.4, 100]
    assert [row[f"ext_{n}"] for n in ("127_2", "161_8", "261_8")] == [227.2, 261.8, 361.8]
    assert row.trend == "UPTREND" and row.position_pct == 100
    # Nothing above the high: the range end stands in.
    assert row.nearest_support == 176.4 and row.nearest_resistance == 200


def test_support_below_all_levels_is_the_low(make_bars):
    row = L.fibonacci_levels(make_bars({"A": range(200, 99, -1)})).first()
    assert row.nearest_support == 100 and row.nearest_resistance == 121.4
    assert row.trend == "DOWNTREND"


def test_flat_and_single_series_are_rejected(make_bars):
    usable, rejected = L.split_ranges(L.price_range(make_bars({"A": [150.0] * 100, "B": [1.0], "C": [1, 2]})))
    assert [r.ticker for r in usable.collect()] == ["C"]
    assert {r.ticker: r.reason for r in rejected.collect()} == {
        "A": "no price range", "B": "fewer than two bars",
    }


def test_range_looks_at_252_closes(make_bars):
    row = L.price_range(make_bars({"A": [1000.0] + [float(i % 10) for i in range(252)]})).first()
    assert (row.high_52w, row.low_52w, row.bars_seen) == (9.0, 0.0, 252)


@pytest.mark.parametrize("values, trend", [
    ([5] + [9] * 18 + [5], "DOWNTREND"), ([5] + [1] * 18 + [6], "UPTREND"),
    ([9, 5] + [9] * 18 + [6], "UPTREND"), ([3, 2], "DOWNTREND"), ([2, 3], "UPTREND"),
])
def test_trend_compares_with_the_close_19_bars_back(make_bars, values, trend):
    assert L.price_range(make_bars({"A": values})).first().trend == trend
    assert SG.signal_frame(make_bars({"A": values})).first().trend == trend


def signals(spark, **values):
    row = {"ticker": "A", "price": 210.0, "rsi": 65.0, "macd_histogram": 0.5, "volume_spike": True,
           "sma_200": 180.0, "close_before_5": None, **values}
    schema = ("ticker STRING, price DOUBLE, rsi DOUBLE, macd_histogram DOUBLE, volume_spike BOOLEAN, "
              "sma_200 DOUBLE, close_before_5 DOUBLE")
    return spark.createDataFrame([row], schema)


@pytest.mark.parametrize("values, score, label", [
    ({}, 75, "Strong"),
    ({"price": 90.0, "rsi": 28.0, "macd_histogram": -0.3, "volume_spike": False, "sma_200": 120.0}, 0, "Very Weak"),
    ({"rsi": 75.0, "macd_histogram": 1.0, "sma_200": 100.0, "close_before_5": 150.0}, 100, "Very Strong"),
    ({"rsi": None, "sma_200": None, "macd_histogram": None}, 20, "Weak"),
    ({"close_before_5": 208.0}, 75 + 10, "Very Strong"),
    ({"close_before_5": 206.0}, 75 + 15, "Very Strong"),
    ({"close_before_5": 210.0, "rsi": 45.0}, 70, "Strong"),
    ({"close_before_5": 0.0}, 75, "Strong"),
])
def test_momentum(spark, values, score, label):
    row = SG.with_momentum(signals(spark, **values)).first()
    assert (row.momentum, row.momentum_label) == (score, label)


def test_comparison_leaves_the_change_out(spark):
    row = SG.with_momentum(signals(spark, close_before_5=100.0), use_change=False).first()
    assert row.momentum == 75


def test_watch_rules_may_give_two_rows(spark):
    rows = SG.watch_rules(signals(spark, rsi=20.0, macd_histogram=0.01)).collect()
    assert [r.rule for r in rows] == ["bounce", "near_cross"]
    assert SG.watch_rules(signals(spark, rsi=0.0, macd_histogram=0.0)).count() == 0
    assert [r.rule for r in SG.watch_rules(signals(spark, rsi=71.0)).collect()] == ["pullback"]


def test_signal_frame_of_short_series(make_bars):
    frame = SG.signal_frame(make_bars({"A": [1.0], "B": range(1, 14), "C": range(1, 16)}))
    rows = {r.ticker: r for r in frame.collect()}
    assert rows["A"].rsi is None and rows["B"].rsi is None and rows["C"].rsi == 100
    assert rows["A"].volume_spike is False and rows["A"].macd_bullish is False
    assert rows["C"].rsi_signal == "OVERBOUGHT"


def gap(spark, us, local, rate):
    df = spark.createDataFrame([("TEVA", us, local, rate)],
                               "ticker_us STRING, price_us_usd DOUBLE, price_tase_ils DOUBLE, usd_ils_rate DOUBLE")
    return AR.gap_rows(df).first()


def test_gap_cases(spark):
    row = gap(spark, 11.0, 35.0, 3.5)
    assert (row.gap_pct, row.gap_direction, row.is_opportunity) == (10.0, "US_PREMIUM", True)
    row = gap(spark, 9.0, 35.0, 3.5)
    assert (row.gap_pct, row.gap_direction) == (10.0, "TASE_PREMIUM")
    row = gap(spark, 10.0, 35.0, 3.5)
    assert (row.gap_pct, row.gap_direction, row.is_opportunity) == (0.0, "TASE_PREMIUM", False)
    assert gap(spark, 10.0, 10 * 1.004 * 3.5, 3.5).is_opportunity is False


def test_gap_pipeline_rejects_zero_and_falls_back(spark, make_bars):
    bars = make_bars({"TEVA": [0.0, 11.0, 12.0], "TEVA.TA": [35.0, 37.2, 37.2], "X": [1, 2, 3]})
    rates = spark.createDataFrame([("USD/ILS", "2000-01-03 00:00:00", 4.0), ("EUR/ILS", "2000-01-01 00:00:00", 9.0)],
                                  "pair STRING, ts STRING, rate DOUBLE").withColumn("ts", F.col("ts").cast("timestamp"))
    gaps, rejected = AR.arbitrage_gap(bars, rates)
    rows = gaps.orderBy("ts").collect()
    assert [r.usd_ils_rate for r in rows] == [3.72, 4.0] and rows[0].gap_pct == 10.0
    assert [r.price_us_usd for r in rejected.collect()] == [0.0]


def test_value_at_takes_the_last_known(spark):
    moments = lambda rows: spark.createDataFrame(rows, "k STRING, ts STRING, v DOUBLE").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    history = moments([("a", "2024-01-01 10:00:00", 1.0), ("a", "2024-01-03 09:00:00", 3.0), ("b", "2024-01-01 00:00:00", 9.0)])
    asked = ["2023-12-31 00:00:00", "2024-01-01 10:00:00", "2024-01-02 00:00:00", "2024-01-03 08:59:59",
             "2024-01-03 09:00:00", "2024-01-09 00:00:00"]
    got = value_at(moments([("a", t, None) for t in asked]), history, "k", "v").orderBy("ts").collect()
    assert [r.v for r in got] == [None, 1.0, 1.0, 1.0, 3.0, 3.0]


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_percentile_is_exact_on_a_hot_group(spark, share):
    import numpy as np

    rng = np.random.default_rng(3)
    groups = {"hot": rng.integers(0, 5000, 3000).tolist(), "small": [1, 2, 4], "one": [7], "same": [3] * 9}
    df = spark.createDataFrame([(k, int(v)) for k, vs in groups.items() for v in vs], "k STRING, v BIGINT")
    got = {r.k: r.threshold for r in exact_percentile(df, ["k"], "v", share).collect()}
    for k, values in groups.items():
        assert got[k] == pytest.approx(float(np.quantile(values, share)), abs=1e-9)
    if share == 0.9:
        assert got["small"] == pytest.approx(3.6)


def test_day_change_uses_a_positive_previous_close(spark, make_bars):
    quotes = spark.createDataFrame(
        [("A", "2024-01-01 00:00:00", 1, 110.0, 100.0), ("B", "2024-01-01 00:00:00", 2, 110.0, None),
         ("Z", "2024-01-01 00:00:00", 3, 5.0, 0.0)],
        "ticker STRING, ts STRING, event_id BIGINT, last_price DOUBLE, prev_close DOUBLE",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.ticker: (r.pct, r.direction) for r in P.day_change(make_bars({"A": [1, 2], "B": [100, 99], "C": [5]}), quotes).collect()}
    assert got == {"A": (10.0, "up"), "B": (-1.0, "down"), "C": (None, None), "Z": (None, None)}


def test_bar_scan_refuses_unknown_periods(make_bars):
    with pytest.raises(ValueError):
        P.bar_scan(make_bars({"A": [1]}), "9y")


@pytest.mark.parametrize("share", [0.01, 0.5, 0.9, 0.999])
def test_sketched_percentile_keeps_its_rank_error(spark, share):
    rows = spark.range(120_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 5) END AS k", "id % 40 AS part",
        "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN double('NaN') ELSE pow(id % 5003, 2) END AS v")
    got = {r.k: r.threshold for r in sketched_percentile(percentile_sketches(rows, ["k", "part"], "v"), ["k"], share).collect()}
    values = rows.where("v IS NOT NULL AND NOT isnan(v)").toPandas()
    assert set(got) == set(values["k"])
    for key, own in values.groupby("k")["v"]:
        assert (own < got[key]).mean() - 0.01 <= share <= (own <= got[key]).mean() + 0.01


def test_sketched_percentile_of_few_rows_and_none(spark):
    few = spark.createDataFrame([("a", 3.0), ("a", 1.0), ("a", 2.0), ("b", None)], "k STRING, v DOUBLE")
    out = sketched_percentile(percentile_sketches(few, ["k"], "v"), ["k"], 0.5).collect()
    assert [(r.k, r.threshold) for r in out] == [("a", 2.0)]
    assert percentile_sketches(few.where("false"), ["k"], "v").count() == 0
