"""Company facts, filings, alerts and market hours."""

import pytest
from pyspark.sql import functions as F

from candlewick.functions import market_time as MT
from candlewick.functions import sql as SQL
from candlewick.operators import alerts as AL
from candlewick.operators import arbitrage as AR
from candlewick.operators import fundamentals as FU


def ts(name):
    return F.col(name).cast("timestamp")


def test_profile_casts_and_fallbacks(spark):
    rows = [("aapl", {"shortName": "Apple", "longName": "", "trailingPE": "29.5", "marketCap": "n/a", "exchange": "NMS"}),
            ("teva.ta", {"currentPrice": "1", "exchange": "TLV", "trailingPE": "x"}),
            ("none", {"longName": "Nothing"})]
    facts = spark.createDataFrame(rows, "ticker STRING, facts MAP<STRING, STRING>")
    good, bad = FU.company_profile(facts)
    got = {r.ticker: r for r in good.collect()}
    a, t = got["AAPL"], got["TEVA.TA"]
    assert (a.name, a.pe_trailing, a.market_cap, a.exchange, a.currency) == ("Apple", 29.5, None, "NASDAQ", "USD")
    assert (t.name, t.pe_trailing, t.exchange, t.currency, t.sector) == ("TEVA.TA", None, "TLV", "ILS", "")
    assert [r.ticker for r in bad.collect()] == ["NONE"]


def test_newest_facts_without_sorting_whole_rows(spark):
    """Every ticker keeps one row, also the one without a name and those without a number; only its newest rows are folded."""
    rows = [("a", 1, {"k": "old"}), ("a", 7, {"k": "new"}), ("a", None, {"k": "none"}), ("a", 7, {"k": "new"}),
            ("b", None, {"k": "x"}), ("b", None, {"k": "y"}), (None, 3, {"k": "nobody"}), (None, 2, None), ("c", 4, None)]
    facts = spark.createDataFrame(rows, "ticker STRING, fact_id BIGINT, facts MAP<STRING, STRING>")
    newest = FU.newest_per_ticker(facts, "fact_id")
    assert newest.columns == ["ticker", "fact_id", "facts"]
    assert sorted(map(tuple, newest.collect()), key=str) == sorted(
        [("a", 7, {"k": "new"}), ("b", None, None), (None, 3, {"k": "nobody"}), ("c", 4, None)], key=str)
    assert FU.newest_per_ticker(facts.limit(0), "fact_id").collect() == []
    # Below the join, from the scan on, nothing is sorted: the aggregation there is one of two narrow columns.
    plan = newest._jdf.queryExecution().sparkPlan().toString()
    folded, _, below = plan.partition("BroadcastHashJoin")
    assert "max_by" in folded and "HashAggregate" in below and "partial_max(fact_id" in below
    assert "Sort" not in below and "max_by" not in below


def test_surprises(spark):
    rows = [("A", 2.40, 2.35, 124.3e9, 123.0e9), ("B", 1.0, None, None, 5.0), ("C", 1.0, 0.0, 4.0, 5.0),
            ("D", None, 1.0, None, 1.0), ("E", -1.0, -2.0, None, None)]
    df = spark.createDataFrame(rows, "ticker STRING, eps_actual DOUBLE, eps_estimate DOUBLE, revenue_actual DOUBLE, revenue_estimate DOUBLE")
    got = {r.ticker: r for r in FU.earnings_surprise(df).collect()}
    assert "D" not in got
    a = got["A"]
    assert (a.eps_surprise_pct, a.revenue_surprise_pct, a.beat_eps, a.beat_revenue) == (2.13, 1.06, True, True)
    assert got["B"].eps_surprise_pct is None and got["B"].beat_eps is None and got["B"].beat_revenue is None
    assert got["C"].eps_surprise_pct is None and got["C"].beat_revenue is False
    assert (got["E"].eps_surprise_pct, got["E"].beat_eps) == (50.0, True)


def filings(spark, rows):
    return spark.createDataFrame(
        rows, "ticker STRING, insider STRING, position STRING, filed STRING, transaction STRING, shares DOUBLE, "
        "value DOUBLE, url STRING, filing_id BIGINT").withColumn("filed_at", ts("filed")).drop("filed")


def test_filings(spark):
    rows = [("a", "I", "", "2024-01-02", "Stock Award", -10.0, -50.0, "", 1), ("a", None, "CEO", "2024-01-03", "Purchase at 5", 0.0, 7.0, "u", 2),
            ("a", "I", None, None, "Buy", 1.0, 1.0, None, 3)]
    got = FU.insider_recent(filings(spark, rows)).orderBy("rank").collect()
    assert [(r.transaction_type, r.shares, r.price_per_share, r.insider_name, r.insider_title, r.filing_url) for r in got] == [
        ("BUY", 0, None, "Unknown", "CEO", "u"), ("SELL", 10, 5.0, "I", None, None)]


def test_ten_filings_are_chosen_before_undated_ones_go(spark):
    rows = [("a", "I", "", f"2024-01-{d:02d}", "Sale", 1.0, 1.0, "", d) for d in range(1, 10)]
    rows += [("a", "I", "", None, "Sale", 1.0, 1.0, "", 100 + d) for d in range(5)]
    assert FU.insider_recent(filings(spark, rows)).count() == 9


def test_only_new_filings_are_kept_once(spark):
    rows = [("a", "I", "", "2024-01-02", "Sale", 5.0, 1.0, "", 1), ("a", "I", "", "2024-01-02", "Sale", -5.0, 2.0, "", 2),
            ("a", "I", "", "2024-01-02", "Sale", 6.0, 2.0, "", 3), ("b", "I", "", "2024-01-02", "Sale", 5.0, 2.0, "", 4)]
    batch = FU.normalised(filings(spark, rows), "filing_id")
    stored = batch.where("ticker = 'B'")
    got = FU.new_filings(stored, batch).orderBy("filing_id").collect()
    assert [(r.ticker, r.shares, r.filing_id) for r in got] == [("A", 5, 1), ("A", 6, 3)]


def test_competitors_and_listings(spark):
    t = spark.createDataFrame([("gilt",), ("zzz",)], "ticker STRING")
    got = [(r.ticker, r.competitor) for r in AR.competitors_of(t).orderBy("ticker", "rank").collect()]
    assert got == [("GILT", "GIL"), ("GILT", "HBI"), ("ZZZ", None)]
    us = spark.createDataFrame([("AMDOCS",), ("AAPL",)], "ticker_us STRING")
    assert {r.ticker_us: r.ticker_tase for r in AR.local_listing(us).collect()} == {"AMDOCS": "DOX.TA", "AAPL": "AAPL.TA"}


ALERTS = "id BIGINT, chat_id STRING, ticker STRING, alert_type STRING, threshold DOUBLE, is_active BOOLEAN, triggered_at TIMESTAMP"


def test_requests_are_validated(spark):
    rows = [(1, "c", " aapl ", "220"), (2, "c", "a1", "5"), (3, "c", "brk-b.", "0"), (4, "c", "^vix", "5"), (5, "c", "x", "NaN"), (6, "c", "x", "five")]
    df = spark.createDataFrame(rows, "request_id BIGINT, chat_id STRING, raw_ticker STRING, raw_price STRING")
    good, bad = AL.validate(df)
    assert [(r.ticker, r.threshold) for r in good.collect()] == [("AAPL", 220.0)]
    assert {r.request_id: r.reason for r in bad.collect()} == {
        2: "invalid ticker", 3: "invalid price", 4: "invalid ticker", 5: "invalid price", 6: "invalid price"}


def test_set_cancel_and_fire(spark):
    alerts = spark.createDataFrame([(1, "c", "A", "PRICE_ABOVE", 5.0, True, None), (2, "c", "B", "PRICE_BELOW", 5.0, True, None),
                                    (3, "d", "A", "PRICE_ABOVE", 10.0, True, None), (4, "c", "A", "PRICE_ABOVE", 1.0, False, None)], ALERTS)
    prices = spark.createDataFrame([("A", 10.0), ("B", 6.0)], "ticker STRING, price DOUBLE")
    asked = spark.createDataFrame([(10, "c", "A", 9.0), (11, "c", "A", 10.0), (12, "c", "Z", 1.0)],
                                  "request_id BIGINT, chat_id STRING, ticker STRING, threshold DOUBLE")
    after = {r.id: r for r in AL.set_alerts(alerts, asked, prices).collect()}
    assert sorted(after) == [1, 2, 3, 4, 11]
    # A threshold equal to the price waits for a fall and fires at once.
    assert not after[1].is_active and after[3].is_active and after[11].alert_type == "PRICE_BELOW"
    fired = AL.triggered(AL.set_alerts(alerts, asked, prices), prices)
    assert sorted(r.id for r in fired.collect()) == [3, 11]
    marked = {r.id: r for r in AL.mark_triggered(alerts, AL.triggered(alerts, prices), F.lit("2024-01-01").cast("timestamp")).collect()}
    assert not marked[1].is_active and marked[1].triggered_at is not None and marked[2].is_active and marked[4].triggered_at is None
    updated, missing = AL.cancel_alerts(alerts, asked)
    assert {r.id for r in updated.where("is_active").collect()} == {2, 3}
    assert [(r.chat_id, r.ticker) for r in missing.collect()] == [("c", "Z")]


@pytest.mark.parametrize("when, nyse, tase", [
    ("2024-01-15 14:30:00", True, True), ("2024-01-15 21:30:00", False, False), ("2024-01-13 14:30:00", False, False),
    ("2024-01-15 10:00:00", False, True), ("2024-01-14 10:00:00", False, False), ("2024-01-13 10:00:00", False, False),
    ("2024-01-15 21:00:00", True, False), ("2024-01-15 21:00:00.000001", False, False),
    ("2024-01-19 13:45:00", False, True), ("2024-01-19 13:46:00", False, False),
    ("2024-07-15 13:30:00", True, True), ("2024-07-15 13:29:59", False, True),
])
def test_market_hours(spark, when, nyse, tase):
    row = spark.createDataFrame([(when,)], "t STRING").select(ts("t").alias("t")).select(
        MT.is_nyse_open(F.col("t")).alias("nyse"), MT.is_tase_open(F.col("t")).alias("tase")).first()
    assert (row.nyse, row.tase) == (nyse, tase)


@pytest.mark.parametrize("when, label, countdown", [
    ("2024-01-15 13:00:00", "pre-market", "Opens in 1h 30m (9:30 AM ET)"), ("2024-01-15 14:29:30", "pre-market", "Opens in 0m (9:30 AM ET)"),
    ("2024-01-15 15:00:00", "", "Open - closes at 4:00 PM ET"), ("2024-01-15 22:00:00", "after-hours", "Closed - reopens tomorrow at 9:30 AM ET"),
    ("2024-01-19 22:00:00", "after-hours", "Closed - reopens Monday 9:30 AM ET"), ("2024-01-13 15:00:00", "", "Closed - reopens Monday 9:30 AM ET"),
])
def test_session_texts(spark, when, label, countdown):
    row = spark.createDataFrame([(when,)], "t STRING").select(ts("t").alias("t")).select(
        MT.session_label(F.col("t")).alias("l"), MT.time_to_nyse_open(F.col("t")).alias("c")).first()
    assert (row.l, row.c) == (label, countdown)


def test_status_row_in_summer(spark):
    row = spark.createDataFrame([("2024-07-19 06:50:00",)], "t STRING").select(MT.market_status(ts("t")).alias("s")).first().s
    assert (row.us_time, row.tase_time) == ("2024-07-19 02:50:00 EDT", "2024-07-19 09:50:00 IDT")
    assert row.tase_preopen and row.tase_friday and not row.tase_open


def test_sql_functions(spark):
    SQL.register(spark)
    row = spark.sql("SELECT is_nyse_open(TIMESTAMP '2024-01-15 14:30:00') a, is_nyse_open(TIMESTAMP '2024-01-13 14:30:00') b, "
                    "momentum_label(79) c, momentum_label(0) d, price_position(150D, 100D, 200D) e, price_position(1D, 1D, 1D) f").first()
    assert list(row) == [True, False, "Strong", "Very Weak", 50.0, 0.0]
