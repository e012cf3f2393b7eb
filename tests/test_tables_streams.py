"""Stored tables, reports at the edges and streaming jobs."""

import datetime as dt

from pyspark.sql import functions as F

from candlewick.operators import prices as P
from candlewick.operators import stored as ST
from candlewick.operators.resample import bars_from_ticks
from candlewick.plans import reports as R
from candlewick.session import shuffle_partitions
from candlewick.sources import sinks
from candlewick.streaming import jobs


def test_upsert_updates_close_and_volume_only(spark, make_bars, tmp_path):
    path = str(tmp_path / "bars")
    stored = make_bars({"A": range(1, 401), "B": [7.0]})
    sinks.write_bars(stored, path)
    batch = spark.createDataFrame(
        [("A", dt.datetime(2000, 1, 1), 50.0, 5, 1), ("A", dt.datetime(2000, 1, 1), 60.0, 6, 2), ("C", dt.datetime(2000, 1, 1), 70.0, 7, 3)],
        "ticker STRING, ts TIMESTAMP, close DOUBLE, volume BIGINT, arrival INT",
    ).withColumn("timeframe", F.lit("1d")).withColumns({c: F.lit(9.0) for c in ("open", "high", "low")})
    for _ in range(2):
        sinks.upsert_bars(spark, batch, path, "1", "arrival")
    after = {(r.ticker, r.ts): r for r in sinks.read_bars(spark, path).collect()}
    assert len(after) == 402
    first = after["A", dt.datetime(2000, 1, 1)]
    assert (float(first.open), float(first.close), first.volume) == (1.0, 60.0, 6)
    added = after["C", dt.datetime(2000, 1, 1)]
    assert (float(added.open), float(added.close), added.volume) == (9.0, 70.0, 7)
    assert float(after["A", dt.datetime(2001, 1, 1)].close) == 367.0


def test_filters_reach_the_bar_table(spark, make_bars, tmp_path):
    path = str(tmp_path / "bars")
    sinks.write_bars(make_bars({"A": range(1, 800)}), path)
    df = sinks.read_bars(spark, path).where("timeframe = '1d' AND ticker = 'A' AND ts > TIMESTAMP '2001-06-01'").select("close")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(timeframe" in plan and "GreaterThan(ts" in plan and "EqualTo(ticker,A)" in plan
    assert "volume" not in plan.split("ReadSchema")[1]


def test_appended_rows_take_the_stored_types(spark, tmp_path):
    path = str(tmp_path / "gaps")
    gaps = spark.createDataFrame([("TEVA", "TEVA.TA", dt.datetime(2024, 1, 1), 8.8, 32.5, 3.7, 8.7838, 0.185, "TASE_PREMIUM")],
                                 "ticker_us STRING, ticker_tase STRING, ts TIMESTAMP, price_us_usd DOUBLE, price_tase_ils DOUBLE, "
                                 "usd_ils_rate DOUBLE, price_tase_in_usd DOUBLE, gap_pct DOUBLE, gap_direction STRING")
    for _ in range(2):
        sinks.append_rows(gaps, "dual_listing_gaps", path)
    got = spark.read.parquet(path)
    assert got.count() == 2 and dict(got.dtypes)["gap_pct"] == "decimal(8,4)"
    assert got.first().gap_direction == "TASE_PREMIUM"


def partition_filters(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(part.split("PushedFilters")[0] for part in plan.split("PartitionFilters")[1:])


def test_scans_skip_folders_outside_their_period(spark, make_bars, tmp_path):
    path = str(tmp_path / "bars")
    sinks.write_bars(make_bars({"A": range(1, 2000)}), path)
    bars = sinks.read_bars(spark, path, with_part=True)
    df = P.bar_scan(bars, "6mo")
    # 22 December 2004 to 21 June 2005.
    assert df.count() == 10 + 151 + 21 and "part" not in df.columns
    assert "(part#" in partition_filters(df)
    fixed = P.bar_scan(bars, "6mo", as_of=F.lit("2001-03-01").cast("timestamp"))
    assert fixed.count() == 181 and ">= 2000)" in partition_filters(fixed)
    assert ST.price_query(bars, "a", "2001-02-01", "2001-02-10").count() == 10


def test_insert_counts_only_new_filings(spark, tmp_path):
    path = str(tmp_path / "filings")
    rows = [("A", "I", None, dt.datetime(2024, 1, d), "BUY", d, 1.0, float(d), None, d) for d in (1, 2, 2)]
    schema = ("ticker STRING, insider_name STRING, insider_title STRING, transaction_date TIMESTAMP, transaction_type STRING, "
              "shares BIGINT, price_per_share DOUBLE, total_value DOUBLE, filing_url STRING, filing_id INT")
    filings = spark.createDataFrame(rows, schema)
    sinks.append_rows(filings.limit(0), "insider_transactions", path)
    assert sinks.insert_filings(filings, path) == 2
    assert sinks.insert_filings(filings, path) == 0
    assert spark.read.parquet(path).count() == 2


def test_bars_without_a_close_are_rejected(spark, make_bars):
    bars = make_bars({"A": [1.0, float("nan"), 3.0]})
    bars = bars.withColumn("open", F.when(F.col("close") == 3, None).otherwise(F.lit(1.0)))
    good, bad = sinks.split_bars(bars.withColumn("high", F.lit(1.0)).withColumn("low", F.lit(1.0)))
    assert [r.close for r in good.collect()] == [1.0]
    assert sorted(r.reason for r in bad.collect()) == ["incomplete", "no close"]


def test_shuffle_partitions_follow_the_volume():
    assert shuffle_partitions(10**9) == 200 and shuffle_partitions(10**13) == 74506


def test_json_rows(spark):
    df = spark.createDataFrame([(1, "x")], "a INT, b STRING")
    assert ST.json_rows(df).first().json == '{"a":1,"b":"x"}'


def watch_rows(spark, rows):
    return spark.createDataFrame(rows, "pos INT, ticker STRING, pct DOUBLE, rsi DOUBLE, price DOUBLE, momentum INT, momentum_label STRING")


def test_summaries_of_a_watchlist(spark):
    rows = watch_rows(spark, [(0, "A", 0.0, 70.0, 1.0, 40, "Neutral"), (1, "B", 2.0, 70.1, 1.0, 60, "Strong"), (2, "C", 2.0, 0.0, 1.0, 60, "Strong"),
                              (3, "D", -1.0, 29.0, 1.0, 0, "Very Weak"), (4, "E", None, None, None, 0, "Very Weak")])
    assert list(R.best_worst(rows).first()) == ["B", 2.0, "D", -1.0]
    assert list(R.best_momentum(rows).first()) == ["B", 60, "Strong"]
    assert list(R.rsi_summary(rows).first()) == [1, 1, 3]
    assert list(R.best_worst(rows.where("pos = 0")).first()) == [None, None, None, None]


TICKS = "event_id BIGINT, ticker STRING, ts TIMESTAMP, price DOUBLE, size BIGINT"


def write_ticks(spark, path, rows):
    spark.createDataFrame(rows, TICKS).coalesce(1).write.mode("append").parquet(str(path))


def at(second):
    return dt.datetime(2024, 1, 16, 15, 0) + dt.timedelta(seconds=second)


def stream(spark, path):
    return spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    rows = [(i, "AB"[i % 2], at(7 * i), float((i * 37) % 101), i) for i in range(300)]
    for part in range(3):
        write_ticks(spark, tmp_path / "ticks", rows[part * 100:(part + 1) * 100])
    jobs.run_available(jobs.minute_bars(stream(spark, tmp_path / "ticks")), str(tmp_path / "out"), str(tmp_path / "check"))
    final = at(7 * 299 - 600)
    batch = bars_from_ticks(spark.read.parquet(str(tmp_path / "ticks"))).where(F.col("ts") + F.expr("INTERVAL 1 MINUTE") <= F.lit(final))
    columns = ["ticker", "ts", "open", "high", "low", "close", "volume"]
    got = spark.read.parquet(str(tmp_path / "out")).select(columns).orderBy("ticker", "ts").collect()
    assert got == batch.select(columns).orderBy("ticker", "ts").collect() and len(got) > 20


ALERTS = ("id BIGINT, chat_id STRING, ticker STRING, alert_type STRING, threshold DOUBLE, is_active BOOLEAN, "
          "triggered_at TIMESTAMP")


def alerts_after(spark, folder, batches, alerts):
    """The alert table and what fired, after a stream of so many batches."""
    for rows in batches:
        write_ticks(spark, folder / "t", rows)
    ticks = spark.readStream.schema(spark.read.parquet(str(folder / "t")).schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "t"))
    table = str(folder / "alerts")
    spark.createDataFrame(alerts, ALERTS).write.parquet(f"{table}/version=-1")
    jobs.alert_writer(ticks, table, str(folder / "check")).trigger(availableNow=True).start().awaitTermination()
    key = lambda r: r["id"]
    return (sorted(jobs.alert_table(spark, table).collect(), key=key),
            sorted(jobs.fired_alerts(spark, table).drop("version").collect(), key=key))


def test_an_alert_fires_once_and_only_while_open(spark, tmp_path):
    night = dt.datetime(2024, 1, 16, 3, 0)
    alerts = [(1, "c", "A", "PRICE_ABOVE", 100.0, True, None), (2, "c", "A", "PRICE_ABOVE", 50.0, False, None),
              (3, "c", "B", "PRICE_BELOW", 0.5, True, None)]
    table, fired = alerts_after(spark, tmp_path, [
        [(1, "A", night, 100.0, 1)], [(2, "A", at(0), 99.0, 1), (3, "A", at(1), 100.0, 1)],
        [(4, "A", at(2), 101.0, 1), (5, "B", at(2), 1.0, 1)]], alerts)
    assert [(r.id, r.price, r.fired_at) for r in fired] == [(1, 100.0, at(1))]
    assert [(r.id, r.is_active, r.triggered_at) for r in table] == [(1, False, at(1)), (2, False, None), (3, True, None)]


def test_alerts_do_not_depend_on_the_batches(spark, tmp_path):
    rows = [(i, "AB"[i % 2], at(5 * i), float((i * 37) % 101), 1) for i in range(120)]
    alerts = [(i, "c", "ABC"[i % 3], ("PRICE_ABOVE", "PRICE_BELOW")[i % 2], float(i % 110), i % 7 > 0, None) for i in range(200)]
    expected = {}
    for i, _, ticker, kind, limit, active, _ in alerts:
        hits = [(r[2], r[3]) for r in rows if active and r[1] == ticker and (r[3] >= limit if kind == "PRICE_ABOVE" else r[3] <= limit)]
        if hits:
            expected[i] = min(hits)
    for name, size in (("one", 120), ("many", 30)):
        table, fired = alerts_after(spark, tmp_path / name, [rows[k:k + size] for k in range(0, 120, size)], alerts)
        assert {r.id: (r.fired_at, r.price) for r in fired} == expected and len(fired) == len(expected)
        assert all(r.is_active == (alerts[r.id][5] and r.id not in expected) for r in table)
        assert {r.id: r.triggered_at for r in table if r.triggered_at} == {i: t for i, (t, _) in expected.items()}


def test_alert_work_does_not_grow_with_prices_times_alerts(spark):
    """No join of prices with alerts but the one that keeps watched tickers."""
    ticks = spark.createDataFrame([(1, "A", at(0), 1.0, 1)], "event_id BIGINT, ticker STRING, ts TIMESTAMP, price DOUBLE, size BIGINT")
    alerts = spark.createDataFrame([], ALERTS)
    plan = jobs.fired_in_batch(ticks, alerts)._jdf.queryExecution().optimizedPlan().toString()
    assert [line.strip().split("Join ")[1].split(",")[0] for line in plan.splitlines() if "Join " in line] == ["LeftSemi"]


def test_rejected_bars_are_kept_with_the_reason(spark, tmp_path):
    path, day = str(tmp_path / "bars"), dt.datetime(2024, 1, 2)
    bars = spark.createDataFrame(
        [("A", day, "1d", 1.0, 2.0, 0.5, 1.5, 10), ("A", day, "1d", 1.0, 2.0, 0.5, None, 10), (None, day, "1d", 1.0, 2.0, 0.5, 1.5, 10),
         ("B", day, "1d", 1.0, None, 0.5, 1.5, 10)],
        "ticker STRING, ts TIMESTAMP, timeframe STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT")
    sinks.write_bars(bars, path)
    assert [r.ticker for r in sinks.read_bars(spark, path).collect()] == ["A"]
    assert sorted((str(r.ticker), r.reason) for r in sinks.read_rejects(spark, path).collect()) == [
        ("A", "no close"), ("B", "incomplete"), ("None", "no key")]


def test_repeats_within_the_time_to_live_are_dropped(spark, tmp_path):
    write_ticks(spark, tmp_path / "t", [(1, "A", at(0), 1.0, 1)])
    write_ticks(spark, tmp_path / "t", [(2, "A", at(30), 2.0, 1), (3, "B", at(30), 9.0, 1)])
    write_ticks(spark, tmp_path / "t", [(4, "A", at(500), 3.0, 1)])
    write_ticks(spark, tmp_path / "t", [(5, "A", at(505), 4.0, 1), (6, "A", at(9000), 5.0, 1)])
    jobs.run_available(jobs.fresh_stream(stream(spark, tmp_path / "t"), "ticker", 60), str(tmp_path / "out"), str(tmp_path / "check"))
    got = {(r.ticker, r.price) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("A", 1.0), ("B", 9.0), ("A", 3.0)}


def test_fresh_periods_do_not_depend_on_the_batches(spark, tmp_path):
    rows = [(i, "AB"[i % 2], at(i * 17), float(i), 1) for i in range(60)]
    # The last one only moves the watermark past the periods of the others.
    closing = [(60, "C", at(9000), 0.0, 1)]
    write_ticks(spark, tmp_path / "one", rows + closing)
    for k in range(4):
        write_ticks(spark, tmp_path / "four", rows[15 * k : 15 * k + 15] + (closing if k == 3 else []))
    got = []
    for name in ("one", "four"):
        out = jobs.fresh_stream(stream(spark, tmp_path / name), "ticker", 60).select("ticker", "period_ts", "price")
        jobs.run_available(out, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-check"))
        got.append(sorted(map(tuple, spark.read.parquet(str(tmp_path / f"{name}-out")).collect())))
    assert got[0] == got[1] and len(got[0]) == len({(r[1], r[2].replace(second=0)) for r in rows})
    first = {}
    for r in rows:
        first.setdefault((r[1], r[2].replace(second=0, microsecond=0)), r[3])
    assert {(t, p): price for t, p, price in got[0]} == first


def test_streams_read_a_table_that_is_a_folder(spark, tmp_path):
    from candlewick.plans.registry import LANDED, _event_stream
    rows = [(i, at(i), i % 5, "view", float(i), '{"k": 1}') for i in range(30)]
    spark.createDataFrame(rows, LANDED["events"]).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    jobs.run_available(_event_stream(spark, str(tmp_path)), str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(str(tmp_path / "events.parquet")).count()
