"""The zone map: same rows as without it, folders that need not be read are not, upserts keep it right."""

import datetime as dt
import os
import re

import pytest

import __spark_entry__ as entry
from candlewick.operators import levels as L
from candlewick.operators import prices as P
from candlewick.sources import sinks

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = ("ticker STRING, exchange STRING, ts TIMESTAMP, timeframe STRING, open DOUBLE, high DOUBLE, low DOUBLE, "
          "close DOUBLE, volume BIGINT")


def rows():
    """A running series, one that ended years ago, one whose newest closes are missing, a new one, and monthly bars."""
    start, out = dt.datetime(2018, 1, 1), []
    for ticker, first, n in (("RUN", 0, 1500), ("OLD", 0, 200), ("GAP", 900, 500), ("NEW", 1499, 1)):
        for i in range(first, first + n):
            close = None if ticker == "GAP" and i >= first + n - 40 else 100.0 + (i * 37 % 91)
            out.append((ticker, "X", start + dt.timedelta(days=i), "1d", 1.0, 2.0, 0.5, close, 10 + i))
    out += [("RUN", "X", start + dt.timedelta(days=31 * i), "1mo", 1.0, 2.0, 0.5, float(i), 5) for i in range(30)]
    return out


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zones") / "bars")
    sinks.write_series(spark.createDataFrame(rows(), SCHEMA), path)
    return path


def both(spark, path):
    return sinks.read_bars(spark, path, SCHEMA, with_part=True), sinks.read_zones(spark, path)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_same_rows_with_and_without_the_map(spark, table):
    bars, zones = both(spark, table)
    plain = bars.drop("part")
    assert same(P.last_two_closes(plain), P.last_two_closes(bars, zones=zones))
    assert same(P.last_bar(plain), P.last_bar(bars, zones))
    assert same(P.bar_scan(plain, "6mo"), P.bar_scan(bars, "6mo", zones=zones))
    for window in (2, 30, 252, 5000):
        assert same(L.price_range(plain, window), L.price_range(bars, window, zones))


def test_folders_of_newest_rows(spark, table):
    from candlewick.operators.zones import folders_of_newest

    _, zones = both(spark, table)
    found = {(r["ticker"], r["timeframe"], r["part"]) for r in folders_of_newest(zones, 50).collect()}
    assert {p for t, f, p in found if t == "RUN" and f == "1d"} == {"2021", "2022"}
    assert ("OLD", "1d", "2018") in found and ("NEW", "1d", "2022") in found


def test_upsert_refreshes_the_map_of_its_folders(spark, tmp_path):
    path = str(tmp_path / "bars")
    frame = spark.createDataFrame(rows(), SCHEMA)
    sinks.write_bars(frame, path)
    before = {(r["ticker"], r["part"]): r for r in sinks.read_zones(spark, path).where("timeframe = '1d'").collect()}
    last = max(r[2] for r in rows() if r[0] == "RUN" and r[3] == "1d")
    batch = spark.createDataFrame([("RUN", "X", last, "1d", 1.0, 2.0, 0.5, 7.5, 1, 1),
                                   ("RUN", "X", last + dt.timedelta(days=1), "1d", 1.0, 2.0, 0.5, 8.5, 1, 2)],
                                  SCHEMA + ", arrival INT")
    sinks.upsert_bars(spark, batch, path, "1", "arrival")
    zones = sinks.read_zones(spark, path)
    after = {(r["ticker"], r["part"]): r for r in zones.where("timeframe = '1d'").collect()}
    newest = after[("RUN", str(last.year))]
    assert (newest["last_close"], newest["close_before"]) == (8.5, 7.5)
    assert newest["bars"] == before[("RUN", str(last.year))]["bars"] + 1
    assert {k: v for k, v in after.items() if k[1] != str(last.year)} == {k: v for k, v in before.items() if k[1] != str(last.year)}
    bars, numbers = sinks.read_bars(spark, path), ("ticker", "double(last_close)", "double(close_before)")
    assert same(P.last_two_closes(bars).selectExpr(*numbers).toDF("t", "a", "b"),
                P.last_two_closes(bars, zones=zones).selectExpr(*numbers).toDF("t", "a", "b"))


NEWEST = ("bar_scan last_bar quote_or_close day_change key_metrics range_52w trend fibonacci_levels support_resistance fib_markers "
          "market_snapshot sector_rotation sector_breadth vix_mood best_worst best_momentum rsi_summary compare_pair analyze "
          "close_report open_report alert_triggers signal_snapshot momentum_score watch_rules multi_timeframe live_override").split()


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", NEWEST)
def test_no_query_for_newest_rows_reads_the_history(spark, name):
    """Every scan of the bar table has a filter on its folders; scans of the map are not scans of the table."""
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and re.search(r"/bars-[0-9a-f]+\]", line)]
    for scan in scans:
        assert re.search(r"PartitionFilters: .*\(part#\d+ >= ", scan), scan
