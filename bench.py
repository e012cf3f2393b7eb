"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from candlewick.plans.registry import QUERIES
from candlewick.session import session

HEADLINE = (
    "daily_bars", "bar_scan", "sma", "ema", "rsi", "macd", "volume_spike", "moving_averages",
    "rolling_range", "chart_series", "signal_snapshot", "momentum_score", "fibonacci_levels",
    "volume_top_decile", "resample_bars", "multi_timeframe", "tick_bars", "arbitrage_gap",
    "bar_upsert", "sentiment_report", "top_headlines", "feed_merge_greedy", "insider_recent",
    "earnings_surprise", "alert_triggers", "market_snapshot", "compare_pair", "analyze",
    "close_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The session and the stored bars are warm before the first timing; the cost of
    # building bars is timed by ``daily_bars``.
    QUERIES["last_bar"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline query seconds", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
