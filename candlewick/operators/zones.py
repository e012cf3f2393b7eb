"""The zone map of a bar table: what each folder holds per ticker, so that newest rows are found without the history.

One row per bar size, folder and ticker: ``bars``, ``first_ts``, ``last_ts``, the two newest bars that have a close, highest and
lowest close. A series has few folders (a year of daily bars, a month of minutes), so the map is a few
hundredths of a percent of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from candlewick.operators.series import KEYS

FOLDER = ("timeframe", "part")
ZONES = (
    "ticker STRING, bars BIGINT, first_ts TIMESTAMP, last_ts TIMESTAMP, last_close_ts TIMESTAMP, last_close DOUBLE, "
    "close_before_ts TIMESTAMP, close_before DOUBLE, high DOUBLE, low DOUBLE, timeframe STRING, part STRING"
)


def zone_rows(bars: DataFrame) -> DataFrame:
    """The map of ``bars`` (with ``part``); NaN closes count as missing."""
    zone = ["ticker", *FOLDER]
    close = F.nanvl(F.col("close").cast("double"), F.lit(None).cast("double"))
    rows = bars.select(*zone, "ts", close.alias("close"))
    figures = rows.groupBy(*zone).agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.max("close").alias("high"), F.min("close").alias("low"))
    rank = F.row_number().over(W.partitionBy(*zone).orderBy(F.desc("ts")))
    newest = rows.where("close IS NOT NULL").withColumn("recency", rank).where("recency <= 2")
    pick = lambda n, c: F.max(F.when(F.col("recency") == n, F.col(c)))
    closes = newest.groupBy(*zone).agg(
        pick(1, "ts").alias("last_close_ts"), pick(1, "close").alias("last_close"),
        pick(2, "ts").alias("close_before_ts"), pick(2, "close").alias("close_before"))
    match = [figures[k].eqNullSafe(closes[k]) for k in zone]
    return figures.join(closes, match, "left").select(*[
        figures[c] if c in figures.columns else closes[c]
        for c in ("ticker", "bars", "first_ts", "last_ts", "last_close_ts", "last_close", "close_before_ts", "close_before",
                  "high", "low", "timeframe", "part")])


def newest(zones: DataFrame, timeframe: str | None = None) -> Column:
    """The newest timestamp of the table (of one bar size), as a scalar subquery over the map."""
    rows = zones if timeframe is None else zones.where(F.col("timeframe") == timeframe)
    return rows.select(F.max("last_ts")).scalar()


def last_closes(zones: DataFrame, timeframe: str = "1d") -> DataFrame:
    """Newest close and the one before it per ticker, from the map alone."""
    pair = lambda name: F.struct(F.col(f"{name}_ts").alias("ts"), F.col(name).alias("close"))
    rows = zones.where(F.col("timeframe") == timeframe).select(
        "ticker", F.inline(F.array(pair("last_close"), pair("close_before")))).where("ts IS NOT NULL")
    rank = F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("ts")))
    pick = lambda n: F.max(F.when(F.col("recency") == n, F.col("close")))
    return rows.withColumn("recency", rank).where("recency <= 2").groupBy("ticker").agg(
        pick(1).alias("last_close"), pick(2).alias("close_before"))


def folders_of_newest(zones: DataFrame, n: int) -> DataFrame:
    """``ticker, timeframe, part`` of the folders that hold the newest ``n`` bars of each series."""
    newer = W.partitionBy(*KEYS).orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    return zones.withColumn("_newer", F.coalesce(F.sum("bars").over(newer), F.lit(0))).where(
        F.col("_newer") < n).select("ticker", *FOLDER)


def newest_rows(bars: DataFrame, zones: DataFrame, n: int) -> DataFrame:
    """The bars (with ``part``) of the folders that hold the newest ``n`` of each series; other folders are not read.

    The folders are known before the scan starts, where they prune it, and each series keeps its own.
    """
    wanted = folders_of_newest(zones, n)
    oldest = wanted.select(F.min("part")).scalar()
    return bars.where(F.col("part") >= oldest).join(wanted, ["ticker", *FOLDER], "left_semi")
