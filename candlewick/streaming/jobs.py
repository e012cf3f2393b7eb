"""Structured Streaming jobs in place of polling loops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import DataStreamWriter

from candlewick import constants as C
from candlewick.functions import market_time
from candlewick.operators import alerts as AL
from candlewick.operators import signals as SG
from candlewick.operators.prices import bar_scan
from candlewick.operators.resample import tick_order
from candlewick.sources.sinks import read_bars, upsert_bars

LATENESS = "10 minutes"


def minute_bars(ticks: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """1-minute bars of a tick stream; a bar is final ``lateness`` after its minute."""
    return (
        ticks.withWatermark("ts", lateness)
        .withColumn("_order", tick_order())
        .groupBy("ticker", F.window("ts", "1 minute").alias("_minute"))
        .agg(
            F.min_by("price", "_order").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "_order").alias("close"),
            F.sum("size").alias("volume"),
        )
        .select(
            "ticker", F.col("_minute.start").alias("ts"), F.lit("1m").alias("timeframe"),
            "open", "high", "low", "close", "volume",
        )
    )


def daily_bars(bars: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Daily bars of a stream of finer bars; of several bars of one time the lowest opens and the highest closes."""
    return (
        bars.withWatermark("ts", lateness)
        .groupBy("ticker", F.window("ts", "1 day").alias("_day"))
        .agg(
            F.min_by("open", F.struct("ts", "open")).alias("open"), F.max("high").alias("high"),
            F.min("low").alias("low"), F.max_by("close", F.struct("ts", "close")).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select(
            "ticker", F.col("_day.start").alias("ts"), F.lit("1d").alias("timeframe"),
            "open", "high", "low", "close", "volume",
        )
    )


def while_open(rows: DataFrame, both: bool = True) -> DataFrame:
    """Rows whose time falls into a session (of either exchange, or New York only)."""
    is_open = market_time.is_nyse_open(F.col("ts"))
    if both:
        is_open = is_open | market_time.is_tase_open(F.col("ts"))
    return rows.where(is_open)


def fired_in_batch(batch: DataFrame, alerts: DataFrame) -> DataFrame:
    """Active alerts that a batch of prices sets off in New York hours, with the first ``price`` that did and its ``fired_at``.

    Prices and thresholds of a ticker are put in one order, falling for alerts above and rising for those below: the
    earliest time among the prices passed so far is when the alert fired. No alert meets a price by itself, so work
    grows with prices plus alerts, and how the prices are cut into batches changes neither time nor price.
    """
    active = alerts.where("is_active").select(
        "id", "chat_id", "ticker", "alert_type", "threshold", (F.col("alert_type") == AL.ABOVE).alias("above"),
        F.col("threshold").cast("double").alias("at"), F.lit(None).cast("timestamp").alias("ts"))
    # One row per price, combined before the shuffle; tickers that nobody watches stay behind.
    seen = while_open(batch, both=False).where("price IS NOT NULL").join(
        active.select("ticker").distinct(), "ticker", "left_semi").groupBy(
        "ticker", F.col("price").cast("double").alias("at")).agg(F.min("ts").alias("ts"))
    ticks = seen.withColumn("above", F.explode(F.array(F.lit(True), F.lit(False))))
    order = W.partitionBy("ticker", "above").orderBy(
        F.when(F.col("above"), -F.col("at")).otherwise(F.col("at")), F.col("id").isNotNull())
    first = F.min(F.when(F.col("ts").isNotNull(), F.struct("ts", F.col("at").alias("price")))).over(
        order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return active.unionByName(ticks, allowMissingColumns=True).withColumn("first", first).where(
        F.col("id").isNotNull() & F.col("first").isNotNull()).select(
        "id", "chat_id", "ticker", "alert_type", "threshold", "first.price", F.col("first.ts").alias("fired_at"))


def alert_table(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """The newest complete version of an alert table (below ``before``): folders ``version=<n>``, of which each holds all alerts."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(table)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in files.listStatus(folder)]
    done = [int(p.getName().split("=")[1]) for p in found
            if p.getName().startswith("version=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    version = max(v for v in done if before is None or v < before)
    return spark.read.parquet(f"{table}/version={version}")


FIRED = ("id BIGINT, chat_id STRING, ticker STRING, alert_type STRING, threshold DOUBLE, price DOUBLE, fired_at TIMESTAMP, "
         "version BIGINT")


def fired_alerts(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """What fired in one batch, or in all."""
    rows = spark.read.schema(FIRED).parquet(f"{table}_fired")
    return rows if version is None else rows.where(F.col("version") == version)


def alert_writer(prices: DataFrame, table: str, checkpoint: str) -> DataStreamWriter:
    """Switches alerts off as a price stream sets them off, and stamps them; the table is the only state.

    Each batch reads the version before it and writes its own, so a repeated batch gives the same version again, readers
    see whole versions only, and an alert fires once. Nothing is kept per fired alert.
    """

    def write(batch: DataFrame, version: int) -> None:
        spark = batch.sparkSession
        alerts = alert_table(spark, table, version)
        fired_in_batch(batch, alerts).write.mode("overwrite").parquet(f"{table}_fired/version={version}")
        fired = fired_alerts(spark, table, version).groupBy("id").agg(F.min("fired_at").alias("fired_at"))
        alerts.join(fired, "id", "left").withColumns({
            "is_active": F.col("is_active") & F.col("fired_at").isNull(),
            "triggered_at": F.coalesce("fired_at", "triggered_at"),
        }).select(*alerts.columns).write.mode("overwrite").parquet(f"{table}/version={version}")

    return prices.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)


def fresh_stream(
    values: DataFrame, key: str, ttl: int, late: str = "1 hour", order: tuple[str, ...] = ("ts",),
) -> DataFrame:
    """The earliest value of a key in each period of ``ttl`` seconds, with the period's start ``period_ts``.

    Periods and order are those of event time (``order`` settles ties), so the result does not
    depend on how the input is cut into batches, as long as rows arrive at most ``late``.
    A period comes out, and its state ends, once the watermark has passed its end.
    """
    fields = [c for c in values.columns if c != key]
    row, by = F.struct(*fields), F.struct(*order)
    return (
        values.withWatermark("ts", late).groupBy(key, F.window("ts", f"{ttl} seconds").alias("_period"))
        .agg(F.min_by(row, by).alias("_row"))
        .select(key, F.col("_period.start").alias("period_ts"), "_row.*")
    )


def signal_writer(bars: DataFrame, table: str, signals: str, checkpoint: str) -> DataStreamWriter:
    """Merges each batch of bars into the bar table, then writes the newest signals.

    Only tickers of the batch are recomputed, over their lookback. The version
    of a batch names its output, so a repeated batch replaces its own files.
    """

    def write(batch: DataFrame, version: int) -> None:
        spark: SparkSession = batch.sparkSession
        batch = batch.withColumn("_arrival", F.unix_micros("ts"))
        upsert_bars(spark, batch, table, str(version), "_arrival")
        tickers = batch.select("ticker").distinct()
        stored = read_bars(spark, table, with_part=True).join(tickers, "ticker", "left_semi")
        SG.signal_frame(bar_scan(stored, C.LOOKBACK["1d"], "1d")).write.mode("overwrite").parquet(
            f"{signals}/batch={version}"
        )

    return (
        bars.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )


def run_available(
    rows: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet"
) -> None:
    """Runs a stream over what has arrived and stops."""
    query = (
        rows.writeStream.outputMode(mode).format(fmt)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
