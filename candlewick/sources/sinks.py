"""Writing market tables: merging bars and appending to parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from candlewick.operators.fundamentals import new_filings
from candlewick.operators.zones import ZONES, zone_rows
from candlewick.sources.schemas import BARS, INSIDER_TRANSACTIONS, MARKET_TABLES

BAR_KEY = ["ticker", "ts", "timeframe"]


def split_bars(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars that keep the table's contract, and rejected ones with the reason.

    Recursive averages weigh bars by position, so a bar without a close has no place in a series.
    """
    missing = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    reason = (
        F.when(F.col("ticker").isNull() | F.col("ts").isNull() | F.col("timeframe").isNull(),
               "no key")
        .when(missing("close"), "no close")
        .when(missing("open") | missing("high") | missing("low") | F.col("volume").isNull(),
              "incomplete")
    )
    marked = bars.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def merge_bars(stored: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """Bars after an upsert: a known bar takes close and volume from the batch,
    an unknown one is added whole. Of several rows for one bar the last by ``order`` counts.
    """
    columns = stored.columns
    if order:
        fields = [c for c in columns if c not in BAR_KEY]
        batch = batch.groupBy(*BAR_KEY).agg(
            F.max_by(F.struct(*fields), order).alias("_row")
        ).select(*BAR_KEY, "_row.*")
    old, new = stored.alias("old"), batch.alias("new")

    def merged(name: str):
        if name in BAR_KEY:
            return F.coalesce(f"old.{name}", f"new.{name}").alias(name)
        known = F.col("old.ticker").isNotNull()
        updated = F.col("new.ticker").isNotNull()
        if name in ("close", "volume"):
            return F.when(updated, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}")).alias(name)
        return F.when(known, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}")).alias(name)

    match = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in BAR_KEY]
    return old.join(new, match, "full_outer").select(*[merged(c) for c in columns])


def to_table_schema(rows: DataFrame, table: str, *keep: str) -> DataFrame:
    """Casts to the types at rest; absent optional columns become NULL."""
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(MARKET_TABLES[table])
    present = set(rows.columns)
    return rows.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target
        ],
        *keep,
    )


LAYOUT = ["timeframe", "part"]


def part_of(ts: str = "ts", timeframe: str = "timeframe") -> Column:
    """Folder of a bar within its bar size: a month of intraday bars, a year of others."""
    intraday = F.col(timeframe).isin("1m", "5m")
    return F.when(intraday, F.date_format(ts, "yyyy-MM")).otherwise(F.date_format(ts, "yyyy"))


#: Rows of one task, and so of one file, when a table is written: about 256 MB of bars.
ROWS_PER_FILE = 6_000_000


def write_series(
    bars: DataFrame, path: str, mode: str = "append", rows: int | None = None, touched: DataFrame | None = None,
) -> None:
    """Bars as they are, by bar size and period, sorted for row-group skipping; then the zone map of the touched folders.

    Range partitioning cuts by rows, so a ticker or period that holds most
    bars is spread over many tasks; ``rows``, where the caller knows their number, sets how many. The map is
    made from the written files, of all folders or of those in ``touched`` (``timeframe, part``).
    """
    order = [*LAYOUT, "ticker", "ts"]
    cut = [-(-rows // ROWS_PER_FILE)] if rows else []
    (
        bars.withColumn("part", part_of())
        .repartitionByRange(*cut, *order)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*LAYOUT)
        .parquet(path)
    )
    refresh_zones(bars.sparkSession, path, touched)


def zones_path(path: str) -> str:
    return f"{path.rstrip('/')}_zones"


def refresh_zones(spark: SparkSession, path: str, touched: DataFrame | None = None) -> None:
    """Makes the zone map of a bar table anew, for all folders or for those in ``touched``."""
    # The type of closes is that of the files; folder names are texts, though "1d" reads as a number.
    close = spark.read.parquet(path).schema["close"].dataType.simpleString()
    bars = spark.read.schema(f"ticker STRING, ts TIMESTAMP, close {close}, timeframe STRING, part STRING").parquet(path)
    if touched is not None:
        bars = bars.join(touched, LAYOUT, "left_semi")
    (
        zone_rows(bars).repartition(*LAYOUT).sortWithinPartitions(*LAYOUT, "ticker")
        .write.mode("overwrite").option("partitionOverwriteMode", "static" if touched is None else "dynamic")
        .partitionBy(*LAYOUT).parquet(zones_path(path))
    )


def read_zones(spark: SparkSession, path: str) -> DataFrame:
    """The zone map; ``operators/zones.py`` says what it holds."""
    return spark.read.schema(ZONES).parquet(zones_path(path))


REJECTS = f"{BARS}, reason STRING"


def write_bars(bars: DataFrame, path: str, mode: str = "append", touched: DataFrame | None = None) -> None:
    """Bars in the types of the bar table; those that break its contract go to the reject table beside it, with the reason."""
    good, rejected = split_bars(to_table_schema(bars, "bars"))
    rejected.write.mode("append").parquet(rejects_path(path))
    write_series(good, path, mode, touched=touched)


def rejects_path(path: str) -> str:
    return f"{path.rstrip('/')}_rejects"


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """Bars that writers of the table turned away so far, with ``reason``."""
    return spark.read.schema(REJECTS).parquet(rejects_path(path))


def read_bars(
    spark: SparkSession, path: str, columns: str = BARS, with_part: bool = False
) -> DataFrame:
    """The bar table; scans that know their period use ``part`` to skip folders."""
    bars = spark.read.schema(f"{columns}, part STRING").parquet(path)
    return bars if with_part else bars.drop("part")


def upsert_bars(spark: SparkSession, batch: DataFrame, path: str, version: str, order: str) -> None:
    """Merge a batch into the folders it touches and replace just those.

    The merged rows go to a staging folder next to the table first, because a
    plan cannot read partitions it overwrites. One writer at a time; ``version``
    names the staging folder, so that a repeated run rewrites the same one.
    """
    batch, rejected = split_bars(to_table_schema(batch, "bars", order))
    rejected.drop(order).write.mode("append").parquet(rejects_path(path))
    touched = batch.select("timeframe", part_of().alias("part")).distinct()
    stored = read_bars(spark, path, with_part=True)
    stored = stored.join(touched, LAYOUT, "left_semi").drop("part")
    staging = f"{path.rstrip('/')}_staging/{version}"
    merge_bars(stored, batch, order).write.mode("overwrite").parquet(staging)
    written = spark.read.schema(BARS).parquet(staging)
    write_series(written, path, "overwrite", touched=written.select("timeframe", part_of().alias("part")).distinct())


def insert_filings(filings: DataFrame, path: str) -> int:
    """Appends filings that are not stored yet and returns how many there were."""
    spark = filings.sparkSession
    stored = spark.read.schema(INSIDER_TRANSACTIONS).parquet(path)
    counted = Observation()
    new = new_filings(stored, filings).observe(counted, F.count(F.lit(1)).alias("inserted"))
    append_rows(new, "insider_transactions", path)
    return counted.get["inserted"]


def append_rows(rows: DataFrame, table: str, path: str) -> None:
    to_table_schema(rows, table).write.mode("append").parquet(path)
