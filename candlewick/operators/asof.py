"""As-of lookup: the last known value at or before a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def value_at(
    times: DataFrame, history: DataFrame, key: str, value: str, bucket: Column | None = None
) -> DataFrame:
    """``value`` of ``history`` at every distinct ``(key, ts)`` of ``times``.

    Rows meet inside calendar buckets (a day unless ``bucket`` says otherwise); what is known at the
    start of a bucket comes from one row per bucket. NULL before the first value.
    """
    bucket = F.to_date("ts") if bucket is None else bucket
    asked = times.select(key, "ts").distinct().withColumns(
        {"_bucket": bucket, "_value": F.lit(None).cast("double"), "_asked": F.lit(1)}
    )
    known = history.select(key, "ts", F.col(value).cast("double").alias("_value")).where(
        F.col("_value").isNotNull()
    ).withColumns({"_bucket": bucket, "_asked": F.lit(0)})
    # Max_by drops NULL order keys, so buckets that only hold questions get NULL.
    answer_ts = F.when(F.col("_asked") == 0, F.col("ts"))
    rows = known.unionByName(asked)
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        rows.groupBy(key, "_bucket").agg(F.max_by("_value", answer_ts).alias("_last"))
        .withColumn("_start", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    )
    inside = W.partitionBy(key, "_bucket").orderBy("ts", "_asked").rowsBetween(
        W.unboundedPreceding, 0
    )
    return (
        rows.withColumn("_value", F.last("_value", ignorenulls=True).over(inside))
        .where(F.col("_asked") == 1)
        .join(starts, [key, "_bucket"], "left")
        .select(key, "ts", F.coalesce("_value", "_start").alias(value))
    )
