"""Exact percentiles per group without gathering a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_SLICES_PER_DOUBLING = 16


def exact_percentile(
    rows: DataFrame, keys: list[str], value: str, share: float, name: str = "threshold"
) -> DataFrame:
    """Continuous percentile of a non-negative number per group.

    Equal values are counted before the shuffle. Running counts are taken inside
    slices of the value range and shifted by the size of lower slices, so a group
    that holds most rows is still spread over many tasks.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n")
    )
    slice_of = F.floor(F.log2(F.col(value) + 1) * _SLICES_PER_DOUBLING)
    counts = counts.withColumn("_slice", slice_of)
    whole = W.partitionBy(*keys)
    lower = whole.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = (
        counts.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_size"))
        .withColumn("_below", F.coalesce(F.sum("_size").over(lower), F.lit(0)))
        .withColumn("_total", F.sum("_size").over(whole))
        .drop("_size")
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(value)
    target = (F.col("_total") - 1) * F.lit(share)
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1
    holds = lambda rank: (first <= rank) & (rank <= last)
    ranked = (
        counts.withColumn("_run", F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .join(slices, [*keys, "_slice"])
        .withColumn("_upto", F.col("_below") + F.col("_run"))
        .withColumn("_target", target)
        .withColumn("_lo", F.floor("_target"))
        .withColumn("_hi", F.ceil("_target"))
        .where(holds(F.col("_lo")) | holds(F.col("_hi")))
    )
    at = lambda rank: F.max(F.when(holds(F.col(rank)), F.col(value))).cast("double")
    return (
        ranked.groupBy(*keys)
        .agg(at("_lo").alias("_a"), at("_hi").alias("_b"),
             F.max(F.col("_target") - F.col("_lo")).alias("_w"))
        .select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias(name))
    )


#: Size of a sketch: ranks are off by 0.4 % of the rows in 99 of 100 sketches (rank error falls as 1 / SKETCH).
SKETCH = 800


def percentile_sketches(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``keys, sketch``: a KLL sketch of the values of each group; NULL and NaN are left out.

    A sketch is at most some 20 kB whatever the group holds, and is built before the shuffle. Kept per
    group and folder, sketches of new folders are merged with stored ones instead of reading history again.
    """
    number = F.col(value).cast("double")
    return rows.where(number.isNotNull() & ~F.isnan(number)).groupBy(*keys).agg(
        F.kll_sketch_agg_double(number, F.lit(SKETCH)).alias("sketch"))


def sketched_percentile(sketches: DataFrame, keys: list[str], share: float, name: str = "threshold") -> DataFrame:
    """An approximate percentile per group from sketches of its parts: a value of the group whose rank is near ``share``."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("_merged"))
    return merged.select(*keys, F.kll_sketch_get_quantile_double("_merged", F.lit(share)).alias(name))
