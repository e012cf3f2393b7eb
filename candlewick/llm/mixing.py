"""Mixes sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import stable_uniform, stored

#: Largest mean that is inverted at once; a larger one is a sum of equal parts.
PIECE = 32.0


def source_rates(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7,
    total: float = 1.0, source_col: str = "source",
) -> DataFrame:
    """``src, rate``: how often a document of each source appears on average.

    A source's size is the UTF-8 bytes of its texts plus one per document.
    Its target share is ``weights`` over their sum (sources left out get
    nothing), or else its size to the power ``alpha`` over the sum of those.
    The result holds ``total`` times the size of all sources.
    """
    sized = docs.groupBy(F.col(source_col).alias("src")).agg(
        F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("double") + 1).alias("size"))
    if weights is None:
        target = sized.withColumn("target", F.pow("size", F.lit(alpha)))
    else:
        given = F.lit(0.0)
        for name, weight in weights.items():
            given = F.when(F.col("src") == name, F.lit(float(weight))).otherwise(given)
        target = sized.withColumn("target", given)
    sums = target.agg(F.sum("size").alias("all_size"), F.sum("target").alias("all_target"))
    # One row, so this is no product of two tables.
    return target.join(F.broadcast(sums), F.lit(True)).select(
        "src",
        F.when(F.col("all_target") > 0, F.lit(total) * F.col("all_size") * F.col("target")
               / F.col("all_target") / F.col("size")).otherwise(0.0).alias("rate"),
    )


def poisson_steps(rate: Column) -> Column:
    """Values of the distribution function of a Poisson variable of mean ``rate`` (at most 32), from 0 on."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    return F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("f")),
        lambda acc, k: F.struct(
            (acc["p"] * rate / k).alias("p"),
            F.concat(acc["f"], F.array(F.element_at(acc["f"], -1) + acc["p"] * rate / k)).alias("f")),
        lambda acc: acc["f"],
    )


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.7, total: float = 1.0,
    seed: int = 7, source_col: str = "source",
) -> DataFrame:
    """The columns of ``docs`` under ``row``, and ``copy`` (from 1), in global random order.

    A document is repeated as often as the inverse Poisson distribution of its
    source's rate says at a number that depends on ``seed`` and the id alone, so
    a lost executor's rows come out the same again. Rows of one id get the same
    number of copies each. A null source is a source; a null text has size 0
    and is kept like any other. An empty table gives an empty table; columns of
    ``docs`` keep their names inside ``row``.

    The rates are one row per source, written to the shared folder; their file
    size then lets the planner broadcast them or, over its limit, join by
    source with skewed sources split. Copies are spread by a hash of id, text and
    copy, so a source or text of a third of all rows spreads evenly.
    """
    piece = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    rates = stored(
        source_rates(docs, weights, alpha, total, source_col).select(
            "src", piece.alias("pieces"), poisson_steps(F.col("rate") / piece).alias("steps")),
        "rates")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col(source_col).alias("s"))
    counted = rows.join(rates, rows["s"].eqNullSafe(rates["src"])).select(
        "row", "id",
        F.aggregate(
            F.transform(F.sequence(F.lit(1), F.col("pieces")), lambda k: stable_uniform(seed, F.col("id"), k)),
            F.lit(0),
            lambda n, u: n + F.size(F.filter(F.col("steps"), lambda step: step <= u))).alias("n"))
    copies = counted.where("n > 0").select("row", "id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    mixed = copies.withColumn("order", F.xxhash64(F.lit(seed), "id", F.col("row.text"), "copy"))
    return mixed.repartition("order").sortWithinPartitions("order").select("row", "copy")
