"""Drops lines that several documents share.

Lines are exploded, normalised and hashed; the distinct documents of each hash
are counted; lines over the threshold go, except in the first document that
holds them; what stays is put together again by position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import hash128, lower_ascii, strip_blanks


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_lines, n_dropped, text``.

    A line's key is the line without blanks at its ends, A to Z lower-cased.
    A key of at least ``min_chars`` code points in at least ``min_docs``
    documents loses all its lines except in the document of the smallest id.

    A null or empty text is one empty line. Rows with the same id are one
    document when keys are counted, and each keeps its own row; a null id is a
    document of its own, which comes last. An empty table gives an empty table.
    Other columns are ignored.

    Only hashes and positions are shuffled by key, combined per (key, document)
    first, so a line of a third of all documents is one row per document at
    most; the join by key that follows is one that adaptive execution splits.
    A text is shuffled once, by document.
    """
    base = docs.select(
        F.col("doc_id"), F.coalesce("text", F.lit("")).alias("body"),
    ).withColumn("version", F.xxhash64("body"))
    line = (
        base.select("doc_id", "version", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
        .select("doc_id", "version", "pos", lower_ascii(strip_blanks(F.col("line"))).alias("norm"))
        .where(F.length("norm") >= min_chars)
        .select("doc_id", "version", "pos", hash128(F.col("norm")).alias("key"))
    )
    shared = (
        line.groupBy("key", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("key").agg(F.count("one").alias("n"), F.min("doc_id").alias("first"))
        .where(F.col("n") >= min_docs).select("key", "first")
    )
    dropped = (
        line.join(shared, "key").where(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v"))
        .agg(F.collect_set("pos").alias("gone"))
    )
    joined = base.join(
        dropped, base["doc_id"].eqNullSafe(dropped["d"]) & (base["version"] == dropped["v"]), "left")
    count = F.size(F.split("body", "\n", -1))
    return joined.select(
        "doc_id",
        count.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        # The lines are bound once (a one-element array), not split again for each position.
        F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.expr("""
            transform(array(split(body, '\\n', -1)), s ->
                array_join(transform(array_except(sequence(0, size(s) - 1), gone), i -> s[i]), '\\n'))[0]
        """)).alias("text"),
    )
