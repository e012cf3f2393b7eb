"""Quality rules: repetition inside a text, and lines that recur across the documents of a host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import hash128, lower_ascii, stored, strip_blanks, words

#: Words in a window whose repetition counts.
WINDOW = 5


def repeated_words(words_column: str) -> Column:
    """Words covered by windows of five words that occur twice or more in the text.

    Windows are hashed; a text without equal hashes is done. Else hashes are
    sorted with their positions, equal neighbours are repeats, and the covered
    words are the steps between their sorted positions, five at most each. A
    value used several times is bound as the element of a one-element array.
    """
    return F.expr(f"""
        transform(array(transform({words_column}, x -> xxhash64(x))), h ->
            if(size(h) <= {WINDOW}, 0,
            transform(array(transform(sequence(0, size(h) - {WINDOW}),
                    i -> xxhash64({', '.join(f'h[i + {j}]' for j in range(WINDOW))}))), g ->
                if(size(array_distinct(g)) = size(g), 0,
                transform(array(array_sort(transform(g, (x, i) -> struct(x AS h, i AS i)))), a ->
                    transform(array(array_sort(transform(
                        filter(a, (x, i) -> coalesce(get(a, i - 1).h = x.h, false)
                                         OR coalesce(get(a, i + 1).h = x.h, false)), x -> x.i))), r ->
                        {WINDOW} + aggregate(
                            zip_with(r, slice(r, 2, size(r)), (p, q) -> if(q IS NULL, 0, least({WINDOW}, q - p))),
                            0, (t, x) -> t + x))[0])[0]))[0]))[0]
    """).cast("long")


def _lines(body: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(body, "\n", -1), lambda line: strip_blanks(line) != "")


def quality(
    docs: DataFrame, host_col: str = "source", min_words: int = 10, max_repeat_percent: int = 20,
    min_docs: int = 20, max_share: float = 0.05, min_left: float = 0.3,
    carry: bool = False,
) -> DataFrame:
    """One row per row of ``docs`` with its measures and the verdict.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, over_chars, over_at, kept, body``. Base rules: fewer than ``min_words``
    words, or more than ``max_repeat_percent`` of the words in repeated windows.
    Line rule: a normalised line is over its limit when more than ``min_docs``
    and more than ``max_share`` of a host's documents hold it. Such lines are
    taken out (``over_at`` has their positions) except in the document of the smallest id;
    a document that keeps less than ``min_left`` of its word characters is rejected.

    Copies of one whole text count as one document of the host: they are the
    business of a later step. A null text is empty and fails by its words; a
    null host is a host. Rows of the same id and text get the same result each.
    An empty table gives an empty table. Other columns are ignored, or come along under
    ``row`` with ``carry``.

    Line hashes are combined per (host, line, text) and then counted, so a line
    or a host of a third of all rows never meets in one task; lines over the
    limit are few (at most ``1 / max_share`` times the lines of a document, per host).
    """
    row = ["row"] if carry else []
    base = docs.select(
        *([F.struct("*").alias("row")] if carry else []), "doc_id", F.col(host_col).alias("host"), F.coalesce("text", F.lit("")).alias("body"),
    ).withColumn("version", F.xxhash64("body"))
    line = (
        base.select("doc_id", "host", "version", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line"))
        .withColumn("norm", lower_ascii(strip_blanks(F.col("line")))).where(F.col("norm") != "")
        .select("doc_id", "host", "version", "pos", hash128(F.col("norm")).alias("key"),
                F.length(F.regexp_replace("norm", "[ \\t-\\r]", "")).alias("chars"))
    )
    per_line = (
        line.groupBy("host", "key", "version").agg(F.min("doc_id").alias("first"))
        .groupBy("host", "key").agg(F.count("*").alias("n"), F.min("first").alias("first"))
        .where(F.col("n") > min_docs)
    )
    per_host = (
        base.groupBy("host", "version").agg(F.lit(1).alias("one"))
        .groupBy(F.col("host").alias("h")).agg(F.count("one").alias("host_docs"))
    )
    # Written first: then its true size is known, and the planner broadcasts it or splits hot lines.
    over = stored(
        per_line.join(per_host, per_line["host"].eqNullSafe(per_host["h"]))
        .where(F.col("n") > F.lit(max_share) * F.col("host_docs"))
        .select(F.col("host").alias("h"), F.col("key").alias("k"), "first"),
        "lines")
    removed = (
        line.join(over, line["host"].eqNullSafe(over["h"]) & (line["key"] == over["k"]))
        .where(~F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("doc_id", "version", "pos").agg(F.first("chars").alias("chars"))
        .groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v"))
        .agg(F.sum("chars").alias("gone_chars"), F.collect_list("pos").alias("gone"))
    )
    measured = (
        base.select(*row, "doc_id", "version", "body", words(F.col("body")).alias("w"),
                    _lines(F.col("body")).alias("full"))
        .select(
            *row, "doc_id", "version", "body",
            F.size("w").cast("long").alias("n_words"),
            F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
            F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
            repeated_words("w").alias("n_repeat_words"),
        )
        .withColumn("base_failed", (F.col("n_words") < min_words)
                    | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))
    )
    joined = measured.join(
        removed, measured["doc_id"].eqNullSafe(removed["d"]) & (measured["version"] == removed["v"]), "left")
    over_chars = F.coalesce("gone_chars", F.lit(0))
    return joined.select(
        *row, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        over_chars.cast("long").alias("over_chars"), F.col("gone").alias("over_at"),
        (~F.col("base_failed")
         & (F.col("word_chars") - over_chars >= F.lit(min_left) * F.col("word_chars"))).alias("kept"),
        "body",
    )


def reject(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the lines over their limit taken out; the columns of ``docs``.

    ``n_chars``, where there is such a column, follows the text. A text that
    loses no line stays as it is.
    """
    checked = quality(docs, carry=True).where("kept")
    text = F.expr("""
        transform(array(split(body, '\\n', -1)), s ->
            array_join(transform(array_except(sequence(0, size(s) - 1), over_at), i -> s[i]), '\\n'))[0]
    """)
    changed = F.col("over_at").isNotNull()
    out = checked.withColumn("cut", F.when(changed, text))
    columns = []
    for name in docs.columns:
        own = F.col("row").getField(name)
        if name == "text":
            own = F.when(changed, F.col("cut")).otherwise(own)
        elif name == "n_chars":
            own = F.when(changed, F.length("cut").cast("long")).otherwise(own)
        columns.append(own.alias(name))
    return out.select(*columns)
