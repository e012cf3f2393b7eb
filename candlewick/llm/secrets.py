"""Finds secrets in texts, and links the parts of credentials that are told apart only by their company."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from candlewick.llm.common import stored

#: Spans that are reported by themselves, in the order of their kinds: pattern, group measured, its least length.
STRONG = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # the same matches as runs of any length with the short ones dropped
}
#: Weak candidates: an identifier, a secret or an endpoint that means nothing alone.
WEAK = {
    "weak_id": (r"""(?i:access_?key_?id|client_?id|user_?name|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 1, 4),
    "weak_secret": (r"""(?i:secret_?key|private_?key|credential|passphrase|pwd|auth)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "endpoint": (r"""(?i:https?|jdbc:[a-z]+|wss?|ftp)://([^\x20\t-\r"'<>]+)""", 1, 4),
}
KINDS = [*STRONG, *WEAK]
#: The role of each kind, and the roles that must lie near a weak candidate.
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
NEEDS = {"weak_id": ["secret"], "weak_secret": ["id"], "endpoint": ["id", "secret"]}


def _gate(kind: str, body: Column) -> Column:
    """False for most texts that have no match; true for every text that has one."""
    lower = F.lower(body)
    if kind == "assign":
        return reduce(Column.__or__, [F.contains(lower, F.lit(w)) for w in
                                      ("password", "passwd", "secret", "token", "apikey", "api_key")])
    if kind == "access":
        return F.contains(body, F.lit("AKIA"))
    if kind == "endpoint":
        return F.contains(body, F.lit("://"))
    if kind in WEAK:
        return F.contains(body, F.lit("=")) | F.contains(body, F.lit(":"))
    return body.rlike(STRONG[kind][0])


def _matches(kind: str, body: Column) -> Column:
    """Per match the code points before it since the last one, its own, and those of the measured group."""
    pattern, group, _ = (STRONG | WEAK)[kind]
    found = F.arrays_zip(
        F.transform(F.split(body, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(0)), lambda x: F.length(x)).alias("len"),
        F.transform(F.regexp_extract_all(body, F.lit(pattern), F.lit(group)), lambda x: F.length(x)).alias("part"),
    )
    return F.when(_gate(kind, body), found)


def secret_spans(docs: DataFrame, radius: int = 200) -> DataFrame:
    """``doc_id, version, kind, start, end``: all spans of all texts, in code points, end exclusive.

    Strong kinds are matched by themselves, leftmost and without overlap per
    kind. Weak candidates are matched the same way and reported where every
    role they need (``NEEDS``) occurs within ``radius`` characters of them in
    the same text, weak or strong, and where they overlap no strong span.

    The neighbourhood test is an interval join: each part is entered in every
    bin of ``radius`` characters that it covers; bins keep the least start and
    the greatest end per role; a candidate looks up the bins of its reach.
    That is linear in the number of parts, and exact.

    Spans are found per (id, text), so repeated rows are searched once. A null
    text has no spans; a null id is an id. Only texts with a match leave the
    scan, as lengths. The rows of one text are the largest group anywhere.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body"))
    found = base.select("doc_id", F.xxhash64("body").alias("version"),
                        *[_matches(kind, F.col("body")).alias(kind) for kind in KINDS])
    some = reduce(Column.__or__, [F.size(F.coalesce(F.col(kind), F.array())) > 1 for kind in KINDS])
    # Written, so that the texts are scanned once for all kinds and all later steps.
    per_text = stored(
        found.where(some).groupBy("doc_id", "version").agg(*[F.first(kind).alias(kind) for kind in KINDS]), "matches")
    match = reduce(DataFrame.unionByName, [
        per_text.where(F.size(kind) > 1).select(
            "doc_id", "version", F.lit(kind).alias("kind"), F.posexplode(kind).alias("k", "m"),
            F.lit((STRONG | WEAK)[kind][2]).alias("least"))
        for kind in KINDS])
    order = W.partitionBy("doc_id", "version", "kind").orderBy("k")
    placed = match.select(
        "doc_id", "version", "kind", "least", F.col("m.len").alias("len"), F.col("m.part").alias("part"),
        (F.sum(F.col("m.gap") + F.coalesce("m.len", F.lit(0))).over(order) - F.coalesce("m.len", F.lit(0))).alias("start"),
    ).where(F.col("part") >= F.col("least")).select(
        "doc_id", "version", "kind", "start", (F.col("start") + F.col("len")).alias("end"))

    ahead = W.partitionBy("doc_id", "version").orderBy("start", "end").rowsBetween(W.unboundedPreceding, W.currentRow)
    behind = W.partitionBy("doc_id", "version").orderBy("start", "end").rowsBetween(W.currentRow, W.unboundedFollowing)
    strong = F.col("kind").isin(*STRONG)
    parts = placed.withColumn("reached", F.max(F.when(strong, F.col("end"))).over(ahead)).withColumn(
        "next", F.min(F.when(strong, F.col("start"))).over(behind)
    ).where(strong | ((F.coalesce("reached", F.lit(0)) <= F.col("start"))
                      & (F.coalesce("next", F.col("end")) >= F.col("end"))))

    role = F.element_at(F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair]), F.col("kind"))
    bins = parts.select(
        F.col("doc_id").alias("d"), F.col("version").alias("v"), role.alias("role"), "start", "end",
        F.explode(F.sequence(F.floor(F.col("start") / radius), F.floor((F.col("end") - 1) / radius))).alias("bin"),
    ).groupBy("d", "v", "role", "bin").agg(F.min("start").alias("low"), F.max("end").alias("high"))
    needs = F.create_map(*[x for kind, roles in NEEDS.items() for x in (F.lit(kind), F.array(*map(F.lit, roles)))])
    reach = parts.where(~strong).select(
        "doc_id", "version", "kind", "start", "end", F.element_at(needs, F.col("kind")).alias("needed"),
        F.explode(F.sequence(F.floor((F.col("start") - radius) / radius),
                             F.floor((F.col("end") + radius) / radius))).alias("b"))
    linked = reach.join(
        bins, reach["doc_id"].eqNullSafe(bins["d"]) & (reach["version"] == bins["v"]) & (reach["b"] == bins["bin"])
        & F.array_contains("needed", F.col("role"))
        & (bins["high"] >= reach["start"] - radius) & (bins["low"] <= reach["end"] + radius),
    ).groupBy("doc_id", "version", "kind", reach["start"], reach["end"]).agg(
        F.count_distinct("role").alias("roles"), F.first(F.size("needed")).alias("wanted"),
    ).where("roles = wanted").select("doc_id", "version", "kind", "start", "end")
    return placed.where(strong).unionByName(linked)


def secrets(docs: DataFrame, radius: int = 200) -> DataFrame:
    """``doc_id, spans`` for each row of ``docs``; ``spans`` are structs ``start, rank, kind, end`` in order.

    ``rank`` is the place of the kind in ``KINDS``. No spans: an empty array.
    An empty table gives an empty table; other columns are ignored.
    """
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    per_text = secret_spans(docs, radius).groupBy(F.col("doc_id").alias("d"), F.col("version").alias("v")).agg(
        F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    base = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"))
    return base.join(
        per_text, base["doc_id"].eqNullSafe(per_text["d"]) & (base["version"] == per_text["v"]), "left",
    ).select("doc_id", F.coalesce(
        "spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
