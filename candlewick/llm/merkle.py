"""A Merkle manifest of a dataset: leaf, subtree and root digests with a proof of every row."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from candlewick.llm.common import held_fold, stored

#: Children of a node.
FAN = 8
#: Nodes that one window sees: two levels of the tree.
BLOCK = FAN * FAN
#: Equal rows whose copies are made at once.
COPIES = 1000

_DIGEST = "struct<left: string, right: string>"


def field(value: Column) -> Column:
    """``-`` for a null, else UTF-8 byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*[field(F.col(name)) for name in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``position`` from 0 inside each group and the group's ``n``; a row counts ``copies`` times.

    Rows are dealt by ranges of (group, order), which must be unique, so a group
    of any size is spread over many tasks. Each range is numbered by itself and
    starts where the earlier ranges of the group end: those sums are one row per
    range and group in it, that is at most ranges plus groups.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that the bounds of the ranges are drawn once.
    dealt = stored(rows.repartitionByRange(tasks, group, *order).withColumn("range", F.spark_partition_id()), name)
    inside = W.partitionBy("range", group).orderBy(*order)
    local = dealt.withColumn("local", F.sum("copies").over(
        inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("copies"))
    before = W.partitionBy(group).orderBy("range")
    offsets = dealt.groupBy("range", group).agg(F.sum("copies").alias("here")).select(
        F.col("range").alias("at_range"), F.col(group).alias("at_group"),
        F.coalesce(F.sum("here").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        F.sum("here").over(W.partitionBy(group)).alias("n"))
    return local.join(
        offsets, (F.col("range") == F.col("at_range")) & F.col(group).eqNullSafe(F.col("at_group")),
    ).withColumn("position", F.col("offset") + F.col("local")).drop("range", "local", "at_range", "at_group", "offset")


def _level(rows: DataFrame, step: int) -> DataFrame:
    """Adds ``link_<step>`` and ``node_<step + 1>`` of the level whose nodes stand ``FAN ** step`` rows apart in a block.

    Lag and lead columns at fixed offsets reach the siblings; those beyond the
    run's ends (by slot) and beyond the last node (by run length) are masked.
    """
    apart = FAN**step
    ordered = W.partitionBy("group", "block").orderBy("run", "position")
    node = F.col(f"node_{step}")
    index = F.floor(F.col("position") / apart)
    slot = index % FAN
    # Nodes of this level of the block's group, and of the node's run.
    level_nodes = F.ceil(F.col("n") / apart)
    length = F.least(level_nodes - (index - slot), F.lit(FAN))
    names_left = [f"left_{k}" for k in range(1, FAN)]
    names_right = [f"right_{k}" for k in range(1, FAN)]
    reach = rows.withColumns(
        {f"left_{k}": F.lag(node, k * apart).over(ordered) for k in range(1, FAN)}
        | {f"right_{k}": F.lead(node, k * apart).over(ordered) for k in range(1, FAN)})
    left = F.concat(*[F.when(slot >= k, F.col(f"left_{k}")).otherwise("") for k in range(FAN - 1, 0, -1)])
    right = F.concat(*[F.when(slot + k < length, F.col(f"right_{k}")).otherwise("") for k in range(1, FAN)])
    first = F.col("position") % apart == 0
    folded = level_nodes > 1
    reach = reach.withColumn(f"link_{step}", F.when(first & folded, F.struct(left.alias("left"), right.alias("right"))))
    parent = F.when(~folded, node).otherwise(F.sha2(F.concat(node, F.col(f"link_{step}.right")), 256))
    return reach.withColumn(f"node_{step + 1}", F.when(F.col("position") % (apart * FAN) == 0, parent)).drop(
        *names_left, *names_right)


def tree(nodes: DataFrame, largest: int, name: str) -> DataFrame:
    """``group, position``, carried columns, ``top`` (the group's last digest) and ``path`` for nodes ``group, position, n, node_0``.

    ``path`` holds, level by level, the digests left and right of the node's
    ancestor; a level that a group no longer has adds nothing. ``largest`` is
    the largest ``n``. Two levels are made in windows of at most 64 rows; what remains is a
    64th of the rows, goes the same way, and its paths come back by block.
    """
    carried = [c for c in nodes.columns if c not in ("group", "position", "n", "node_0")]
    if largest <= 1:
        return nodes.select("group", "position", *carried, F.col("node_0").alias("top"),
                            F.array().cast(f"array<{_DIGEST}>").alias("path"))
    rows = nodes.withColumns({
        "block": F.floor(F.col("position") / BLOCK), "run": F.floor(F.col("position") / FAN)})
    rows = _level(_level(rows, 0), 1)
    run = W.partitionBy("group", "block", "run").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("link_1", F.first("link_1").over(run))
    own = F.filter(F.array("link_0", "link_1"), lambda link: link.isNotNull())
    if largest <= BLOCK:
        block = W.partitionBy("group", "block").orderBy("run", "position").rowsBetween(
            W.unboundedPreceding, W.currentRow)
        return rows.select("group", "position", *carried, F.first("node_2").over(block).alias("top"), own.alias("path"))
    rows = rows.select("group", "block", "position", "n", *carried, "node_2", own.alias("own"))
    above = stored(rows.where(F.col("position") % BLOCK == 0).select(
        "group", F.col("block").alias("position"), F.ceil(F.col("n") / BLOCK).alias("n"),
        F.col("node_2").alias("node_0")), name)
    upper = tree(above, -(-largest // BLOCK), name).select(
        F.col("group").alias("up_group"), F.col("position").alias("up_block"), "top", F.col("path").alias("up_path"))
    return rows.join(
        upper, F.col("group").eqNullSafe(F.col("up_group")) & (F.col("block") == F.col("up_block")),
    ).select("group", "position", *carried, "top", F.concat("own", "up_path").alias("path"))


def fold(start: Column, path: Column) -> Column:
    """The digest that ``start`` gives when it is hashed upwards between the digests of ``path``."""
    return F.aggregate(path, start, lambda digest, link: F.sha2(F.concat(link["left"], digest, link["right"]), 256))


def proof(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda link: F.concat(link["left"], link["right"])), ""), 256)


def manifest(docs: DataFrame, folds: int = 3) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` per row of ``docs``.

    A leaf is the SHA-256 of ``doc_id, source, lang, n_chars, text``. Per language the
    leaves, by id, are hashed in runs of eight until one digest remains, the
    subroot; the subroots, by language, give the root the same way. Where
    ``crc32`` of the id is a multiple of ``folds`` the text is tampered with (A to Z
    lower-cased) and ``folded_root`` is what the proof makes of that.

    Null ids and null languages come first; a null id counts as an empty text for ``crc32``. Rows of one id are ordered
    by leaf, then by tampered leaf; equal rows get consecutive places, made from their count. An
    empty table gives an empty table. Other columns are not read.

    Only digests are shuffled, never texts. No window holds more than 64 rows but those
    over ranges of rows, so one language may hold any share of them.
    """
    text = F.col("text")
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    leaves = docs.select(
        F.col("lang").alias("group"), "doc_id", F.unhex(leaf_digest(text)).alias("leaf"),
        F.when((held_fold(F.col("doc_id"), folds) == 0) & (lowered != text), F.unhex(leaf_digest(lowered))).alias("altered"),
    ).groupBy("group", "doc_id", "leaf", "altered").agg(F.count(F.lit(1)).alias("copies"))
    # Written once: positions, the sizes of the groups and the tree all start from it.
    placed = stored(numbered(leaves, "group", ["doc_id", "leaf", "altered"], "leaves"), "placed")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    once = placed.where("copies = 1").drop("copies")
    often = placed.where("copies > 1").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES)))).repartition(
        tasks, "group", "leaf", "part").withColumn("copy", F.explode(F.sequence(
            F.col("part") * COPIES, F.least("copies", (F.col("part") + 1) * COPIES) - 1))).withColumn(
        "position", F.col("position") + F.col("copy")).drop("copies", "part", "copy")
    largest = placed.agg(F.max("n")).first()[0] or 0
    nodes = once.unionByName(often).withColumn("node_0", F.lower(F.hex("leaf"))).drop("leaf")
    # The first leaf's digest is needed in the end too, and is shorter to carry as bytes.
    nodes = nodes.withColumn("leaf", F.unhex("node_0"))
    done = tree(nodes, largest, "nodes")
    tops = stored(done.where("position = 0").select(
        F.lit(0).alias("group"), F.col("group").alias("lang"), F.lit(1).alias("copies"), F.col("top").alias("node_0")),
        "subroots")
    langs = tops.count()
    roots = tree(numbered(tops, "group", ["lang"], "languages").drop("copies"), langs, "upper").select(
        "lang", F.col("top").alias("root"), F.col("path").alias("root_path"))
    whole = done.join(roots, F.col("group").eqNullSafe(F.col("lang"))).withColumn("path", F.concat("path", "root_path"))
    return whole.select(
        "doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.col("top").alias("subroot"), "root",
        proof(F.col("path")).alias("proof_sha256"),
        fold(F.lower(F.hex(F.coalesce("altered", "leaf"))), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
