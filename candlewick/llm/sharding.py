"""Uniformly random shards of exactly equal counts, through a drawn communication matrix."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from candlewick.llm.common import stored

#: Finest division of the rows into parts; parts are unions of these slots.
SLOTS = 4096
#: Copies of a row that are made at once where one row is very frequent.
BLOCK = 1000


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """Good items among ``drawn`` of ``good + bad`` drawn without putting back.

    Inversion from the mode outwards, so the steps are of the order of the
    standard deviation.
    """
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))

    def choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    u = rng.random() - at_mode
    if u < 0:
        return mode
    up = down = mode
    p_up = p_down = at_mode
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            u -= p_up
            if u < 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            u -= p_down
            if u < 0:
                return down
    return mode  # what rounding has left of the distribution's mass


def communication_matrix(parts: list[int], shards: int, seed: int) -> list[list[int]]:
    """How many rows of each part go to each shard: a draw of the matrix that a uniform shuffle induces.

    Row sums are ``parts``; column sums are equal, the first ones one larger if they must be.
    """
    rng = random.Random(seed)
    total = sum(parts)
    room = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = []
    for size in parts:
        left, capacity, row = size, sum(room), []
        for j in range(shards):
            capacity -= room[j]
            n = hypergeometric(rng, room[j], capacity, left)
            row.append(n)
            left -= n
            room[j] -= n
        matrix.append(row)
    return matrix


def shard(
    docs: DataFrame, shards: int = 24, seed: int = 11, rows_per_part: int = 2000, carry: bool = True,
) -> DataFrame:
    """``row`` (all columns of ``docs``, with ``carry``), ``doc_id, size, text_crc32, shard, slot``.

    Shards differ by one row at most. Rows fall into parts by a hash; the
    number of rows that each part gives to each shard is drawn (the matrix has
    4096 rows at most, whatever the input); inside a part rows are ranked by a
    hash, and ranks are cut at those numbers; inside a shard a second hash gives the
    order. ``slot`` counts from 0 in each shard without a gap.

    ``size`` is the UTF-8 bytes of the text plus 8; a null text counts as
    empty. Hashes take id, text checksum, size, all columns and the number of the row
    among its repeats (1 to their count), so repeats are dealt like other rows, and
    any recomputation gives the same table. Null ids are
    fine; an empty table gives an empty table; columns keep their names inside ``row``.

    Repeats are numbered in one group of at most ``rows_per_part`` rows; a row that is
    repeated more often is counted instead, and its copies are made from the count in
    blocks of 1,000, dealt to all tasks.

    No shard is sorted in one task: it is cut by ranges of the second hash, whose
    counts give the offsets.
    """
    spark = docs.sparkSession
    narrow = [
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    ]
    identity = ["doc_id", "text_crc32", "size"]
    # Hashes skip nulls and take no maps, hence the flags and the JSON.
    plain = [F.to_json(F.struct(c), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}) if "<" in kind else F.col(c)
             for c, kind in ((f"`{name}`", kind) for name, kind in docs.dtypes)]
    narrow.append(F.xxhash64(*plain, *[c.isNull() for c in plain]).alias("same"))
    key = ["text_crc32", "size", "same"]
    numbered_by = [*identity, "same", "nr"]
    # At most one row in rows_per_part.
    hot = stored(docs.select(*narrow).groupBy(*key).count().where(F.col("count") > rows_per_part).select(*key), "repeated")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def numbered(columns: list) -> DataFrame:
        rows = docs.select(*columns)
        few = rows.join(hot, key, "left_anti").select(
            *rows.columns, F.row_number().over(W.partitionBy(*key).orderBy("doc_id")).cast("long").alias("nr"))
        # With a number of partitions, so that adaptive execution does not merge the small blocks.
        many = rows.join(hot, key, "left_semi").groupBy(*rows.columns).count().withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / BLOCK)))
        ).repartition(tasks, *key, "block").select(*rows.columns, F.explode(F.sequence(
            F.col("block") * BLOCK + 1, F.least("count", (F.col("block") + 1) * BLOCK))).alias("nr"))
        return few.unionByName(many)

    def dealt(columns: list) -> DataFrame:
        return numbered(columns).select(
            "*", F.xxhash64(F.lit(seed), *numbered_by).alias("h1"), F.xxhash64(F.lit(seed + 1), *numbered_by).alias("h2"),
        ).withColumn("hash_slot", F.pmod("h1", F.lit(SLOTS)).cast("int"))

    counts = {r["hash_slot"]: r["count"] for r in dealt(narrow).groupBy("hash_slot").count().collect()}
    total = sum(counts.values())
    parts = max(1, min(SLOTS, total // rows_per_part))
    per_part = [0] * parts
    for slot, n in counts.items():
        per_part[slot % parts] += n
    ends = []
    for row in communication_matrix(per_part, shards, seed):
        ends.append([sum(row[: j + 1]) for j in range(shards)])
    matrix = spark.range(1).select(F.posexplode(
        F.from_json(F.lit(json.dumps(ends)), "array<array<bigint>>")).alias("part", "ends"))
    ranges = max(1, min(SLOTS, total // shards // rows_per_part))

    def assigned(columns: list) -> DataFrame:
        ranked = dealt(columns).withColumn("part", F.pmod("hash_slot", F.lit(parts)).cast("int")).withColumn(
            "rank", F.row_number().over(W.partitionBy("part").orderBy("h1", *numbered_by)) - 1)
        # At most 4096 rows of one number per shard.
        return ranked.join(F.broadcast(matrix), "part").withColumn(
            "shard", F.size(F.filter("ends", lambda end: end <= F.col("rank")))
        ).withColumn(
            # The top bits of the hash, so ranges follow each other as the hash does.
            "range", F.floor((F.shiftrightunsigned("h2", 11) / F.lit(float(2**53))) * ranges).cast("int"))

    size = assigned(narrow).groupBy("shard", "range").count()
    before = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = size.select("shard", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    ordered = W.partitionBy("shard", "range").orderBy(F.shiftrightunsigned("h2", 11), "h2", *numbered_by)
    wide = [F.struct("*").alias("row"), *narrow] if carry else narrow
    return assigned(wide).withColumn("in_range", F.row_number().over(ordered) - 1).join(
        F.broadcast(offsets), ["shard", "range"],  # shards x 4096 rows at most
    ).select(
        *(["row"] if carry else []), *identity, F.col("shard").cast("int").alias("shard"),
        (F.col("offset") + F.col("in_range")).cast("long").alias("slot"))
