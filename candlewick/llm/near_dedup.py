"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import stored
from candlewick.llm.graph import components
from candlewick.llm.shingles import band_hashes, circulant_signature, shingle_set

#: 42 bands of 6: a pair of similarity 0.8 shares no band once in 350,000 times.
BANDS, ROWS = 42, 6
#: Buckets up to this size give their pairs one by one; larger ones are joined to clusters.
SMALL_BUCKET = 8
#: Documents in a block of a cluster.
BLOCK = 512


def features(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, print, bands`` per row: set size, fingerprint of the set, band hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, prints, bands = [], [], []
            for text in batch["text"]:
                members = shingle_set(text, size)
                n.append(len(members))
                prints.append(xxhash.xxh3_128_digest(members.tobytes()))
                bands.append(band_hashes(circulant_signature(members, BANDS * ROWS), ROWS).view(np.int64)
                             if len(members) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_shingles": n, "print": prints, "bands": bands})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        run, "doc_id long, n_shingles long, print binary, bands array<long>")


def linked(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether 100 times the intersection reaches ``percent`` times the union."""
    shared = len(np.intersect1d(left, right, assume_unique=True))
    return 100 * shared >= percent * (len(left) + len(right) - shared)


def pair_links(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The links among ``pairs (a, b, text_a, text_b)``, confirmed on the full sets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hit = [linked(shingle_set(x, size), shingle_set(y, size), percent)
                   for x, y in zip(batch["text_a"], batch["text_b"])]
            yield batch.loc[np.array(hit, bool), ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def block_links(ids: list[int], sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked between side 0 and side 1 (or inside side 2, a block alone).

    Intersections of all pairs come from a product of membership matrices over
    the shingles that two documents or more hold, a slice of shingles at a time.
    Of all links found, those that span the components are returned.
    """
    count = len(ids)
    lengths = np.array([len(s) for s in sets])
    shingle, member = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(count), lengths)
    order = np.argsort(member, kind="stable")
    member, owner = member[order], owner[order]
    shared = np.bincount(member, minlength=len(shingle)) > 1
    keep = shared[member]
    member, owner = (np.cumsum(shared) - 1)[member[keep]], owner[keep]
    inter = np.zeros((count, count), np.float32)
    for low in range(0, int(shared.sum()), 4096):
        at, to = np.searchsorted(member, [low, low + 4096])
        matrix = np.zeros((count, 4096), np.float32)
        matrix[owner[at:to], member[at:to] - low] = 1
        inter += matrix @ matrix.T
    inter = inter.astype(np.int64)
    union = lengths[:, None] + lengths[None, :] - inter
    hit = (100 * inter >= percent * union) & (np.minimum(lengths[:, None], lengths[None, :]) > 0)
    hit &= (sides[:, None] != sides[None, :]) | ((sides[:, None] == 2) & (sides[None, :] == 2))
    root = list(range(count))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for i, j in zip(*np.nonzero(np.triu(hit, 1))):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            found.append((ids[i], ids[j]))
    return found


def cluster_links(units: DataFrame, size: int, percent: int) -> DataFrame:
    """Links inside ``units (unit, side, doc_id, text)``; a unit is two blocks, or one, of bounded size."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sets = [shingle_set(text, size) for text in group["text"]]
        found = block_links(group["doc_id"].tolist(), group["side"].to_numpy(), sets, percent)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return units.groupBy("unit").applyInPandas(run, "a long, b long")


def _units(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the block pairs ``pairs (cluster, x, y)`` from ``members (doc_id, cluster, block)``."""
    unit = F.concat_ws(":", "p.cluster", "x", "y").alias("unit")
    m, p = members.alias("m"), pairs.alias("p")
    first = m.join(p, (F.col("m.cluster") == F.col("p.cluster")) & (F.col("block") == F.col("x"))).select(
        unit, F.when(F.col("x") == F.col("y"), 2).otherwise(0).alias("side"), "doc_id")
    second = m.join(p, (F.col("m.cluster") == F.col("p.cluster")) & (F.col("block") == F.col("y"))
                    & (F.col("x") != F.col("y"))).select(unit, F.lit(1).alias("side"), "doc_id")
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``.

    A document's set holds the distinct runs of ``size`` words (A to Z
    lower-cased), or the whole sequence if that is shorter. Documents with
    100 * intersection >= ``percent`` * union are linked; a component is what
    links reach, named by its smallest id; that document is kept.

    A text without words, or null, has an empty set and is linked with nothing.
    Rows of one id are one document, linked by any of its texts. A row without
    an id is linked with nothing, its component is null, and it is kept. Other columns are
    ignored; an empty table gives an empty table.

    How it stays linear:

    1. One scan gives set size, fingerprint of the set and 42 band hashes. Equal sets
       are one document from here on, so exact copies of any number meet nowhere.
    2. Bands are counted (combined before the shuffle); only buckets of two and more go on.
    3. Buckets of at most 8 give their pairs. Larger ones, where near copies by the thousand
       would give the square of that, are joined to clusters, and a cluster is
       compared block by block (512 documents), first every block with one block;
       then blocks of what is not yet connected with the others. Blocks that lie in
       one component already are not compared.
    4. Every link is confirmed on the full sets, computed again from the texts
       of candidates only, and spanning links go to the components.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    feature = stored(features(docs, size), "features")
    alike = stored(
        feature.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("print").agg(
            F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")).select("doc_id", "bands"), "sets")
    band = alike.select("doc_id", F.explode("bands").alias("band"))
    buckets = stored(
        band.groupBy("band").agg(F.count("*").alias("held"), F.min("doc_id").alias("head")).where("held > 1"), "buckets")
    member = stored(band.join(buckets, "band").select("band", "held", "head", "doc_id"), "members")

    clustered = stored(components(
        member.where(F.col("held") > SMALL_BUCKET).select(F.col("head").alias("a"), F.col("doc_id").alias("b")),
        "clusters"), "clustered")
    small = (
        member.where(F.col("held") <= SMALL_BUCKET)
        .groupBy("band").agg(F.array_sort(F.collect_set("doc_id")).alias("ids"))
        .select(F.explode(F.expr("""
            flatten(transform(ids, (x, i) -> transform(slice(ids, i + 2, size(ids)), y -> struct(x AS a, y AS b))))
        """)).alias("p")).select("p.*").distinct()
    )
    in_a = clustered.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    in_b = clustered.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    pairs = stored(
        small.join(in_a, "a", "left").join(in_b, "b", "left")
        .where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select("a", "b"), "pairs")

    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(
        pairs.select(F.col("b").alias("doc_id"))).unionByName(
        clustered.select(F.col("node").alias("doc_id"))).distinct()
    candidate = stored(texts.join(stored(wanted, "wanted"), "doc_id", "left_semi"), "candidates")

    link = stored(pair_links(
        pairs.join(candidate.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(candidate.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"), size, percent), "links")

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sized = stored(clustered.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("n")), "sizes")
    placed = clustered.join(sized, clustered["component"] == sized["cluster"]).select(
        F.col("node").alias("doc_id"), "cluster", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    first = sized.select("cluster", F.lit(0).alias("x"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("y"))
    head_links = stored(cluster_links(_units(placed, first).join(candidate, "doc_id"), size, percent), "links")
    link = link.unionByName(head_links)

    large = sized.where(F.col("n") > BLOCK)
    if large.limit(1).count():
        # Clusters of one block are done. In the others, what is connected by now fills blocks of its own.
        known = components(head_links, "known").select("node", F.col("component").alias("part"))
        part = placed.join(large.select("cluster"), "cluster").join(known, F.col("doc_id") == F.col("node"), "left").select(
            "doc_id", "cluster", F.coalesce("part", "doc_id").alias("part"))
        weight = part.groupBy("cluster", "part").agg(F.count("*").alias("k"))
        mine = stored(part.join(weight, ["cluster", "part"]).join(large, "cluster").select(
            "doc_id", "cluster",
            F.when(F.col("k") > BLOCK, F.concat_ws("-", "part", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("k") / BLOCK))))
            .otherwise(F.concat_ws("-", F.lit("rest"), F.pmod(F.xxhash64("part"), blocks))).alias("block"),
            F.when(F.col("k") > BLOCK, F.col("part")).alias("whole")), "blocks")
        block = mine.groupBy("cluster", "block").agg(F.first("whole").alias("whole"))
        x = block.select("cluster", F.col("block").alias("x"), F.col("whole").alias("wx"))
        y = block.select("cluster", F.col("block").alias("y"), F.col("whole").alias("wy"))
        rest = x.join(y, "cluster").where(
            (F.col("x") <= F.col("y")) & ~F.coalesce(F.col("wx") == F.col("wy"), F.lit(False))).select("cluster", "x", "y")
        link = link.unionByName(stored(cluster_links(
            _units(mine, stored(rest, "rest")).join(candidate, "doc_id"), size, percent), "links"))

    heads = feature.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("head"))
    copies = feature.where("doc_id IS NOT NULL").join(heads, "print").where("doc_id <> head").select(
        F.col("head").alias("a"), F.col("doc_id").alias("b"))
    group = components(link.unionByName(copies), "groups")
    return feature.join(group, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
