"""Finds benchmark items in texts by SimHash windows, a multi-index over the fingerprints, and exact verification."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.shingles import shingle_row

#: A fingerprint of 64 bits in 8 blocks. Fingerprints within 23 bits agree up to two bits in some block.
BLOCKS = 8
SLACK = 2
#: Sets of similarity 0.8 differ in 9.7 bits, with a deviation of 2.9.
RADIUS = 20
#: Words in a shingle.
SIZE = 5
#: Bytes of benchmark text that one broadcast index holds; larger benchmarks take more passes.
INDEX_BYTES = 64 * 1024 * 1024
_FILTER_BITS = 20
#: Window starts fingerprinted at once, and parts of a weight's root in a vote (whole numbers, so that sums are exact).
_TILE = 8192
_VOTES = 1024
_PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def normal_words(text: str | None) -> np.ndarray:
    """Hashes of the words, lower-cased, with ASCII punctuation taken as blanks."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION).split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def votes(weights: np.ndarray) -> np.ndarray:
    """Roots of the weights: then the angle between fingerprinted sets follows the weight that they share."""
    return np.round(_VOTES * np.sqrt(weights)).astype(np.int64)


def simhash(shingles: np.ndarray, vote: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the distinct shingles in the windows of ``width`` shingles from ``starts`` (ascending).

    Running sums of signed votes give a window with multiplicity; a shingle that occurs earlier in the
    same window, which holds for a range of starts, is taken out again.
    """
    low, high = int(starts[0]), int(starts[-1]) + width
    own = shingles[low:high]
    bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
    signed = (2 * bits - 1) * vote[low:high, None]
    running = np.vstack([np.zeros((1, 64), np.int64), np.cumsum(signed, axis=0)])
    at = starts - low
    total = running[at + width] - running[at]
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    later, earlier = order[1:][same], order[:-1][same]
    first, last = np.maximum(later - width + 1, 0), np.minimum(earlier, at[-1])
    twice = first <= last
    if twice.any():
        change = np.zeros((at[-1] + 2, 64), np.int64)
        np.add.at(change, first[twice], signed[later[twice]])
        np.add.at(change, last[twice] + 1, -signed[later[twice]])
        total -= np.cumsum(change, axis=0)[at]
    return np.packbits(total > 0, axis=1).view(np.uint64).ravel()


class ItemIndex:
    """Fingerprints, shingles and weights of a bounded number of items, for lookups by window."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        words = [(item, w) for item, text in sorted(items) if len(w := normal_words(text))]
        self.ids = [item for item, _ in words]
        self.length = np.array([len(w) for _, w in words], np.int64)
        self.shingles = [frozenset(shingle_row(w, SIZE).tolist()) for _, w in words]
        held = Counter(s for own in self.shingles for s in own)
        #: Rarer shingles weigh more; what no item holds weighs as much as what one item holds.
        self.rare = 1 + np.log(max(1, len(words)))
        self.weight = {s: 1 + np.log(len(words) / n) for s, n in held.items()}
        self.print = np.zeros(len(words), np.uint64)
        for i, (_, w) in enumerate(words):
            row = shingle_row(w, SIZE)
            weight = np.array([self.weight[x] for x in row.tolist()])
            self.print[i] = simhash(row, votes(weight), np.array([0]), len(row))[0]
        self.filter = {}
        for k in {min(SIZE, int(n)) for n in self.length}:
            own = np.array(sorted({s for shingles, n in zip(self.shingles, self.length) if min(SIZE, n) == k
                                   for s in shingles}), np.uint64)
            table = np.zeros(1 << _FILTER_BITS, bool)
            table[own & np.uint64(len(table) - 1)] = True
            self.filter[k] = table
        self.lengths: dict[int, set[int]] = {}
        for own, n in zip(self.shingles, self.length):
            for s in own:
                self.lengths.setdefault(s, set()).add(int(n))
        self.lookup = {int(n): self._multi_index(np.nonzero(self.length == n)[0]) for n in np.unique(self.length)}

    def _multi_index(self, items: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per block: for each of its 256 values, the items whose block differs in ``SLACK`` bits at most."""
        found = []
        blocks = self.print[items].view(np.uint8).reshape(-1, BLOCKS)
        flips = np.array([v for v in range(256) if v.bit_count() <= SLACK], np.uint8)
        for b in range(BLOCKS):
            value = (blocks[:, b][:, None] ^ flips[None, :]).ravel()
            item = np.repeat(items, len(flips))
            order = np.argsort(value, kind="stable")
            found.append((np.searchsorted(value[order], np.arange(257)), item[order]))
        return found

    def near(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) with fingerprints within the radius, among items of ``length`` words."""
        windows, items = [], []
        for b, (at, item) in enumerate(self.lookup[length]):
            value = prints.view(np.uint8).reshape(-1, BLOCKS)[:, b].astype(np.int64)
            count = at[value + 1] - at[value]
            window = np.repeat(np.arange(len(prints)), count)
            step = np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count)
            windows.append(window)
            items.append(item[np.repeat(at[value], count) + step])
        window, item = np.concatenate(windows), np.concatenate(items)
        close = np.bitwise_count(prints[window] ^ self.print[item]) <= RADIUS
        pair = np.unique(window[close] * len(self.print) + item[close])
        return pair // len(self.print), pair % len(self.print)

    def similarity(self, own: frozenset, item: int) -> float:
        """Weight of the shared shingles over the weight of all shingles of both."""
        other = self.shingles[item]
        shared = sum(self.weight[s] for s in own & other)
        return shared / sum(self.weight.get(s, self.rare) for s in own | other)

    def search(self, text: str | None, least: float) -> dict[int, tuple[float, int, int]]:
        """Per item found in ``text``: similarity, distance and start word of the best window."""
        words, best = normal_words(text), {}
        if not len(words):
            return best
        rows, vote, marks = {}, {}, {}
        for k in self.filter:
            row = rows[k] = shingle_row(words, k)
            hit = np.nonzero(self.filter[k][row & np.uint64((1 << _FILTER_BITS) - 1)])[0]
            weight = np.full(len(row), self.rare)
            for at in hit:
                weight[at] = self.weight.get(int(row[at]), self.rare)
                for length in self.lengths.get(int(row[at]), ()):
                    marks.setdefault(length, []).append(at)
            vote[k] = votes(weight)
        for length, hit in marks.items():
            k = min(SIZE, length)
            row, hit = rows[k], np.array(hit)
            size = min(length, len(words))
            # A window without any shingle of an item of this length has similarity 0 with all of them.
            last = len(words) - size
            low, high = np.clip(hit - (size - k), 0, last), np.clip(hit, 0, last)
            cover = np.zeros(last + 2, np.int64)
            np.add.at(cover, low, 1)
            np.add.at(cover, high + 1, -1)
            starts = np.nonzero(np.cumsum(cover[:-1]) > 0)[0]
            width = max(1, size - k + 1)
            for part in np.split(starts, np.searchsorted(starts, np.arange(_TILE, last + 1, _TILE))):
                if not len(part):
                    continue
                prints = simhash(row, vote[k], part, width)
                for window, item in zip(*self.near(prints, length)):
                    start = int(part[window])
                    score = self.similarity(frozenset(row[start : start + width].tolist()), item)
                    held = best.get(self.ids[item], (-1.0, 0, 0))
                    if score >= least and (score, -start) > (held[0], -held[2]):
                        best[self.ids[item]] = (score, int(np.bitwise_count(prints[window] ^ self.print[item])), start)
        return best


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """``doc_id, version, item_id, similarity, distance, start_word``: benchmark items found in texts.

    One row per row of ``docs`` and item, for the best window (the first of
    equal ones). A window has as many words as the item, at every position; a text shorter
    than the item is one window. Windows and items are compared by SimHash of their distinct five-word
    shingles with their weights; blocks of the fingerprint give all items within 20 of 64 bits, and a pair
    counts when the weighted Jaccard similarity of the same shingles is at least ``least``.
    Windows that hold no shingle of any item of their length have similarity 0 and are not fingerprinted.

    ``version`` is ``xxhash64`` of the text (null as empty), to tell rows of one id apart.
    Null and empty texts or items match nothing; null ids are reported as null;
    equal items are reported each. Empty tables give an empty table. Other columns are ignored.

    Texts never move: the scan carries the index. The benchmark is the stated query set; it is
    indexed in blocks of at most 64 MB of text, with one pass over the documents per block.
    """
    spark = docs.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // INDEX_BYTES + 1
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"))
    schema = "doc_id long, version long, item_id long, similarity double, distance int, start_word long"
    found = None
    for block in range(blocks):
        own = benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        index = spark.sparkContext.broadcast(ItemIndex(
            [(r[0], r[1]) for r in own.select(F.col("item_id").cast("long"), "text").where(
                "item_id IS NOT NULL AND text IS NOT NULL").collect()]))

        def run(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [(doc, version, item, *hit)
                        for doc, body, version in zip(batch["doc_id"], batch["text"], batch["version"])
                        for item, hit in sorted(index.value.search(body, least).items())]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

        part = text.mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    return found
