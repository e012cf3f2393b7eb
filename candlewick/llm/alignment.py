"""How two tokenizers cut the same texts, and how often each pair of their tokens ends together."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import stored

#: Folder of the two vocabularies.
TOKENIZERS = "/opt/tokenizers"
#: Parts of the B ids; every run is split into so many.
RADIX = 32
#: Links of a run; it ends with the document that reaches them.
RUN_LINKS = 500_000
#: Runs that are merged, or answered, in one task at once.
FAN_IN = 64
#: Bits of a token's id, and of a document's number in its run.
ID_BITS, SLOT_BITS = 16, 20
#: Fixed value: the rule by which byte-level vocabularies of this kind cut a text before merging bytes.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are encoded at once; a longer text is encoded alone.
AT_ONCE = 200_000
#: Entries of one compressed block of a run.
BLOCK = 8192

_ROWS = ("kind int, run long, radix int, slot int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
         "groups_sha256 string, pairs binary, links binary")
_PAIRS = "radix int, run long, pairs binary"


# Runs: blocks of sorted numbers, each compressed by itself.

def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length as compressed blocks; the first one is sorted and stored as differences."""
    squeeze, out = zstandard.ZstdCompressor(level=1), []
    for at in range(0, len(columns[0]), BLOCK):
        part = [np.ascontiguousarray(c[at:at + BLOCK], dtype=np.int64) for c in columns]
        part[0] = np.diff(part[0], prepend=0)
        data = squeeze.compress(b"".join(p.tobytes() for p in part))
        out += [len(part[0]).to_bytes(4, "little"), len(data).to_bytes(4, "little"), data]
    return b"".join(out)


def blocks(run: bytes, columns: int) -> Iterator[list[np.ndarray]]:
    """The blocks of a run, one at a time."""
    expand, at = zstandard.ZstdDecompressor(), 0
    while at < len(run):
        rows, size = (int.from_bytes(run[at + k:at + k + 4], "little") for k in (0, 4))
        data = np.frombuffer(expand.decompress(run[at + 8:at + 8 + size]), dtype=np.int64).reshape(columns, rows)
        yield [np.cumsum(data[0]), *data[1:]]
        at += 8 + size


def unpack(run: bytes, columns: int) -> list[np.ndarray]:
    parts = list(blocks(run, columns))
    return [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, dtype=np.int64)] * columns


def merge(runs: Iterable[bytes]) -> Iterator[tuple[int, int]]:
    """Every pair of the runs in order, with the sum of its counts: a k-way merge on a heap."""
    def entries(run: bytes) -> Iterator[tuple[int, int]]:
        for pair, count in blocks(run, 2):
            yield from zip(pair.tolist(), count.tolist())

    current, total = None, 0
    for pair, count in heapq.merge(*map(entries, runs)):
        if pair != current:
            if current is not None:
                yield current, total
            current, total = pair, 0
        total += count
    if current is not None:
        yield current, total


def with_maxima(merged: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Pair, count, and 1 if no other pair of its B id has a larger count.

    The B id is the upper half of a pair, so its pairs follow each other and are
    all that is held.
    """
    side, held = None, []
    for pair, count in merged:
        if pair >> ID_BITS != side:
            most = max((c for _, c in held), default=0)
            yield from ((p, c, int(c == most)) for p, c in held)
            side, held = pair >> ID_BITS, []
        held.append((pair, count))
    most = max((c for _, c in held), default=0)
    yield from ((p, c, int(c == most)) for p, c in held)


def _columns(rows: Iterable[tuple[int, ...]], width: int) -> list[np.ndarray]:
    flat = np.fromiter((v for row in rows for v in row), dtype=np.int64)
    return list(flat.reshape(-1, width).T)


# Texts.

def _byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Encodes texts both ways and cuts their bytes where tokens of both end.

    A's entries and their ranks are read from its JSON file and encoded by tiktoken, which cuts
    texts by the same rule and gives the same ids (tested over all code points) in a third of the time.
    """

    def __init__(self, folder: str = TOKENIZERS):
        import sentencepiece
        import tiktoken

        with open(f"{folder}/byte_bpe_50k.json", encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model["added_tokens"]}
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in entry): i for entry, i in model["model"]["vocab"].items() if entry not in special}
        self.a = tiktoken.Encoding("byte_bpe_50k", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/piece_bpe_32k.model")
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.length_a = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.length_a[list(ranks.values())] = [len(entry) for entry in ranks]
        self.length_b = np.array([len(b) for b in self.bytes_b], dtype=np.int64)
        if max(len(self.length_a), len(self.length_b)) > 1 << ID_BITS:
            raise ValueError(f"a vocabulary has more than {1 << ID_BITS} entries")
        # Ids as text, followed by what stands behind a token inside a group and at its end.
        self.inner = np.array([f"{i}," for i in range(1 << ID_BITS)], dtype=object)
        self.last_a = np.array([f"{i}|" for i in range(1 << ID_BITS)], dtype=object)
        self.last_b = np.array([f"{i};" for i in range(1 << ID_BITS)], dtype=object)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B per text; nothing for a text without tokens."""
        coded = self._coded([t for t in texts if t])
        for text in texts:
            found = None
            if text:
                plain, ids_a, ids_b = next(coded)
                raw = b" " + plain.encode()
                if self.a.decode_bytes(ids_a) == raw == b"".join(map(self.bytes_b.__getitem__, ids_b)):
                    found = np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)
            yield found

    def _coded(self, texts: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
        """Texts with their ids, encoded some at a time, because ids are much larger than texts."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
                size += len(texts[end])
                end += 1
            some = texts[at:end]
            yield from zip(some, (self.a.encode_ordinary(" " + t) for t in some), self.b.encode(some, num_threads=1))
            at = end

    def cuts(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the A tokens and of the B tokens whose ends are the same byte."""
        end_a, end_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        at = np.searchsorted(end_b, end_a)
        both = np.flatnonzero(end_b[np.minimum(at, len(end_b) - 1)] == end_a)
        return both, at[both]

    def groups_text(self, ids_a: np.ndarray, ids_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> str:
        """The groups as ``a1,a2|b1;a3|b2,b3``: every id is put where it stands among the ids of both."""
        text_a, text_b = self.inner[ids_a], self.inner[ids_b]
        text_a[cut_a], text_b[cut_b] = self.last_a[ids_a[cut_a]], self.last_b[ids_b[cut_b]]
        out = np.empty(len(ids_a) + len(ids_b), dtype=object)
        # Before a token stand its own kind's earlier ones, and the other kind's up to its group.
        out[np.arange(len(ids_a)) + np.repeat(np.r_[0, cut_b[:-1] + 1], np.diff(cut_a, prepend=-1))] = text_a
        out[np.arange(len(ids_b)) + np.repeat(cut_a + 1, np.diff(cut_b, prepend=-1))] = text_b
        return "".join(out.tolist())[:-1]


class _Run:
    """Links of some documents until they are written, each one number: part of the B ids, B id, A id, document's slot."""

    def __init__(self, number: int):
        self.number, self.size, self.links, self.docs = number, 0, [], 0

    def add(self, side: np.ndarray, other: np.ndarray) -> int:
        self.links.append((((side % RADIX << ID_BITS) + side << ID_BITS) + other << SLOT_BITS) + self.docs)
        self.size += len(side)
        self.docs += 1
        return self.docs - 1

    def full(self, run_links: int) -> bool:
        return self.size >= run_links or self.docs == 1 << SLOT_BITS

    def parts(self) -> Iterator[tuple]:
        """Per part of the B ids: distinct pairs with counts, and (pair, slot) with counts, both in order."""
        link = np.sort(np.concatenate(self.links))
        new = np.flatnonzero(np.diff(link, prepend=-1))
        link, times = link[new], np.diff(np.r_[new, len(link)])
        part = link >> SLOT_BITS + 2 * ID_BITS
        ends = np.searchsorted(part, np.arange(RADIX + 1))
        for radix, (i, j) in enumerate(zip(ends[:-1], ends[1:])):
            if i < j:
                pair = (link[i:j] >> SLOT_BITS) & (1 << 2 * ID_BITS) - 1
                first = np.flatnonzero(np.diff(pair, prepend=-1))
                yield (radix, pack(pair[first], np.add.reduceat(times[i:j], first)),
                       pack(pair, link[i:j] & (1 << SLOT_BITS) - 1, times[i:j]))


def _encoded(folder: str, run_links: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, task = Aligner(folder), TaskContext.get().partitionId()
        current, made = _Run(task << 24), 0
        columns = [c.split()[0] for c in _ROWS.split(", ")]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype(
                {c: "Int64" for c in columns[:9]}).astype({"kind": "int32"})

        def closed(r: _Run) -> Iterator[pd.DataFrame]:
            for radix, pairs, links in r.parts() if r.size else ():
                yield frame([(1, r.number, radix, None, None, None, None, None, None, None, pairs, links)])

        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], aligner.encode(batch["text"].tolist())):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                if ids is None:
                    slot = current.add(*[np.zeros(0, dtype=np.int64)] * 2)
                    rows.append((0, current.number, None, slot, doc_id, 0, 0, 0, 0, "", None, None))
                else:
                    cut_a, cut_b = aligner.cuts(*ids)
                    slot, text = current.add(ids[1][cut_b], ids[0][cut_a]), aligner.groups_text(*ids, cut_a, cut_b)
                    rows.append((0, current.number, None, slot, doc_id, len(ids[0]), len(ids[1]), len(cut_a), len(cut_a),
                                 hashlib.sha256(text.encode()).hexdigest(), None, None))
                if current.full(run_links):
                    yield from closed(current)
                    made += 1
                    current = _Run((task << 24) + made)
            yield frame(rows)
        yield from closed(current)

    return run


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    pairs = pack(*_columns(merge(group["pairs"]), 2))
    return pd.DataFrame({"radix": [group["radix"].iloc[0]], "run": [group["run"].min()], "pairs": [pairs]})


def _finished(group: pd.DataFrame) -> pd.DataFrame:
    pairs = pack(*_columns(with_maxima(merge(group["pairs"])), 3))
    return pd.DataFrame({"radix": [group["radix"].iloc[0]], "run": [0], "pairs": [pairs]})


def _answered(links: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Per run what its documents get from one part of the B ids: slot, links at the maximum, sum of counts."""
    out = []
    if len(links):
        known, total, best = unpack(counts["pairs"].iloc[0], 3)
        for run, data in zip(links["run"], links["links"]):
            slots, n_best, n_sum = [], [], []
            for pair, slot, times in blocks(data, 3):
                at = np.searchsorted(known, pair)
                slots.append(slot)
                n_best.append(times * best[at])
                n_sum.append(times * total[at])
            slot = np.concatenate(slots)
            mine, where = np.unique(slot, return_inverse=True)
            sums = np.zeros((2, len(mine)), dtype=np.int64)
            np.add.at(sums[0], where, np.concatenate(n_best))
            np.add.at(sums[1], where, np.concatenate(n_sum))
            out.append((run, pack(mine, *sums)))
    return pd.DataFrame(out, columns=["run", "sums"])


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """The documents of one run: a run has RADIX rows at most."""
    parts = [unpack(data, 3) for data in group["sums"]]
    slot, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = np.zeros((2, len(slot)), dtype=np.int64)
    for k in (0, 1):
        np.add.at(sums[k], where, np.concatenate([p[k + 1] for p in parts]))
    return pd.DataFrame({"run": group["run"].iloc[0], "slot": slot, "n_best": sums[0], "count_sum": sums[1]})


def pair_counts(encoded: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``radix, run, pairs``: one run per part of the B ids with every pair, its count and whether it is the largest.

    Runs are merged ``fan_in`` at a time until so many remain; each holds a pair
    once, so its size is bounded by the vocabularies, not by the rows.
    """
    runs = encoded.where("kind = 1").select("radix", "run", "pairs")
    most = runs.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    while most > fan_in:
        nth = F.pmod(F.xxhash64("run"), F.lit(-(-most // fan_in)))
        runs = stored(runs.groupBy("radix", nth.alias("part")).applyInPandas(_merged, _PAIRS), "merged")
        most = runs.groupBy("radix").count().agg(F.max("count")).first()[0]
    return stored(runs.groupBy("radix").applyInPandas(_finished, _PAIRS), "counts")


def align(
    docs: DataFrame, folder: str = TOKENIZERS, run_links: int = RUN_LINKS, fan_in: int = FAN_IN,
) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row of ``docs``.

    Texts are encoded as space plus text by ``byte_bpe_50k.json`` (A) and by
    ``piece_bpe_32k.model`` (B), both in ``folder``, which every executor must see. Bytes where a
    token of A and one of B end cut both into groups; those two tokens are a link. A pair's
    count is its links in all texts; ``n_best`` counts a text's links whose pair
    has the largest count of its B id (ties included), ``count_sum`` sums the counts of its links.

    Counting is external: each task sorts ``run_links`` links at a time by
    (B id, A id, document), splits them by B id and writes compressed runs to the shared folder. Runs of one
    part are merged on a heap; B ids come in order, so each one's maximum is known as it ends.
    The runs are then read again, block by block, and the contributions go back
    to the documents as arrays, one per run and part. ``fan_in`` runs
    are merged or answered in one task.

    Null and empty texts, and texts that one tokenizer cannot give back byte by byte, have zeros
    and an empty ``groups_sha256``. Null and repeated ids are fine, rows are told apart by run and slot. An
    empty table gives an empty table. Other columns are not read.
    """
    encoded = stored(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        _encoded(folder, run_links), _ROWS), "encoded")
    counts = pair_counts(encoded, fan_in)
    links = encoded.where("kind = 1").select("radix", "run", "links")
    runs = links.select("run").distinct().count()
    parts = max(1, -(-runs // fan_in))
    salted = links.withColumn("part", F.pmod(F.xxhash64("run"), F.lit(parts)))
    copied = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>")))
    sums = salted.groupBy("radix", "part").cogroup(copied.groupBy("radix", "part")).applyInPandas(
        _answered, "run long, sums binary")
    back = sums.groupBy("run").applyInPandas(_summed, "run long, slot int, n_best long, count_sum long")
    rows = encoded.where("kind = 0").select(
        "run", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    return rows.join(back, ["run", "slot"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
