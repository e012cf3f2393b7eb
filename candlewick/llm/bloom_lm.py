"""A bigram language model whose counts live in a log-frequency Bloom filter."""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.llm.common import held_fold, stored
from candlewick.llm.shingles import mix64

#: Base of the quantisation: a count is kept as ``1 + floor(log(count) / log(BASE))``.
BASE = 1.5
#: Least number of hash functions: an absent count is taken for 1 in one of 64 lookups.
PROBES = 6
#: Largest share of ``BACKOFF`` that false counts may add to a history, over all words.
EXCESS = 0.02
#: Weight of the unigram distribution after each history, in counts.
BACKOFF = 2000.0
#: Largest model that is broadcast; texts that may have a larger one are cut into chunks, whose n-grams are shuffled.
BROADCAST_BYTES = 384 * 1024 * 1024
#: Characters of text per segment of the model.
SEGMENT_CHARS = 2_000_000
#: Pairs whose level a worker remembers.
REMEMBERED = 1 << 20
#: Texts in a batch that a worker gets; Spark's default of 10,000 is held several times over between JVM and worker.
TEXTS = 1000
#: Tokens handled at once in a task.
CHUNK = 100_000
#: Tokens of a stored chunk: each of its distinct n-grams is shuffled once.
STORED_CHUNK = 1_000_000
#: Bytes of the stored chunks that a worker gets at once.
BATCH_BYTES = 8 * 1024 * 1024

END = np.uint64(xxhash.xxh64_intdigest(b""))  # no word is empty
BEGIN = np.uint64(0xA0761D6478BD642F)
_PRIME = np.uint64(0xE7037ED1A0B428DB)


def tokens(body: bytes | None) -> np.ndarray:
    """Hashes of the words of a UTF-8 text, A to Z lower-cased, and ``END``. ``bytes.split`` splits at the six ASCII blanks."""
    words = (body or b"").lower().split()
    return np.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), END)


def histories(token: np.ndarray) -> np.ndarray:
    return np.concatenate([[BEGIN], token[:-1]]).astype(np.uint64)


def bigram_keys(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix64(history * _PRIME + token)


def segment_of(keys: np.ndarray, segments: int) -> np.ndarray:
    """Segments follow each other as keys do."""
    return (((keys >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)).astype(np.int32)


def floors(segment: np.ndarray, segments: int) -> np.ndarray:
    """The least key of each segment."""
    return ((segment.astype(np.uint64) << np.uint64(32)) + np.uint64(segments - 1)) // np.uint64(segments) << np.uint64(32)


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def level_count(levels: np.ndarray) -> np.ndarray:
    """The least count that a level stands for, so that a history's pairs never sum to more than it; 0 for level 0."""
    return np.where(levels > 0, np.ceil(BASE ** (levels - 1.0) - 1e-9), 0.0)


def probes_for(types: int) -> int:
    """Hash functions for a vocabulary of ``types`` words: each may be asked after any history."""
    return max(PROBES, int(np.ceil(np.log2(max(1, types) / (EXCESS * BACKOFF)))))


def _spread(keys: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and odd step of the places of a key with a level, on a ring of 2**32."""
    mixed = mix64(keys + np.array([at], np.uint64) * _PRIME)
    return (mixed >> np.uint64(32)).astype(np.uint32), mixed.astype(np.uint32) | np.uint32(1)


def _spots(ring: np.ndarray, bits: np.ndarray | np.uint64) -> np.ndarray:
    """Places on the ring scaled to a filter of fewer than 2**32 bits."""
    spot = ring.astype(np.uint64)
    spot *= bits
    spot >>= np.uint64(32)
    return spot


def build_filter(keys: np.ndarray, counts: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """A byte array whose bits hold each key together with every level up to its own."""
    levels = level(counts)
    bits = max(64, int(np.ceil(levels.sum() * probes / np.log(2) / 64)) * 64)
    table = np.zeros(bits, bool)
    top = int(levels.max()) if len(levels) else 0
    for at in range(1, top + 1):
        keys = keys[levels >= at]
        levels = levels[levels >= at]
        first, step = _spread(keys, at)
        for _ in range(probes):
            table[_spots(first, np.uint64(bits))] = True
            first += step
    return np.packbits(table, bitorder="little")


def probe_levels(
    keys: np.ndarray, filters: np.ndarray, starts: np.ndarray, bits: np.ndarray, probes: np.ndarray,
) -> np.ndarray:
    """Levels of keys: level after level is looked up until one is missing.

    ``filters`` holds the filters of all segments; ``starts`` (bytes) and ``bits`` say where
    each is, ``probes`` how many hash functions it has.
    """
    out = np.zeros(len(keys), np.int64)
    live, at = np.arange(len(keys)), 1
    while len(live):
        out[live] = at - 1
        live = live[_held(keys[live], at, filters, starts, bits, probes)]
        at += 1
    return out


def _held(keys: np.ndarray, at: int, filters: np.ndarray, starts: np.ndarray, bits: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Places in ``keys`` of those that the filters hold with level ``at``."""
    segment = segment_of(keys, len(bits))
    least = int(probes.min())
    own = [np.arange(len(keys)), *_spread(keys, at), starts[segment], bits[segment].astype(np.uint64), probes[segment]]
    alive = np.ones(len(keys), bool)
    for probe in range(int(probes.max())):
        _, ring, step, base, size, needed = own
        spot = _spots(ring, size)
        byte = filters.take(base + (spot >> np.uint64(3)).view(np.int64))
        held = (byte >> (spot.astype(np.uint8) & np.uint8(7))) & np.uint8(1) == 1
        if probe >= least:
            held |= probe >= needed
        alive &= held
        ring += step
        left = np.count_nonzero(alive)
        if not left:
            return own[0][:0]
        if 2 * left < len(alive):
            own, alive = [x[alive] for x in own], np.ones(left, bool)
    return own[0][alive]


def _mapped(size: int, kind: type) -> np.ndarray:
    """Zeros in a file without a name, whose pages the system takes back when memory is short."""
    with tempfile.TemporaryFile() as file:
        # A plain array, which pickle writes as it lies; it copies a memmap first.
        return np.asarray(np.memmap(file, kind, "w+", shape=max(1, size)))[:size]


class Lookup:
    """A model, or some segments of it, as arrays."""

    def __init__(self, rows: Iterable, segments: int, types: int, filter_bytes: int, zeros: Callable = np.zeros) -> None:
        """``rows`` of the model, sorted by segment, so that keys are sorted as they come.

        ``types`` and ``filter_bytes`` are the sums over ``rows``: what comes is put in its place, and held once,
        in arrays that ``zeros`` makes.
        """
        self.starts, self.bits = np.zeros(segments, np.int64), np.full(segments, 8, np.int64)
        self.probes = np.full(segments, PROBES, np.int64)
        self.keys, self.counts = zeros(types, np.uint64), zeros(types, np.uint32)
        # Segments without a bigram look at the empty byte in front.
        self.filters = zeros(1 + filter_bytes, np.uint8)
        word, at = 0, 1
        for r in rows:
            own, bits = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["filter"], np.uint8)
            counts = np.frombuffer(r["counts"], np.int64)
            if counts.max(initial=0) >= 2**32 and self.counts.dtype == np.uint32:
                wider = zeros(types, np.int64)
                wider[:word] = self.counts[:word]
                self.counts = wider
            self.keys[word : word + len(own)] = own
            self.counts[word : word + len(own)] = counts
            self.filters[at : at + len(bits)] = bits
            self.starts[r["segment"]], self.bits[r["segment"]] = at, 8 * len(bits)
            self.probes[r["segment"]] = r["probes"]
            word, at = word + len(own), at + len(bits)
        self.memory = None

    def unigrams(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at].astype(np.int64), 0)

    def bigrams(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct keys. The levels found are remembered by key, in ``REMEMBERED`` places that
        keep the more frequent of two pairs: those take the most lookups, and nearly all texts ask for them.
        """
        if self.memory is None:
            self.memory = np.zeros(REMEMBERED, np.uint64), np.zeros(REMEMBERED, np.int8)
        known, levels = self.memory
        place = (keys & np.uint64(REMEMBERED - 1)).astype(np.int64)
        out = np.where(known[place] == keys, levels[place], 0).astype(np.int64)
        ask = np.flatnonzero(out == 0)
        out[ask] = probe_levels(keys[ask], self.filters, self.starts, self.bits, self.probes)
        ask = ask[out[ask] > levels[place[ask]]]
        ask = ask[np.argsort(out[ask], kind="stable")]  # of several keys of a place the last one stays
        known[place[ask]], levels[place[ask]] = keys[ask], out[ask]
        return level_count(out)


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of ``values``, one binary from each of ``starts`` to the next; nothing is copied."""
    offsets = np.append(starts, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _unpacked(packed: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), kind)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with the sum of its counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    place = np.argsort(keys)
    keys = keys[place]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts[place].astype(np.int64), first)


def _segment_filter(words: np.ndarray, pairs: np.ndarray, counts: np.ndarray, segments: int) -> tuple[np.ndarray, int]:
    """The filter of a segment and its number of hash functions, from its distinct words and pairs."""
    # Words are spread evenly, so a segment knows about how many there are in all.
    probes = probes_for(segments * len(words))
    return build_filter(pairs, counts, probes), probes


def train(docs: DataFrame, segments: int) -> DataFrame:
    """``segment, tokens, keys, counts, probes, filter``: exact unigram counts and the bigram filter, by segment.

    Counts of all rows of ``docs``. A task sums each chunk of tokens before the shuffle, so a
    frequent n-gram is counted once per chunk. What a chunk has for a segment is shuffled as one row, its keys
    and counts packed: rows of single n-grams, most of them rare, filled the heap of the executors. A segment
    sums its keys and is built in one task; its share of the n-grams is bounded by ``SEGMENT_CHARS``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            token = np.concatenate(held)
            # Every text ends with END, so the token after one begins a text.
            history = histories(token)
            history[history == END] = BEGIN
            for order in (1, 2):
                keys, counts = np.unique(token if order == 1 else bigram_keys(history, token), return_counts=True)
                segment = segment_of(keys, segments)
                starts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
                yield pa.RecordBatch.from_pydict({
                    "segment": segment[starts], "gram": np.full(len(starts), order, np.int8),
                    "keys": _packed(keys, starts), "counts": _packed(counts.astype(np.uint32), starts)})

        for batch in batches:
            for text in batch["text"]:
                held.append(tokens(text.as_py()))
                size += len(held[-1])
                if size >= 5 * CHUNK:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def build(group: pa.Table) -> pa.Table:
        grams = [group.filter(pc.equal(group["gram"], order)) for order in (1, 2)]
        (words, n), (pairs, pair_n) = [
            _summed(_unpacked(part["keys"], np.uint64), _unpacked(part["counts"], np.uint32)) for part in grams]
        table, probes = _segment_filter(words, pairs, pair_n, segments)
        return pa.table({
            "segment": group["segment"][:1].cast(pa.int32()), "tokens": pa.array([n.sum()], pa.int64()),
            "keys": pa.array([words.tobytes()]), "counts": pa.array([n.tobytes()]),
            "probes": pa.array([probes], pa.int32()), "filter": pa.array([table.tobytes()])})

    counted = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(
        count, "segment int, gram byte, keys binary, counts binary")
    # As many parts as segments, which are not merged: a task builds a few segments, whatever the size of the corpus.
    return counted.repartition(segments, "segment").groupBy("segment").applyInArrow(
        build, "segment int, tokens long, keys binary, counts binary, probes int, filter binary")


def _probability(pair: np.ndarray, history: np.ndarray, token: np.ndarray, unigram: np.ndarray) -> np.ndarray:
    """Interpolation: the history's counts, with ``BACKOFF`` counts dealt out as unigrams are.

    A pair is no more frequent than either of its words.
    """
    return (np.minimum(pair, np.minimum(history, token)) + BACKOFF * unigram) / (history + BACKOFF)


def _terms(pair: np.ndarray, history: np.ndarray, token: np.ndarray, total: int, types: int) -> dict[str, np.ndarray]:
    """What each token adds to the sums of its text, from the counts of the pair, its history and itself."""
    unigram = (token + 1) / (total + types + 1)
    return {"n_tokens": np.ones(len(token), np.int64), "n_known": (token > 0).astype(np.int64),
            "base_score": np.log10(unigram), "score": np.log10(_probability(pair, history, token, unigram))}


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside pass at most ``TEXTS`` rows or about ``BATCH_BYTES`` to a worker at once, and their shuffle
    files go as each ends; then the session's own settings hold again.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    small = {name: str(min(TEXTS, rows) if rows > 0 else TEXTS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
             "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    own = {name: spark.conf.get(name) for name in small}
    try:
        for name, value in small.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in own.items():
            spark.conf.set(name, value)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _pieces(bodies: Iterable, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Tokens of many short texts, or of parts of a long one, at most ``most`` (``CHUNK``) and a text's rest at once.

    Per piece the rows, where each begins, all tokens and their histories.
    """
    rows, held, before, size = [], [], [], 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        length = np.array([len(t) for t in held])
        return np.array(rows), np.cumsum(length) - length, np.concatenate(held), np.concatenate(before)

    for row, body in enumerate(bodies):
        token = tokens(body.as_py())
        history = histories(token)
        for at in range(0, len(token), CHUNK):
            rows.append(row)
            held.append(token[at : at + CHUNK])
            before.append(history[at : at + CHUNK])
            size += len(held[-1])
            if size >= (most or CHUNK):
                yield joined()
                rows, held, before, size = [], [], [], 0
    if rows:
        yield joined()


def _score_here(docs: DataFrame, model, total: int, types: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lookup, n = model.value, batch.num_rows
            sums = {"n_tokens": np.zeros(n, np.int64), "n_known": np.zeros(n, np.int64),
                    "base_score": np.zeros(n), "score": np.zeros(n)}
            for row, first, token, history in _pieces(batch["text"]):
                unique, place = np.unique(token, return_inverse=True)
                count = lookup.unigrams(unique)[place]
                before = np.concatenate([[0], count[:-1]])
                before[first] = lookup.unigrams(np.where(history[first] == BEGIN, END, history[first]))
                keys, place = np.unique(bigram_keys(history, token), return_inverse=True)
                for name, value in _terms(lookup.bigrams(keys)[place], before, count, total, types).items():
                    np.add.at(sums[name], row, np.add.reduceat(value, first))
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "held_out": batch["held_out"], "n_tokens": sums["n_tokens"],
                "n_known": sums["n_known"], "train_tokens": np.full(n, total, np.int64),
                "base_score": sums["base_score"], "score": sums["score"]})

    return docs.mapInArrow(run, _SCORES)


def _narrow(values: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, int]:
    """Whole numbers as their low bytes, as many as the largest takes: one binary from each of ``starts`` to the next."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    offsets = np.append(starts, len(values)).astype(np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low)]), width


def _wide(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def _gaps(keys: np.ndarray, starts: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Keys in order as distances, from the key before or, at each of ``starts`` that has keys, from its base."""
    out = np.diff(keys, prepend=np.uint64(0))
    full = starts < np.append(starts[1:], len(keys))
    out[starts[full]] = keys[starts[full]] - base[full]
    return out


_CHUNK = ("row array<long>, doc_id array<long>, held_out array<boolean>, length array<int>, before array<int>, "
          "width int, words binary, tokens binary")


def _chunks(texts: DataFrame) -> DataFrame:
    """Texts as tokens, ``STORED_CHUNK`` and a part of a text at most in a row.

    ``words`` are the hashes that occur, in order, as distances of ``width`` bytes; ``tokens`` places among them, all
    first bytes in front of all second ones. Per text or part of a text: whose it is, its number of tokens, and the
    place of the word ``before`` it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        about, seen = {}, itertools.count()

        def bodies() -> Iterator:
            for batch in batches:
                for own, body in zip(batch.select(["row", "doc_id", "held_out"]).to_pylist(), batch["text"]):
                    about[next(seen)] = own
                    yield body

        start = np.zeros(1, np.int64)
        for rows, first, token, history in _pieces(bodies(), STORED_CHUNK):
            words, place = np.unique(np.concatenate([token, history[first], np.array([BEGIN, END])]), return_inverse=True)
            packed, width = _narrow(_gaps(words, start, np.zeros(1, np.uint64)), start)
            own, place = [about[r] for r in rows.tolist()], place.astype("<u4")
            size = len(token)
            yield pa.RecordBatch.from_pydict({
                "row": pa.array([[o["row"] for o in own]], pa.list_(pa.int64())),
                "doc_id": pa.array([[o["doc_id"] for o in own]], pa.list_(pa.int64())),
                "held_out": pa.array([[o["held_out"] for o in own]], pa.list_(pa.bool_())),
                "length": pa.array([np.diff(np.append(first, size)).astype(np.int32)]),
                "before": pa.array([place[size : size + len(first)].astype(np.int32)]),
                "width": pa.array([width], pa.int32()), "words": packed,
                "tokens": pa.array([place[:size].view(np.uint8).reshape(-1, 4).T.tobytes()])})
            # The last text may go on.
            last = int(rows[-1])
            for r in [r for r in about if r < last]:
                del about[r]

    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(cut, _CHUNK).withColumn("chunk", F.monotonically_increasing_id())


def _opened(chunk: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk, the places of each token and of its history among them, and where its texts begin."""
    words = np.cumsum(_wide(chunk["words"], chunk["width"]), dtype=np.uint64)
    token = np.ascontiguousarray(np.frombuffer(chunk["tokens"], np.uint8).reshape(4, -1).T).view("<u4").ravel()
    first = np.cumsum(chunk["length"]) - chunk["length"]
    history = np.empty_like(token)
    history[1:] = token[:-1]
    history[first] = chunk["before"]
    return words, token, history, first


def _answers(chunks: DataFrame, segments: int) -> DataFrame:
    """``chunk, segment, n_width, n, levels, tokens, types``: what the model knows of the n-grams of each chunk.

    Per segment the counts of a chunk's words and the levels that the filter has for its pairs, both in the order of
    their hashes. A chunk sends each distinct n-gram once, with its count in the texts that are trained on, to the
    segment's task; that sums them, builds the filter and looks the same n-grams up in it. ``tokens`` and ``types``
    of a segment stand at one of its rows. A task's share of the n-grams is bounded by ``SEGMENT_CHARS``.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = np.arange(segments)
        base = floors(segment, segments)
        for batch in batches:
            for chunk in range(batch.num_rows):
                [own] = batch.slice(chunk, 1).to_pylist()
                words, token, history, _ = _opened(own)
                trained = np.repeat(~np.array(own["held_out"]), own["length"])
                n = np.bincount(token[trained], minlength=len(words))
                pairs = bigram_keys(words[history], words[token])
                place = np.argsort(pairs)
                pairs = pairs[place]
                first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
                pair_n = np.add.reduceat(trained[place].astype(np.int64), first)
                out, held = {"chunk": np.full(segments, own["chunk"]), "segment": segment.astype(np.int32)}, np.zeros(segments, bool)
                for name, keys, counts in (("word", words, n), ("pair", pairs[first], pair_n)):
                    starts = np.searchsorted(keys, base)
                    for kind, values in (("", _gaps(keys, starts, base)), ("_n", counts)):
                        out[name + kind], width = _narrow(values, starts)
                        out[f"{name}{kind}_width"] = np.full(segments, width, np.int8)
                    held |= np.diff(np.append(starts, len(keys))) > 0
                yield pa.RecordBatch.from_pydict(out).filter(pa.array(held))

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        [base] = floors(np.array([rows[0]["segment"]]), segments)

        def summed(name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """Distinct keys of all chunks with their counts; the place of each chunk's keys among them, chunk after chunk."""
            keys = [base + np.cumsum(_wide(r[name], r[f"{name}_width"]), dtype=np.uint64) for r in rows]
            counts = np.concatenate([_wide(r[f"{name}_n"], r[f"{name}_n_width"]) for r in rows])
            starts = np.cumsum([0, *map(len, keys)])[:-1]
            keys, place = np.unique(np.concatenate(keys), return_inverse=True)
            # Sums of whole numbers below 2**53 are exact.
            return keys, np.bincount(place, counts, len(keys)).astype(np.int64), place, starts

        words, n, word_place, word_starts = summed("word")
        pairs, pair_n, pair_place, pair_starts = summed("pair")
        known = n > 0
        table, probes = _segment_filter(words[known], pairs[pair_n > 0], pair_n[pair_n > 0], segments)
        levels = probe_levels(pairs, table, np.array([0]), np.array([8 * len(table)]), np.array([probes]))
        counts, width = _narrow(n[word_place], word_starts)
        once = np.arange(len(rows)) == 0
        return pa.table({
            "chunk": group["chunk"], "segment": group["segment"], "n_width": np.full(len(rows), width, np.int8), "n": counts,
            "levels": _packed(levels.astype(np.int8)[pair_place], pair_starts),
            "tokens": np.where(once, n.sum(), 0), "types": np.where(once, np.count_nonzero(known), 0)})

    asked = chunks.mapInArrow(ask, "chunk long, segment int, " + ", ".join(
        f"{name}{kind} binary, {name}{kind}_width byte" for name in ("word", "pair") for kind in ("", "_n")))
    # As many parts as segments, as in training.
    return asked.repartition(segments, "segment").groupBy("segment").applyInArrow(
        answer, "chunk long, segment int, n_width byte, n binary, levels binary, tokens long, types long")


def _score_shuffled(texts: DataFrame, segments: int) -> DataFrame:
    """The same scores for a model of any size, of which a task builds and holds one segment at a time.

    Each chunk of texts sends its distinct n-grams, packed, to the segments and gets counts and levels back.
    """
    spark = texts.sparkSession
    # A row is megabytes: row groups are to be bounded by size, not by rows.
    packed = {"compression": "zstd", "parquet.page.size.row.check.min": "1", "parquet.block.size": str(BATCH_BYTES)}
    with _small_batches(spark):
        chunks = stored(_chunks(texts), "chunks", **packed)
        answers = stored(_answers(chunks, segments), "answers", compression="zstd")
    total, types = [n or 0 for n in answers.agg(F.sum("tokens"), F.sum("types")).first()]

    def finish(chunk: pa.Table, found: pa.Table) -> pa.Table:
        [own] = chunk.to_pylist()
        words, token, history, first = _opened(own)
        rows = sorted(found.to_pylist(), key=lambda r: r["segment"])
        known = np.concatenate([_wide(r["n"], r["n_width"]) for r in rows]).astype(np.int64)
        # A text begins as often as one ends.
        known[words == BEGIN] = known[words == END]
        _, place = np.unique(bigram_keys(words[history], words[token]), return_inverse=True)
        pair = level_count(np.frombuffer(b"".join(r["levels"] for r in rows), np.int8))[place]
        return pa.table({
            **{name: pa.array(own[name], kind) for name, kind in (("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()))},
            **{name: np.add.reduceat(value, first) for name, value in _terms(pair, known[history], known[token], total, types).items()}})

    sums, parts = ["n_tokens", "n_known", "base_score", "score"], max(32, segments // 2)
    # As many parts as there are chunks, about, whatever the session's number: what a task sorts stays small.
    sides = [side.repartition(parts, "chunk").groupBy("chunk") for side in (chunks, answers.drop("tokens", "types"))]
    scored = sides[0].cogroup(sides[1]).applyInArrow(
        finish, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    # A long text lies in several chunks.
    return scored.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in sums]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def score(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Log10 probabilities of all texts, under a model of those whose id hash modulo 7 is not 2.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. ``base_score`` is the
    add-one unigram model of exact counts. ``score`` is a bigram model: counts of pairs come from the
    filter by repeated membership tests, level after level until one fails, and are
    interpolated with the unigram model (``BACKOFF`` counts per history). A count stands for the
    least of its level and is bounded by those of both words, and hash functions follow the vocabulary:
    the probabilities after a history sum to 1 + ``EXCESS`` at most, in expectation.

    A null text is empty: one end token. A null id hashes as an empty text and
    is trained on. Repeated rows count and are scored each. An empty table gives an
    empty table; other columns are ignored. Words are told apart by 64-bit hashes.

    The model is cut into segments by hash, each built in one task from counts
    summed and packed before the shuffle. A model that takes at most ``broadcast_bytes``, by a bound from the
    size of the texts, goes to all workers, and goes once the scores are written. Any other is held nowhere as a
    whole: chunks of texts send their n-grams to the segments and get counts and levels back, with the same results.
    """
    spark = docs.sparkSession
    # Texts reach the workers as bytes: no text is decoded, and a batch is held once.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                        (held_fold(F.col("doc_id"), 7) == 2).alias("held_out"))
    chars, rows = [n or 0 for n in docs.agg(F.sum(F.length("text")), F.count("*")).first()]
    segments = max(32, chars // SEGMENT_CHARS)
    # At most chars / 2 + 1.5 * rows tokens; a token adds at most 16 bytes of words and, with up to 20 hash functions, 3.6 of filters.
    if 10 * chars + 30 * rows > broadcast_bytes:
        return _score_shuffled(texts, segments)
    with _small_batches(spark):
        model = stored(train(texts.where("NOT held_out"), segments), "model")
    sizes = model.select(F.octet_length("keys").alias("k"), F.octet_length("filter").alias("f"), "tokens")
    keys, filters, total = [n or 0 for n in sizes.agg(F.sum("k"), F.sum("f"), F.sum("tokens")).first()]
    types = keys // 8
    # Segment by segment into mapped files, so the driver's memory holds none of the model for long.
    lookup = spark.sparkContext.broadcast(
        Lookup(model.orderBy("segment").toLocalIterator(), segments, types, filters, _mapped))
    # Scores are written at once, so driver, executors and workers can let go of the model.
    try:
        with _small_batches(spark):
            return stored(_score_here(texts, lookup, total, types), "scores")
    finally:
        lookup.destroy()
