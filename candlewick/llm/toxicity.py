"""Toxicity by a support vector machine over a gapped subsequence kernel with Nystroem landmarks."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.common import held_fold

#: Letters of a subsequence, and the span in which they may lie: up to three letters may be skipped.
ORDER, SPAN = 3, 6
#: Each letter of the span counts with this weight, so gaps cost.
DECAY = 0.6
#: Letters are kept in 64 classes; 0 bounds a word.
ALPHABET = 64
LANDMARKS = 192
#: Rows of each label that training reads at most, the first by a hash of the id.
SAMPLE = 3000
#: Clean words that training starts from; three times, half as many hard ones join them.
NEGATIVES = 4000
CHUNK = 2_000_000

#: The places of the second and third letter after the first.
_STEPS = [(i, j) for j in range(2, SPAN) for i in range(1, j)]


def letters(text: str | None) -> np.ndarray:
    """The letters of ``text`` as classes, words bounded by 0.

    A to Z are lower-cased. Characters that are no letters vanish inside a
    word, so separators within an insult do not hide it; blanks bound words, except
    between words of a single letter, which are spelled-out words.
    """
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (code == 32) | ((code >= 9) & (code <= 13))
    ascii_letter = (code >= 97) & (code <= 122)
    keep = blank | ascii_letter | (code >= 0xAA)
    code, blank = code[keep], blank[keep]
    out = np.where(code < 128, code - 96, 27 + code % (ALPHABET - 27)).astype(np.int64)
    out[blank] = 0
    out = np.concatenate([[0], out, [0]])
    edge = np.concatenate([[True], (out[1:] != 0) | (out[:-1] != 0)])
    out = out[edge]  # runs of blanks are one
    mid = np.zeros(len(out), bool)
    if len(out) > 4:
        # A bound between two single letters: 0 x 0 y 0.
        mid[2:-2] = (out[2:-2] == 0) & (out[:-4] == 0) & (out[4:] == 0)
    return out[~mid]


def word_of(text: str) -> np.ndarray:
    return letters(text)


def _norm(lengths: np.ndarray) -> np.ndarray:
    """Length of a word's feature vector if no subsequence recurs; depends on the word's length alone."""
    squares = np.zeros(len(lengths))
    for _, j in _STEPS:
        squares += np.maximum(lengths - j, 0) * DECAY ** (2 * (j + 1))
    return np.sqrt(np.maximum(squares, 1e-12))


def _codes(code: np.ndarray, i: int, j: int) -> np.ndarray:
    """Codes of the subsequences at 0, i and j from each place."""
    n = max(len(code) - j, 0)
    return (code[:n] * ALPHABET + code[i : n + i]) * ALPHABET + code[j : n + j]


def features(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, subsequence codes and weights of the words' normalised feature vectors."""
    rows, codes, weights = [], [], []
    for row, word in enumerate(words):
        scale = _norm(np.array([len(word)]))[0]
        for i, j in _STEPS:
            if len(word) > j:
                own = _codes(word, i, j)
                rows.append(np.full(len(own), row))
                codes.append(own)
                weights.append(np.full(len(own), DECAY ** (j + 1) / scale))
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)


def insults(toxic: Counter, clean: Counter) -> list[tuple[bytes, int]]:
    """Words far more frequent in toxic texts than chance, strongest first, with their counts.

    ``toxic`` and ``clean`` count the different words that a word follows, not its
    texts: the plain words of a text that many rows copy always follow the same
    word, so they don't come in with the insult that the copies share.
    """
    ours, theirs, found = sum(toxic.values()), sum(clean.values()), []
    for word, k in toxic.items():
        ratio = (k / ours) / ((clean[word] + 0.5) / theirs)
        if k >= 3 and ratio > 8 and k * math.log(ratio) > 10:
            found.append((-k * math.log(ratio), word, k))
    return [(word, k) for _, word, k in sorted(found)]


def kernel(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The gapped subsequence kernel of all pairs: products of normalised subsequence weights."""
    r, c, w = features(right)
    place, at = np.unique(c, return_inverse=True)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(place):
        return out
    columns = np.zeros((len(right), len(place)), np.float32)
    np.add.at(columns, (r, at), w)
    r, c, w = features(left)
    at = np.minimum(np.searchsorted(place, c), len(place) - 1)
    known = place[at] == c
    r, at, w = r[known], at[known], w[known].astype(np.float32)
    edge = np.searchsorted(r, np.arange(0, len(left) + 512, 512))
    for low, x, y in zip(range(0, len(left), 512), edge[:-1], edge[1:]):
        own = np.zeros((min(512, len(left) - low), len(place)), np.float32)
        np.add.at(own, (r[x:y] - low, at[x:y]), w[x:y])
        out[low : low + 512] = own @ columns.T
    return out


class Model:
    """Weights per subsequence, and the line from margins to probabilities."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.table, self.bias, self.slope, self.offset = table.astype(np.float32), bias, slope, offset

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """The greatest margin of a word in each text.

        The machine is linear in kernels with landmarks, and a kernel is a sum over
        subsequences, so a word's margin is a sum of table entries over its norm.
        """
        at, found = 0, [np.zeros(0)]
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and size < CHUNK:
                held.append(letters(texts[at]))
                size += len(held[-1])
                at += 1
            found.append(self.word_margins(held))
        return np.concatenate(found)

    def word_margins(self, texts: list[np.ndarray]) -> np.ndarray:
        """The same for texts that are given as letters already, a bounded number at once."""
        best, at = np.full(len(texts), self.bias), 0
        while at < len(texts):
            held, size, first = [], 0, at
            while at < len(texts) and size < CHUNK:
                held.append(texts[at])
                size += len(held[-1])
                at += 1
            code = np.concatenate(held)
            owner = np.repeat(np.arange(first, at), [len(h) for h in held])
            start = np.nonzero(code == 0)[0]
            # Words share their bounds; the word after the last bound of a text is empty.
            length = np.diff(np.append(start, len(code)))
            total = np.zeros(len(code), np.float32)
            word = np.cumsum(code == 0) - 1
            for i, j in _STEPS:
                n = max(len(code) - j, 0)
                value = self.table[_codes(code, i, j)] * np.float32(DECAY ** (j + 1))
                # All three letters in one word: at most its first and last are bounds.
                inside = (word[j:] == word[:n]) | ((word[j:] == word[:n] + 1) & (code[j:] == 0))
                value[~inside] = 0
                total[:n] += value
            sums = np.add.reduceat(total, start)
            margin = sums / _norm(length + 1.0) + self.bias
            np.maximum.at(best, owner[start], np.where(length > 1, margin, self.bias))
        return best

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -40, 40)))


def spread(words: list[np.ndarray], count: int) -> list[np.ndarray]:
    """``count`` of ``words``: the first, then again and again the one least like those taken."""
    row, code, weight = features(words)
    table = np.zeros(ALPHABET**ORDER)
    nearest = np.zeros(len(words))
    taken = [0]
    while len(taken) < min(count, len(words)):
        own = row == taken[-1]
        np.add.at(table, code[own], weight[own])
        nearest = np.maximum(nearest, np.bincount(row, weight * table[code], len(words)))
        table[code[own]] = 0
        nearest[taken] = np.inf
        taken.append(int(np.argmin(nearest)))
    return [words[i] for i in taken]


def _pairs(text: str) -> set[tuple[bytes, bytes]]:
    """Each word after each other, as byte strings of their classes with bounds."""
    code = letters(text)
    bound = np.nonzero(code == 0)[0]
    code = code.astype(np.uint8)
    own = [code[a : b + 1].tobytes() for a, b in zip(bound[:-1], bound[1:])]
    return {(before, word) for before, word in zip([b"", *own], own) if len(word) > 3}


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, penalty: float = 0.1, rounds: int = 60) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps on its active rows."""
    one = np.hstack([x, np.ones((len(x), 1))])
    ridge = penalty * np.eye(one.shape[1])
    ridge[-1, -1] = 1e-8
    w = np.zeros(one.shape[1])

    def loss(v: np.ndarray) -> float:
        return float(v @ ridge @ v + (cost * np.maximum(0, 1 - y * (one @ v)) ** 2).sum())

    now = loss(w)
    for _ in range(rounds):
        active = y * (one @ w) < 1
        own, c = one[active], cost[active]
        step = np.linalg.solve(ridge + (own * c[:, None]).T @ own, (own * c[:, None]).T @ y[active]) - w
        best, length = min((loss(w + t * step), t) for t in (1.0, 0.5, 0.25, 0.1, 0.03, 0.01))
        if best > now * (1 - 1e-6):
            break
        w, now = w + length * step, best
    return w[:-1], float(w[-1])


def train(rows: list[tuple[str | None, int]], seed: int = 3) -> Model:
    """A model from labelled texts.

    A text is a bag of words, and toxic if one of its words is. Words typical of
    toxic texts are positive examples; words of clean texts are negative ones, half
    of them those nearest to the positive ones. Landmarks come from both. Without both labels every score is 0.
    """
    rng = np.random.default_rng(seed)
    rows = sorted(set((text or "", label) for text, label in rows))  # a copied text says no more than one
    total = [sum(1 for _, label in rows if label == k) for k in (0, 1)]
    if not all(total):
        return Model(np.zeros(ALPHABET**ORDER), -1.0, 0.0, -40.0)
    held, seen_pairs = [Counter(), Counter()], [set(), set()]
    for text, label in rows:
        for pair in _pairs(text):
            mark = zlib.crc32(pair[0]) << 32 | zlib.crc32(pair[1])  # a number takes less room than two strings
            if mark not in seen_pairs[label]:
                seen_pairs[label].add(mark)
                held[label][pair[1]] += 1
    del seen_pairs
    ranked = insults(held[1], held[0])[:1500]
    positive = [word for word, _ in ranked]
    if not positive:
        return Model(np.zeros(ALPHABET**ORDER), -1.0, 0.0, -40.0)
    clean = sorted(held[0])
    decode = lambda ws: [np.frombuffer(w, np.uint8).astype(np.int64) for w in ws]
    chosen = decode(positive[: LANDMARKS // 4])
    if len(positive) > LANDMARKS // 4:
        chosen += spread(decode(positive[LANDMARKS // 4 :]), LANDMARKS // 4)
    landmark = chosen + decode([clean[i] for i in rng.choice(
        len(clean), min(LANDMARKS // 2, len(clean)), replace=False)])
    # Nystroem: kernels with the landmarks, whitened by the landmarks' own kernel matrix.
    value, vector = np.linalg.eigh(kernel(landmark, landmark).astype(float))
    use = value > 1e-6 * value.max()
    whiten = vector[:, use] / np.sqrt(value[use])
    r, c, v = features(landmark)
    known = decode(positive)
    # The same with a letter put in.
    spoiled = [np.insert(w, rng.integers(2, len(w) - 1), rng.integers(1, 27)) for w in known if len(w) > 5]
    typical = set(positive)
    # Clean words: the most frequent ones, then, again and again, those that the machine takes for insults.
    negative = [w for w, _ in sorted(held[0].items(), key=lambda item: (-item[1], item[0]))[:NEGATIVES]
                if w not in typical]
    seen, words = set(negative) | typical, kernel(known + spoiled, landmark) @ whiten
    others, pool = kernel(decode(negative), landmark) @ whiten, decode(clean)
    frequent = np.array([held[0][word] for word in negative])
    for again in (True, True, False):
        # Both labels weigh the same; within each, frequent words weigh more.
        weight, plain = np.minimum([k for _, k in ranked], 30).astype(float), np.ones(len(frequent))
        cost = np.concatenate([
            weight * plain.sum() / weight.sum(), np.full(len(spoiled), 0.3 * plain.sum() / max(1, len(spoiled))), plain])
        x = np.vstack([words, others])
        w, bias = _svm(x, np.where(np.arange(len(x)) < len(words), 1.0, -1.0), cost)
        table = np.zeros(ALPHABET**ORDER)
        np.add.at(table, c, (whiten @ w)[r] * v)
        model = Model(table, bias, 1.0, 0.0)
        if again:
            margin = model.word_margins(pool)
            hard = [int(i) for i in np.argsort(-margin, kind="stable")[: NEGATIVES // 2] if clean[i] not in seen]
            seen.update(clean[i] for i in hard)
            frequent = np.append(frequent, [held[0][clean[i]] for i in hard])
            others = np.vstack([others, kernel([pool[i] for i in hard], landmark) @ whiten])
    # A line through the margins of whole texts (Platt), by Newton steps. Clean texts are the rule, so they weigh more.
    # Toxic labels that no typical word explains are left out: they would pull the line down for all.
    fit = [(text, k) for text, k in rows if not k or any(word in typical for _, word in _pairs(text))]
    margin = model.margins([text for text, _ in fit])
    label = np.array([float(k) for _, k in fit])
    target = np.where(label > 0, (total[1] + 1) / (total[1] + 2), 1 / (total[0] + 2))
    cost = np.where(label > 0, 1.0, 1.5)
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g = np.array([(cost * (p - target) * margin).sum() + 1e-3 * a, (cost * (p - target)).sum()])
        q = cost * p * (1 - p)
        h = np.array([[(q * margin * margin).sum() + 1e-3, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    model.slope, model.offset = float(max(a, 0)), float(b)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``sample`` labelled texts per label, the first by a hash of the id, outside the held-out fold."""
    label = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("y")).where(
        "l_id IS NOT NULL AND y IN (0, 1)").where(held_fold(F.col("l_id"), 3) != 1)
    picked = label.where("y = 0").orderBy(F.xxhash64("l_id")).limit(sample).unionByName(
        label.where("y = 1").orderBy(F.xxhash64("l_id")).limit(sample))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(picked), F.col("doc_id") == F.col("l_id"))
    return [(r[0], r[1]) for r in text.select("text", "y").orderBy("doc_id", F.xxhash64("text")).collect()]


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``.

    Trained on a bounded sample of labelled rows whose id hash modulo 3 is not
    1; scored over every whole text, from the text alone. A null or empty text scores as a
    text without an insult. A null id hashes as an empty text and has no label; repeated
    rows are scored each; conflicting labels of one id are both seen. Without
    labels of both kinds all scores are 0. Other columns are ignored; an
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(training_rows(docs, labels, sample)))
    schema = "doc_id long, held_out boolean, score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"],
                                "score": model.value.scores(batch["text"].tolist())})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                         (held_fold(F.col("doc_id"), 3) == 1).alias("held_out")).mapInPandas(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
