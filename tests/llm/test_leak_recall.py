"""Passages found by fingerprints against all windows compared exactly, over item lengths and kinds of edits."""

import collections
import random

import numpy as np
import pytest

from candlewick.llm.decontaminate import SIZE, ItemIndex, normal_words, simhash, votes
from candlewick.llm.shingles import shingle_row

EDITS = ("one word repeated", "other words", "left out", "put in", "scattered", "none")


def edited(rng, words, kind, most):
    out, n = list(words), rng.randint(1, max(1, int(most * len(words))))
    at = rng.randrange(len(out) - n + 1)
    if kind == "one word repeated":
        out[at:at + n] = [rng.choice(out)] * n
    elif kind == "other words":
        out[at:at + n] = [f"new{rng.randrange(10**6)}" for _ in range(n)]
    elif kind == "left out":
        del out[at:at + n]
    elif kind == "put in":
        out[at:at] = [f"new{rng.randrange(10**6)}" for _ in range(n)]
    elif kind == "scattered":
        for at in rng.sample(range(len(out)), max(1, n // 4)):
            out[at] = f"new{at}"
    return out


def exact(index, text, least):
    """Best similarity per item, over all windows."""
    words, found = normal_words(text), collections.defaultdict(float)
    for item, length in enumerate(index.length.tolist()):
        size, k = min(length, len(words)), min(SIZE, length)
        row = shingle_row(words, k)
        for start in range(len(words) - size + 1):
            score = index.similarity(frozenset(row[start:start + max(1, size - k + 1)].tolist()), item)
            if score >= least:
                found[index.ids[item]] = max(found[index.ids[item]], score)
    return found


@pytest.mark.parametrize("length", [5, 16, 60, 150, 300])
def test_recall_over_edits(length):
    rng = random.Random(length)
    common = [f"w{i}" for i in range(400)]
    word = lambda: common[min(399, int(rng.paretovariate(0.6)))] if rng.random() < 0.5 else rng.choice(common)
    items = [(i, [word() for _ in range(length)]) for i in range(6)]
    index = ItemIndex([(i, " ".join(w)) for i, w in items])
    sought = collections.Counter()
    lost = collections.Counter()
    for kind in EDITS:
        for trial in range(40):
            item = rng.choice(items)[1]
            text = " ".join([word() for _ in range(20)] + edited(rng, item, kind, 0.12) + [word() for _ in range(20)])
            got = index.search(text, 0.8)
            want = exact(index, text, 0.8)
            assert set(got) <= set(want)
            sought[kind] += len(want)
            lost[kind] += len(set(want) - set(got))
    assert sum(sought.values()) >= 60 and sought["none"] >= 40
    assert lost["none"] == 0
    assert sum(lost.values()) <= 0.01 * sum(sought.values()), (sought, lost)


def test_fingerprints_of_windows_are_those_of_their_sets():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 2**63, 30).astype(np.uint64)
    at = rng.integers(0, 30, 200)
    at[50:90] = 7
    weight = rng.uniform(1, 5, 30)
    for width in (1, 4, 37, 200):
        starts = np.arange(0, 200 - width + 1, 3)
        got = simhash(pool[at], votes(weight)[at], starts, width)
        for start, found in zip(starts, got):
            own = np.unique(at[start:start + width])
            alone = simhash(pool[own], votes(weight)[own], np.array([0]), len(own))
            assert alone[0] == found
