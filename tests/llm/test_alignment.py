"""Token alignment against loops over the tokens of each text."""

import collections
import hashlib
import os
import random

import numpy as np
import pytest

from candlewick.llm import alignment

pytestmark = pytest.mark.skipif(not os.path.isdir(alignment.TOKENIZERS), reason="no vocabularies")
SCHEMA = "doc_id long, text string, run long, slot int, kind int, pairs string"


def brute(texts):
    """Per text, as the contract says it, with HF and SentencePiece called one text at a time."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/piece_bpe_32k.model")
    letters = alignment._byte_letters()
    found, counts = [], collections.Counter()
    for text in texts:
        if not text:
            found.append(None)
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                   else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            found.append(None)
            continue
        end_a, end_b = [], []
        for ends, parts in ((end_a, bytes_a), (end_b, bytes_b)):
            for p in parts:
                ends.append((ends[-1] if ends else 0) + len(p))
        links = [(ids_b[j], ids_a[i]) for i, x in enumerate(end_a) for j, y in enumerate(end_b) if x == y]
        cut, groups, i, j = sorted(set(end_a) & set(end_b)), [], 0, 0
        for c in cut:
            ga, gb = [], []
            while i < len(end_a) and end_a[i] <= c:
                ga.append(str(ids_a[i]))
                i += 1
            while j < len(end_b) and end_b[j] <= c:
                gb.append(str(ids_b[j]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        counts.update(links)
        found.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    most = collections.Counter()
    for (side, _), n in counts.items():
        most[side] = max(most[side], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n_groups, links, text = f
            out.append((n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[0]] for x in links),
                        sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def texts():
    rng = random.Random(5)
    words = "the of naïve café Straße größer \U0001f600 日本語 x1 2024 <|endoftext|> <s> </s> <0x41> foo_bar ... \t \n  don't".split(" ")
    own = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return [None, "", " ", "\n\n", "a▁b", "word " * 3000, "é" * 500, "same text", "same text", "\x00\x01﻿", "ﬁ Å", *own]


@pytest.mark.parametrize("run_links,fan_in", [(500_000, 64), (200, 3)], ids=["one run", "many runs"])
def test_against_loops(spark, run_links, fan_in):
    rows = [(None if i == 4 else i // 2, t, 1, 2, 3, "x") for i, t in enumerate(texts())]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = alignment.align(frame, run_links=run_links, fan_in=fan_in).collect()
    expected = [(r[0], *values) for r, values in zip(rows, brute([r[1] for r in rows]))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_every_code_point_is_encoded_as_by_the_file_itself():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{alignment.TOKENIZERS}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    aligner = alignment.Aligner()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" " + " ".join(f"a{c}1 {c}{c}\n{c} 'll{c}x" for c in points[i:i + 40]) for i in range(0, len(points), 40)]
    for text, found in zip(texts, own.encode_batch_fast(texts, add_special_tokens=False)):
        assert aligner.a.encode_ordinary(text) == found.ids


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).collect() == []


def test_runs_keep_their_numbers_and_merge_in_order(monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 7)
    rng = np.random.default_rng(1)
    runs, expected = [], collections.Counter()
    for _ in range(5):
        pairs = np.unique(rng.integers(0, 50, 30)) << 32 | 5
        counts = rng.integers(1, 9, len(pairs))
        runs.append(alignment.pack(pairs, counts))
        expected.update(dict(zip(pairs.tolist(), counts.tolist())))
        assert [c.tolist() for c in alignment.unpack(runs[-1], 2)] == [pairs.tolist(), counts.tolist()]
    assert list(alignment.merge(runs)) == sorted(expected.items())


def test_maxima_keep_ties():
    merged = [(1 << 16 | 1, 4), (1 << 16 | 2, 4), (1 << 16 | 3, 1), (2 << 16 | 1, 1)]
    assert [flag for _, _, flag in alignment.with_maxima(merged)] == [1, 1, 0, 1]
