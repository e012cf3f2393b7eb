"""Corpus operators on small tables: against brute force, and on empty, null, repeated and clashing input."""

import collections
import math
import os
import pickle
import random
import re
import tempfile
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from candlewick.llm import bloom_lm, near_dedup, pii, toxicity
from candlewick.llm.common import scratch
from candlewick.llm.decontaminate import leaks
from candlewick.llm.graph import components
from candlewick.llm.line_dedup import line_dedup
from candlewick.llm.mixing import mix
from candlewick.llm.quality import quality, reject
from candlewick.llm.secrets import secret_spans, secrets
from candlewick.llm.sharding import communication_matrix, hypergeometric, shard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, version long, row string, size long"
WORDS = [a + b for a in "ka lo mi nu te sa ro vi".split() for b in "ran dol mep tis gul".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def make(spark):
    def build(rows):
        """Rows of (id, text) or (id, text, source); the other columns clash with names used inside."""
        return spark.createDataFrame(
            [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", 5) for r in rows], SCHEMA)

    return build


ODD = [(1, None), (2, ""), (3, " \n\t"), (None, "no id here at all, only words"), (4, "same text in two rows"),
       (4, "same text in two rows"), (5, "long " * 30000), (6, "\U0001f600 ünïcode \x0b text"), (7, "\n" * 50)]


def sharded(d):
    return shard(d, 3).select("row.*", "shard", "slot")


OPERATORS = {
    "line_dedup": line_dedup, "quality": quality, "reject": reject, "secrets": secrets, "pii": pii.pii,
    "mix": lambda d: mix(d).select("row.*", "copy"), "shard": sharded, "bloom": bloom_lm.score,
    "near": lambda d: near_dedup.near_duplicates(d, 2),
    "leaks": lambda d: leaks(d, d.selectExpr("doc_id AS item_id", "text")),
    "toxicity": lambda d: toxicity.toxicity(d, d.selectExpr("doc_id", "cast(doc_id % 2 as int) AS toxic")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(make, name):
    out = OPERATORS[name](make(ODD)).collect()
    if name in ("line_dedup", "quality", "secrets", "pii", "bloom", "near", "toxicity", "shard"):
        assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ODD)
    assert OPERATORS[name](make([])).collect() == []


def test_line_dedup_keeps_first_holder(make):
    out = {r["doc_id"]: r for r in line_dedup(make([
        (2, "A shared line here\nown two"), (1, "  a SHARED line here \nown one\nA shared line here"), (3, None)])).collect()}
    assert out[1]["text"] == "  a SHARED line here \nown one\nA shared line here"
    assert (out[2]["text"], out[2]["n_lines"], out[2]["n_dropped"]) == ("own two", 2, 1)
    assert (out[3]["text"], out[3]["n_lines"]) == ("", 1)


def test_quality_windows_against_brute_force(make):
    rng = random.Random(1)
    docs = [(i, prose(rng, rng.randint(0, 30)) + (" a b c d e" * rng.randint(0, 3))) for i in range(60)]
    for r in quality(make(docs)).collect():
        w = dict(docs)[r["doc_id"]].split()
        seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        cover = {i + j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(5)}
        assert r["n_repeat_words"] == len(cover)
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w))


def test_quality_rejects_depleted_and_cuts_lines(make):
    rng = random.Random(2)
    line = "This page is the property of the host and its many owners"
    docs = [(i, f"{prose(rng, 40)}\n{line}", "h") for i in range(40)] + [(99, f"tiny text\n{line}", "h")]
    kept = {r["doc_id"]: r for r in reject(make(docs)).collect()}
    assert 99 not in kept and len(kept) == 40
    assert line in kept[0]["text"] and line not in kept[7]["text"]
    assert kept[7]["n_chars"] == len(kept[7]["text"])


def test_secrets_base_and_linked_parts(make):
    text = ("é password = 'hunter22secret' and deadbeef" + "ab" * 10 + " AKIA" + "Z" * 16)
    alone, far = "client_id = someone77 is alone", "client_id = someone77" + " x" * 300 + " pwd = abcdef123"
    both = "client_id = someone77, pwd: abcdef123 at https://api.example.org/x"
    out = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
           for r in secrets(make([(1, text), (2, alone), (3, far), (4, both)])).collect()}
    assert out[1] == [("assign", 2, text.index("' and")), ("hex", text.index("deadbeef"), text.index("deadbeef") + 28),
                      ("access", text.index("AKIA"), len(text))]
    assert out[2] == [] and out[3] == []
    assert [k for k, _, _ in out[4]] == ["weak_id", "weak_secret", "endpoint"]
    assert [both[a:b] for _, a, b in out[4]][0] == "client_id = someone77"


def test_secret_positions_in_a_text_of_many_matches(make):
    text = "token=abcdef1 " * 20000
    rows = secret_spans(make([(1, text)])).collect()
    assert sorted(r["start"] for r in rows) == [m.start() for m in re.finditer("token", text)]


def exact_groups(docs, size):
    sets = {}
    for i, t in docs:
        w = (t or "").lower().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            k = len(sets[a] & sets[b])
            if sets[a] and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [16, 512])
def test_near_duplicates_against_brute_force(make, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(3)
    base = [prose(rng, 60).split() for _ in range(8)]
    docs = []
    for i in range(220):
        w = list(base[0 if i % 3 else rng.randrange(8)])
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        docs.append((i, " ".join(w)))
    docs += [(500, docs[3][1]), (501, ""), (502, "one"), (503, "one"), (504, prose(rng, 60))]
    rng.shuffle(docs)
    want = exact_groups(docs, 2)
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(make(docs), 2).collect()} == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r[0]: r[1] for r in components(edges).collect()} == {
        **{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_circulant_signature_estimates_similarity():
    from candlewick.llm.shingles import circulant_signature
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = circulant_signature(pool[:1000], 1024), circulant_signature(pool[200:], 1024)
    assert abs((a == b).mean() - 800 / 1200) < 0.06


def test_leaks_find_items_and_nothing_else(make, spark):
    rng = random.Random(4)
    items = [(k, prose(rng, 20 + k)) for k in range(12)]
    edited = items[11][1].split()
    docs = [(1, f"{prose(rng, 50)} {items[3][1].upper()}, {prose(rng, 30)}"), (2, prose(rng, 400)), (3, items[5][1]),
            (4, prose(rng, 30) + " " + " ".join(edited[:-1]) + " " + prose(rng, 9)), (5, " ".join(items[7][1].split()[:8]))]
    found = {(r["doc_id"], r["item_id"]) for r in leaks(
        make(docs), spark.createDataFrame(items + [(90, None), (91, "")], "item_id long, text string")).collect()}
    assert found == {(1, 3), (3, 5), (4, 11)}


def test_bloom_scores_both_paths_and_exact_base(make):
    rng = random.Random(5)
    docs = [(i, prose(rng, rng.randint(0, 40))) for i in range(80)] + [(3, "repeated row"), (None, "no id")]
    here = sorted(bloom_lm.score(make(docs)).collect(), key=str)
    there = sorted(bloom_lm.score(make(docs), broadcast_bytes=0).collect(), key=str)
    counts = collections.Counter()
    for i, t in docs:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(t.split() + ["\n"])
    total, types = sum(counts.values()), len(counts)
    texts = collections.defaultdict(list)
    for i, t in docs:
        texts[i].append(t)
    by = lambda rows: sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows)
    assert by(here) == by(there)
    for r in here:
        if len(texts[r["doc_id"]]) == 1:
            w = texts[r["doc_id"]][0].split() + ["\n"]
            assert r["train_tokens"] == total and r["n_tokens"] == len(w)
            assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w), rel_tol=1e-9)


def test_bloom_scores_of_chunks_are_those_of_a_broadcast_model(make, monkeypatch):
    """Odd rows, many chunks, and texts that go on in further chunks."""
    rng = random.Random(31)
    docs = [*ODD, *((10 + i, prose(rng, rng.randint(0, 60))) for i in range(150)),
            *((200 + i, " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(110_000))) for i in range(2))]
    frame = make(docs).repartition(3)
    monkeypatch.setattr(bloom_lm, "STORED_CHUNK", 300)
    by = lambda rows: sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    here, there = bloom_lm.score(frame), bloom_lm.score(frame, broadcast_bytes=0)
    assert here.dtypes == there.dtypes
    assert len(by(here.collect())) == len(docs) and by(here.collect()) == by(there.collect())


def test_bloom_chunks_take_little_disk(make, spark):
    """Stored chunks and answers, and what is shuffled: less than twice the texts; 16 times when each lookup was a row."""
    rng = random.Random(32)
    docs = [(i, " ".join("w" + str(int(rng.paretovariate(0.7))) for _ in range(300))) for i in range(1200)]
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shared = os.path.dirname(scratch(spark, "x"))

    def disk():
        files = local.getAllFiles()
        found = {str(f): f.length() for f in (files.apply(i) for i in range(files.size()))}
        return found | {f: os.path.getsize(f) for at, _, names in os.walk(shared.removeprefix("file:")) for f in (f"{at}/{x}" for x in names)}

    frame, before = make(docs), disk()
    scored = bloom_lm.score(frame, broadcast_bytes=0)
    assert len(scored.collect()) == len(docs)
    size = sum(n for name, n in disk().items() if name not in before)
    assert 0 < size < 2 * sum(len(t) for _, t in docs)


@pytest.mark.parametrize("segments", [1, 32, 33, 5000])
def test_bloom_packed_keys_and_counts(segments):
    """Keys of all segments, also of those without any, come back from their distances."""
    rng = np.random.default_rng(segments)
    for n in (0, 1, 2, 700):
        keys = np.unique(np.append(rng.integers(0, 2**64, n, dtype=np.uint64), np.array([0, 2**64 - 1][:n], np.uint64)))
        base = bloom_lm.floors(np.arange(segments), segments)
        assert (bloom_lm.segment_of(base, segments) == np.arange(segments)).all()
        assert (bloom_lm.segment_of(base[1:] - np.uint64(1), segments) == np.arange(segments - 1)).all()
        starts = np.searchsorted(keys, base)
        packed, width = bloom_lm._narrow(bloom_lm._gaps(keys, starts, base), starts)
        back = [base[s] + np.cumsum(bloom_lm._wide(x, width), dtype=np.uint64) for s, x in enumerate(packed.to_pylist())]
        assert len(back) == segments and np.concatenate(back).tolist() == keys.tolist()
        assert all((bloom_lm.segment_of(x, segments) == s).all() for s, x in enumerate(back))
    for most in (0, 255, 256, 2**40):
        packed, width = bloom_lm._narrow(np.array([most, 0, 3]), np.array([0, 0, 1]))
        assert width == max(1, -(-most.bit_length() // 8))
        assert [bloom_lm._wide(x, width).tolist() for x in packed.to_pylist()] == [[], [most], [0, 3]]


def test_bloom_scores_against_exact_bigram_counts(make):
    """False counts only raise a score, and few texts have one."""
    rng = random.Random(21)
    docs = [(i, prose(rng, rng.randint(0, 8))) for i in range(300)]
    train = [t.split() for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    ends = collections.Counter(w for t in train for w in [*t, None])
    pairs = collections.Counter(p for t in train for p in zip([0, *t], [*t, None]))
    total, types, equal = sum(ends.values()), len(ends), 0
    low = {n: bloom_lm.level_count(bloom_lm.level(np.array([n])))[0] for n in {*pairs.values()}}
    for r in bloom_lm.score(make(docs)).collect():
        words, exact = dict(docs)[r["doc_id"]].split(), 0.0
        for h, w in zip([0, *words], [*words, None]):
            before = ends[None] if h == 0 else ends[h]
            pair = min(low.get(pairs[h, w], 0), before, ends[w])
            exact += math.log10((pair + bloom_lm.BACKOFF * (ends[w] + 1) / (total + types + 1)) / (before + bloom_lm.BACKOFF))
        assert r["score"] >= exact - 1e-9
        equal += abs(r["score"] - exact) < 1e-9
    assert equal >= 0.85 * len(docs)


def test_bloom_training_ships_packed_counts(make, capfd):
    """Many partitions and several chunks in one of them: exact sums, and no row per n-gram in the shuffle."""
    rng = random.Random(9)
    docs = [(i, prose(rng, rng.randint(0, 30))) for i in range(200)] + [(500, prose(rng, 300_000)), (501, prose(rng, 300_000)), (502, "End")]
    model = bloom_lm.train(make(docs).coalesce(2).union(make(docs[:50]).repartition(5)), 40)
    model.explain()
    plan = capfd.readouterr().out
    assert "FlatMapGroupsInArrow" in plan and "Aggregate" not in plan
    words, pairs = collections.Counter(), collections.Counter()
    for _, text in [*docs, *docs[:50]]:
        token = bloom_lm.tokens(text.encode())
        words.update(token.tolist())
        pairs.update(bloom_lm.bigram_keys(bloom_lm.histories(token), token).tolist())
    rows = model.orderBy("segment").collect()
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows])
    assert dict(zip(keys.tolist(), counts.tolist())) == words and len(keys) == len(words) and (np.diff(keys.astype(object)) > 0).all()
    assert sum(r["tokens"] for r in rows) == words.total()
    key, n = np.array([*pairs], np.uint64), np.array([*pairs.values()])
    for r in rows:
        own = bloom_lm.segment_of(key, 40) == r["segment"]
        assert r["filter"] == bloom_lm.build_filter(key[own], n[own], r["probes"]).tobytes()


def test_bloom_remembered_levels_change_nothing(monkeypatch):
    """More pairs than places, asked again and again, known and unknown."""
    monkeypatch.setattr(bloom_lm, "REMEMBERED", 64)
    rng = np.random.default_rng(8)
    keys, counts = np.unique(rng.integers(0, 2**63, 900).astype(np.uint64)), rng.geometric(0.1, 900)
    table = bloom_lm.build_filter(keys[:600], counts[:600])
    row = {"segment": 0, "keys": b"", "counts": b"", "probes": bloom_lm.PROBES, "filter": table.tobytes()}
    lookup = bloom_lm.Lookup([row], 1, 0, len(table))
    plain = bloom_lm.level_count(bloom_lm.probe_levels(keys, lookup.filters, lookup.starts, lookup.bits, lookup.probes))
    for _ in range(20):
        some = rng.permutation(len(keys))[:300]
        assert (lookup.bigrams(keys[some]) == plain[some]).all()


def test_bloom_driver_holds_no_model(spark, monkeypatch):
    """As it is broadcast, and as it is pickled, the model's arrays take none of the driver's memory."""
    docs = spark.range(800).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 300), x -> md5(concat(id, ':', x)))) AS text")
    sent, send = [], spark.sparkContext.broadcast

    def broadcast(value):
        own = tracemalloc.take_snapshot().filter_traces([tracemalloc.Filter(True, bloom_lm.__file__)])
        before, _ = tracemalloc.get_traced_memory()
        tracemalloc.reset_peak()
        with tempfile.TemporaryFile() as file:
            pickle.dump(value, file, pickle.HIGHEST_PROTOCOL)
            sent.append((sum(t.size for t in own.traces), tracemalloc.get_traced_memory()[1] - before, file.tell()))
        return send(value)

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    tracemalloc.start()
    try:
        frame = bloom_lm.score(docs)
    finally:
        tracemalloc.stop()
    [(held, copied, size)] = sent
    assert size > 12 * 200_000 and held < size / 4 and copied < size / 4  # 200,000 words and more, each with its hash and count
    assert frame.where("n_tokens <> 301 OR n_known <> IF(held_out, 1, 301)").count() == 0


def test_bloom_lets_go_of_the_model_and_keeps_the_session(make, spark, monkeypatch):
    """Once a frame is returned its model is gone everywhere, batches were small, and the setting is as it was."""
    name, sent, rows, send, count = "spark.sql.execution.arrow.maxRecordsPerBatch", [], [], spark.sparkContext.broadcast, bloom_lm._score_here
    docs = [(i, f"w{i} a b") for i in range(40)]
    whole = sorted(bloom_lm.score(make(docs)).collect())

    def seen(frame, *rest):
        rows.append(spark.conf.get(name))
        return count(frame, *rest)

    monkeypatch.setattr(bloom_lm, "TEXTS", 3)
    monkeypatch.setattr(bloom_lm, "_score_here", seen)
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: sent.append(send(value)) or sent[0])
    before = spark.conf.get(name)
    frame = bloom_lm.score(make(docs))
    assert rows == ["3"] and spark.conf.get(name) == before
    assert len(sent) == 1 and not os.path.exists(sent[0]._path)
    assert sorted(frame.collect()) == whole


@pytest.mark.parametrize("large", [0, 1, 2])
def test_bloom_counts_beyond_32_bits(large):
    words = np.arange(1, 7, dtype=np.uint64)
    counts = np.array([5, 6, 7, 8, 2**32 - 1, 9]) + [2**32 if large == at // 2 + 1 else 0 for at in range(6)]
    rows = [{"segment": at, "keys": words[2 * at:2 * at + 2].tobytes(), "counts": counts[2 * at:2 * at + 2].tobytes(),
             "probes": bloom_lm.PROBES, "filter": b"\0" * 8} for at in range(3)]
    for lookup in (bloom_lm.Lookup(rows, 3, 6, 24), pickle.loads(pickle.dumps(bloom_lm.Lookup(rows, 3, 6, 24, bloom_lm._mapped)))):
        assert lookup.unigrams(np.append(words, words[-1:] + np.uint64(1))).tolist() == [*counts.tolist(), 0]
        assert lookup.counts.dtype == (np.int64 if large else np.uint32)
    assert not bloom_lm.Lookup([], 3, 0, 0, bloom_lm._mapped).unigrams(words).any()


def test_bloom_pieces_hold_all_tokens_with_their_histories(monkeypatch):
    """Texts longer than a piece go on in the next one, after the word that came before."""
    monkeypatch.setattr(bloom_lm, "CHUNK", 5)
    rng = random.Random(3)
    bodies = [prose(rng, n).encode() if n else None for n in (0, 1, 4, 5, 6, 23, 0, 2, 40, 0)]
    got = collections.defaultdict(lambda: ([], []))
    for row, first, token, history in bloom_lm._pieces(pa.array(bodies, pa.binary())):
        assert len(token) == len(history) < 10
        for r, start, end in zip(row, first, [*first[1:], len(token)]):
            got[r][0].extend(token[start:end])
            got[r][1].extend(history[start:end])
    for row, body in enumerate(bodies):
        token = bloom_lm.tokens(body)
        assert got[row] == ([*token], [*bloom_lm.histories(token)])


@pytest.mark.parametrize("types", [50, 3000, 200_000])
def test_bloom_rows_sum_to_one(types):
    """Rare and frequent histories, over the whole vocabulary: false counts add little, quantised counts nothing."""
    rng = np.random.default_rng(types)
    word = rng.integers(1, 2**63, types).astype(np.uint64)
    history, token = rng.integers(0, types, (2, 400_000))
    token = np.minimum(token, rng.integers(0, types, len(token)))
    token[:50_000], history[:50_000] = token[:50_000] % 7, 0  # one history of 50,000, before few words
    held = np.bincount(history, minlength=types)
    count = np.bincount(token, minlength=types)
    keys, pairs = np.unique(bloom_lm.bigram_keys(word[history], word[token]), return_counts=True)
    probes = bloom_lm.probes_for(types)
    table = bloom_lm.build_filter(keys, pairs, probes)
    unigram = (count + 1) / (count.sum() + types + 1)
    for h in [0, *np.argsort(held, kind="stable")[:20], *np.argsort(-held)[:5]]:
        pair = bloom_lm.level_count(bloom_lm.probe_levels(
            bloom_lm.bigram_keys(np.full(types, word[h]), word), table,
            np.array([0]), np.array([8 * len(table)]), np.array([probes])))
        assert bloom_lm._probability(pair, np.full(types, held[h]), count, unigram).sum() < 1 + 2 * bloom_lm.EXCESS


def test_bloom_filter_levels_have_no_false_negatives():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    counts = rng.geometric(0.2, 5000)
    table = bloom_lm.build_filter(keys, counts)
    found = bloom_lm.probe_levels(keys, table, np.array([0]), np.array([8 * len(table)]), np.array([bloom_lm.PROBES]))
    assert (found >= bloom_lm.level(counts)).all() and (found > bloom_lm.level(counts)).mean() < 0.05
    other = rng.integers(0, 2**63, 5000).astype(np.uint64)
    assert (bloom_lm.probe_levels(other, table, np.array([0]), np.array([8 * len(table)]), np.array([bloom_lm.PROBES])) > 0).mean() < 0.05


def test_pii_base_against_plain_patterns():
    rng = random.Random(6)
    pieces = ["a.b@c-d.e.f", "x@y", "@@a@b.c", "1.2.3.4.5", "256.1.1.1", "010.0.0.255", "4111 1111 1111 1111", "4111-1111-1111-1112",
              "+1 (234) 555-6789", "+12", "79927398713000", " ", "\n", "word", "é", "4111111111111111", "..", "%+@z.z"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        want = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        want += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
                 if max(map(int, m[0].split("."))) <= 255]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            digits = re.sub("[ -]", "", m[0])
            if 14 <= len(digits) <= 19 and pii.luhn(digits):
                want.append((m.start(), 2, m.end()))
        want += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                 if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        assert pii.base_spans(text) == sorted(want)


def test_field_labels_held_out_sentences_and_adds_spans(make):
    field = pii.train_field(pii.labelled_table())
    right = total = 0
    for words, labels in pii.labelled_table(120, seed=99):
        got = field.decode([pii._observations(words)])[0]
        right += sum(pii.LABELS[a] == b for a, b in zip(got, labels))
        total += len(words)
    assert right / total > 0.95
    row = pii.pii(make([(1, "please call (212) 555-0199 or write to some.one@example.com today")])).first()
    assert "crf_phone" in row["kinds"] and "email" in row["kinds"]


def test_field_labels_long_runs_as_a_whole():
    field = pii.train_field(pii.labelled_table())
    rng = random.Random(12)
    score, length = rng_scores(rng, 700), [1, 63, 64, 65, 200, 307]
    first = np.isin(np.arange(700), np.cumsum([0] + length[:-1]))
    want, at = [], 0
    for n in length:  # word by word
        best, back = score[at], []
        for t in range(at + 1, at + n):
            step = best[:, None] + field.move
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + score[t]
        path = [best.argmax()]
        for b in reversed(back):
            path.append(b[path[-1]])
        want += path[::-1]
        at += n
    assert field.chain(score, first).tolist() == want
    for entity in ("(212) 555-0199", "jane42 (at) host (dot) org", "4111 2222 3333 4445"):
        for before in range(54, 70):
            text = " ".join(["12", "v1.2.3"] * 40)
            text = " ".join(text.split()[:before] + [entity] + text.split()[:40])
            found = [text[a:b] for a, _, b in pii.field_spans([text], field)[0]]
            assert found == [entity], (before, found)


def test_field_sees_words_without_digit_or_at_sign(make):
    field = pii.train_field(pii.labelled_table())
    rng = random.Random(13)
    texts = [" ".join(rng.choice(["^", "$", "at", "12", "Abc,", "x.y", "(at)", "555-01", "é", "call"]) for _ in range(n)) for n in (1, 2, 9, 80)]
    words = [t.split() for t in texts]
    first = np.isin(np.arange(92), np.cumsum([0] + [len(w) for w in words[:-1]]))
    want = np.concatenate([field.emit[np.array(pii._observations(w))].sum(axis=1) for w in words])
    assert np.allclose(pii.WordScores(field.emit).scores(sum(words, []), first), want)
    entities = ["janed[at]hostly[dot]com", "janed (at) hostly (dot) org", "janed [at] hostly [dot] net", "janed(at)hostly.com",
                "jane42 (at) hostly (dot) org"]
    out = pii.pii(make([(i, f"karan mintep {e} ladol sagul") for i, e in enumerate(entities)])).collect()
    for r in out:
        at = 13
        assert (r["kinds"], r["starts"], r["ends"]) == (["crf_email"], [at], [at + len(entities[r["doc_id"]])])


def rng_scores(rng, n):
    return np.array([[rng.gauss(0, 3) for _ in pii.LABELS] for _ in range(n)])


def test_mix_rates_and_determinism(make):
    rng = random.Random(7)
    docs = make([(i, prose(rng, 10), "big" if i % 4 else "small") for i in range(2000)])
    once = mix(docs, {"big": 1.0, "small": 1.0}).select("row.doc_id", "row.source", "copy").collect()
    assert sorted(once) == sorted(mix(docs, {"big": 1.0, "small": 1.0}).select("row.doc_id", "row.source", "copy").collect())
    n = collections.Counter(r["source"] for r in once)
    assert abs(n["big"] / 1000 - 1) < 0.15 and abs(n["small"] / 1000 - 1) < 0.15
    many = mix(docs.where("doc_id < 40"), {"small": 1.0}, total=30.0).select("row.source").collect()
    assert {r["source"] for r in many} == {"small"} and abs(len(many) / 1200 - 1) < 0.15


def test_hypergeometric_and_matrix():
    rng = random.Random(8)
    draws = [hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(sum(draws) / 4000 - 6) < 0.15 and 0 <= min(draws) and max(draws) <= 20
    matrix = communication_matrix([50, 0, 31, 19], 7, 1)
    assert [sum(r) for r in matrix] == [50, 0, 31, 19]
    assert sorted(map(sum, zip(*matrix))) == [14] * 5 + [15] * 2


def test_shards_are_exact_gapless_and_spread(make):
    docs = make([(i // 2, "copy" if i % 3 else str(i)) for i in range(3000)])
    rows = shard(docs, 7, rows_per_part=100).select("doc_id", "shard", "slot").collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sorted(map(len, by.values())) == [428] * 3 + [429] * 4
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert abs(np.corrcoef([r["doc_id"] for r in rows], [r["shard"] for r in rows])[0, 1]) < 0.06


@pytest.mark.parametrize("rows_per_part", [100, 5000])  # copies made from their count, and numbered
def test_copies_are_spread_over_shards(make, rows_per_part):
    docs = make([(7, "the same row")] * 2400 + [(i // 2, f"text {i // 2}") for i in range(4800)])
    made = shard(docs, 24, rows_per_part=rows_per_part)
    rows = made.select("doc_id", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, shard(
        docs.repartition(3), 24, rows_per_part=rows_per_part, carry=False).select("doc_id", "text_crc32", "shard", "slot").collect()))
    assert made.where("row.doc_id = 7 and row.text = 'the same row'").count() == 2400
    hot = collections.Counter(r["text_crc32"] for r in rows).most_common(1)[0][0]
    assert all(60 < n < 145 for n in collections.Counter(r["shard"] for r in rows if r["text_crc32"] == hot).values())
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(slots) == 24 and all(sorted(s) == list(range(300)) for s in slots.values())
    pairs = collections.defaultdict(list)
    for r in rows:
        if r["text_crc32"] != hot:
            pairs[r["doc_id"]].append(r["shard"])
    assert sum(len(set(p)) == 1 for p in pairs.values()) / len(pairs) < 0.08


def test_toxicity_learns_gapped_insults(make, spark):
    rng = random.Random(9)
    insult = ["blortag", "snivver", "grumpox"]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = prose(rng, 30).split()
        if bad:
            w[rng.randrange(30)] = rng.choice(insult)
            w[rng.randrange(30)] = rng.choice(insult)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    out = toxicity.toxicity(make(rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.97
    model = toxicity.train([(t, dict(labels)[i]) for i, t in rows])
    plain, gapped = model.scores(["karan dol mep", "karan b.l.o.r.t.a.g mep"])
    assert plain < 0.3 < 0.7 < gapped


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    item = prose(rng, 30)
    rows = [(i, prose(rng, 60), "en", f"s{i % 3}", 0) for i in range(60)]
    rows += [(100, rows[0][1] + " karan", "en", "s0", 0), (101, f"{prose(rng, 40)} {item}", "en", "s1", 0), (102, "short", "en", "s2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert seen["quality_rules"] == {r[0] for r in rows} - {102}
    assert seen["near_dedup"] == seen["quality_rules"] - {100}
    assert seen["decontaminate"] == seen["near_dedup"] - {101}
    assert seen["mix_sources"] <= seen["decontaminate"] and seen["shards"] == seen["mix_sources"]
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[-2:] == ["shard", "slot"]
