"""The Merkle manifest against a tree built by plain loops."""

import hashlib
import random
import zlib

import pytest

from candlewick.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, top string, n long, `group` int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)])


def climb(nodes):
    """Root of ``nodes`` and per node the pairs (left, right) on its way up."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, way in enumerate(ways):
            k = at[i] // 8 * 8
            way.append(("".join(level[k:at[i]]), "".join(level[at[i] + 1:k + 8])))
            at[i] //= 8
        level = [digest(*level[k:k + 8]) for k in range(0, len(level), 8)]
    return level[0], ways


def brute(rows):
    def lower(t):
        return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    first = lambda v: (v is not None, v)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    parts, out = [], []
    for lang in langs:
        mine = []
        for r in (r for r in rows if r[2] == lang):
            changed = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 3 == 0 and lower(r[1]) != r[1]
            mine.append((first(r[0]), leaf(r, r[1]), first(leaf(r, lower(r[1])) if changed else None), r[0]))
        mine.sort()
        parts.append((mine, *climb([m[1] for m in mine])))
    root, ways = climb([p[1] for p in parts])
    for (mine, subroot, own), way in zip(parts, ways):
        for (_, good, (_, altered), doc_id), path in zip(mine, own):
            path = path + way
            folded = altered or good
            for left, right in path:
                folded = digest(left, folded, right)
            out.append((doc_id, good, subroot, root, digest(*[a + b for a, b in path]), folded, folded == root))
    return out


def rows_of(counts, seed):
    rng = random.Random(seed)
    rows = []
    for lang, n in counts:
        for _ in range(n):
            text = rng.choice([None, "", "plain", "Ünï Code \U0001f600", "A b C " * rng.randint(1, 5)])
            rows.append((rng.choice([None, rng.randint(-5, 10**6)]) if rng.random() < 0.1 else rng.randint(0, 10**6),
                         text, lang, rng.choice([None, "web:a", ""]), rng.choice([None, 7]), "p", "t", 3, 4))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("counts", [
    [("en", 1)], [("en", 8)], [("en", 9), (None, 1)], [("en", 64), ("de", 65)], [(None, 5), ("é", 73), ("", 2)],
    [("en", 521), ("zz", 7), (None, 16)], [(f"l{i}", 1 + i % 3) for i in range(70)],
], ids=str)
def test_against_loops(spark, counts):
    rows = rows_of(counts, len(counts))
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_repeated_rows_take_consecutive_places(spark):
    rows = [(1, "Same Text", "en", "s", 9, "p", "t", 3, 4)] * 2500 + [(2, "x", "en", None, 1, "p", "t", 3, 4)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute(rows)))


def test_one_changed_letter_breaks_the_proof_and_an_empty_table_is_empty(spark):
    rows = rows_of([("en", 30)], 3)
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["verified"] for r in got} == {True, False} and len({r["root"] for r in got}) == 1
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_windows_see_blocks_only(spark):
    """No window but those over ranges of rows is partitioned by the language alone."""
    rows = rows_of([("en", 70)], 4)
    plan = merkle.manifest(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "lag(" in line]
    assert windows and all("block#" in line for line in windows)
