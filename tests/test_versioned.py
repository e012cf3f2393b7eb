"""Tables that grow by versions: one batch or many, repeated and half-written batches, compaction, pushed filters."""

import random

import pytest

from candlewick.operators import stored as ST
from candlewick.plans import registry
from candlewick.sources.versioned import VersionedTable

SCHEMA = "ticker STRING, day INT, open DOUBLE, close DOUBLE, arrival INT"


def table(spark, path):
    return VersionedTable(spark, str(path), SCHEMA, ["ticker", "day"], first=("open",))


def contents(t):
    return {(r.ticker, r.day): (r.open, r.close) for r in t.read().collect()}


def test_batches_merge_as_a_dict_does(spark, tmp_path):
    rng, want, t = random.Random(5), {}, table(spark, tmp_path / "t")
    assert contents(t) == {} and t.compact() is None
    for version in range(6):
        rows = [(rng.choice([None, "A", "B", "C"]), rng.randrange(6), rng.choice([None, rng.random()]), rng.random(), i)
                for i in range(20)]
        last = {r[:2]: r for r in rows}
        for key, r in last.items():
            want[key] = (want[key][0] if key in want else r[2], r[3])
        frame = spark.createDataFrame(rows, SCHEMA)
        assert t.append(frame, version, "arrival")
        assert not t.append(frame, version, "arrival")
        assert contents(t) == want
        if version in (2, 4):
            assert t.compact() == version and contents(t) == want
            assert not t.append(frame, version - 1, "arrival")
    assert t.commits() == (4, [5])


def test_half_written_batches_are_not_seen_and_written_anew(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.append(spark.createDataFrame([("A", 1, 1.0, 1.0, 0)], SCHEMA), 1)
    t._write(spark.createDataFrame([("A", 1, 9.0, 9.0, 0)], SCHEMA), "batch-2")
    t._write(spark.createDataFrame([("A", 1, 9.0, 9.0, 0)], SCHEMA), "base-1")
    assert contents(t) == {("A", 1): (1.0, 1.0)}
    assert t.append(spark.createDataFrame([("A", 1, 2.0, 2.0, 0)], SCHEMA), 2)
    assert contents(t) == {("A", 1): (1.0, 2.0)}
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([], SCHEMA), 0)


def test_batches_beside_a_compaction_stay(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    one = lambda close: spark.createDataFrame([("A", 1, close, close, 0)], SCHEMA)
    t.append(one(1.0), 1)
    t.append(one(2.0), 2)
    merged = t._merged([(1, "batch-1"), (2, "batch-2")])
    t.append(one(3.0), 3)
    t._write(merged, "base-2")
    t._commit(2, True)
    assert t.commits() == (2, [3]) and contents(t) == {("A", 1): (1.0, 3.0)}


def test_key_filters_reach_every_version(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    for version in (1, 2):
        t.append(spark.createDataFrame([("A", version, 1.0, 1.0, 0), ("B", 1, 1.0, 1.0, 0)], SCHEMA), version)
    plan = t.read().where("ticker = 'A'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(ticker,A)") == 2


def test_gap_history_reads_the_stored_table(spark):
    df = registry.QUERIES["gap_history"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EqualTo(ticker_us,TEVA)") == 2 and "/bars-" not in plan
    assert ST.gap_history(registry.stored_gaps(spark, "/root/testdata/sf0.001").read(), "teva", 5.0).count() == df.count()
