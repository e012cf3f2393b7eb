"""Stages of the pipeline on clashing columns, odd rows and empty tables."""

import pytest

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, SHARD_OF string"
ROWS = [(i, t, "en", None if i == 3 else "s", 1, 7, 7, "x") for i, t in enumerate(
    [None, "", " \n", "some words that are long enough to pass as a text of ten words", "\U0001f600 " * 50, "a b " * 5000])]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_odd_and_no_rows(spark, name, stage):
    docs = spark.createDataFrame([*ROWS, ROWS[3], (None, *ROWS[3][1:])], SCHEMA)
    out = stage(spark, docs, FOLDER)
    assert len(set(map(str.lower, out.columns))) == len(out.columns)
    assert set(out.columns) == set(docs.columns)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} <= {None, *range(len(ROWS))}
    if name == "shards":
        assert len(rows) == 8 and {r["slot"] for r in rows} == {0} and len({r["shard"] for r in rows}) == 8
    assert stage(spark, docs.limit(0), FOLDER).collect() == []
