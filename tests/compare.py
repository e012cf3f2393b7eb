"""Compares a Spark result with a DuckDB result, value by value."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return db


def _cell(value: object) -> object:
    if value is None or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "item") and not isinstance(value, pd.Timestamp):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return 0.0 if value == 0 else value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, pd.Timestamp) or hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    return value


def rows(frame: pd.DataFrame) -> Counter:
    frame = frame[sorted(frame.columns)]
    return Counter(tuple(_cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def difference(got: pd.DataFrame, expected: pd.DataFrame) -> str:
    """Empty when both hold the same columns and rows."""
    if sorted(got.columns) != sorted(expected.columns):
        extra = set(got.columns) ^ set(expected.columns)
        return f"columns differ: {sorted(extra)}"
    a, b = rows(got), rows(expected)
    if a == b:
        return ""
    only_a, only_b = a - b, b - a
    names = sorted(got.columns)
    text = f"{len(got)} vs {len(expected)} rows, {sum(only_a.values())}/{sum(only_b.values())} unmatched\n"
    xa, xb = sorted(only_a, key=str)[:2], sorted(only_b, key=str)[:2]
    for x, y in zip(xa, xb):
        cells = [f"{n}: {p!r:.80} | {q!r:.80}" for n, p, q in zip(names, x, y) if p != q]
        text += "   " + "; ".join(cells)[:600] + f"   [{str(x)[:160]}]\n"
    return text
