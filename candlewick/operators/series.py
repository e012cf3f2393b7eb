"""Position-based series work that never puts one whole series in one task.

A bar series is identified by ``KEYS`` and ordered by ``ts``. A single series
may hold a large share of all rows, so rolling frames and recursive averages
run inside *blocks* of at most ``BLOCK_ROWS`` consecutive bars:

* :func:`number_series` gives every bar its position, from per-calendar-bucket
  positions plus the number of bars in earlier buckets;
* :func:`split_blocks` cuts a numbered series and repeats the last ``halo`` bars
  of a block at the head of the next one, so that a frame of ``halo + 1`` rows
  is complete everywhere;
* :func:`decayed_averages` evaluates exponential averages sub-block by sub-block and
  adds what earlier ones still contribute.

Blocks have two levels: a block is long enough for the longest rolling window, and is cut into
sub-blocks short enough for the weights of the fastest exponential average. Both live in
one shuffle and one sort, so any periods go together.

Prices may stand still for long, and rounding noise must not decide comparisons there. Running sums take
deviations from a base value of the block, means of equal values are that value, and exponential averages
are evaluated as a distance from the current value, which shrinks by a power over a run of equal values.

:func:`whole_series` is the same contract for series whose length is bounded by
a lookback filter, where one block per series is enough.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEYS = ("ticker", "timeframe")
BLOCK_ROWS = 1024
# Weights below this share of the newest one cannot change a double.
NEGLIGIBLE = 1e-30
# Ratios of two averages keep their value while both decay, so they need
# contributions down to the smallest double.
NEGLIGIBLE_IN_RATIO = 1e-300
_MAX_GROWTH = 1e280


_SO_FAR = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _over(keys: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(keys)}, block ORDER BY sub, rn"


def _over_sub(keys: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(keys)}, block, sub ORDER BY rn"


def block_window(keys: Sequence[str] = KEYS):
    return W.partitionBy(*keys, "block").orderBy("sub", "rn")


def calendar_bucket(ts: str = "ts", timeframe: str = "timeframe") -> Column:
    """Calendar slice holding at most about 2,000 bars of one series.

    A series has one bar per timestamp: a day holds 1,440 minutes, a week 2,016
    five-minute bars, and four years hold 1,461 days.
    """
    day = F.unix_date(F.to_date(ts))
    return (
        F.when(F.col(timeframe) == "1m", day)
        .when(F.col(timeframe) == "5m", F.floor(day / 7).cast("int"))
        .otherwise(F.floor(F.year(ts) / 4).cast("int"))
    )


def number_series(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``rn``, the 0-based position of a bar in its series."""
    bars = bars.withColumn("_bucket", calendar_bucket())
    bucket = [*keys, "_bucket"]
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # One row per series and bucket, counted before the shuffle.
    starts = (
        bars.groupBy(*bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = W.partitionBy(*bucket).orderBy("ts")
    return (
        bars.withColumn("_pos", F.row_number().over(inside))
        .join(starts, bucket)
        .withColumn("rn", F.col("_start") + F.col("_pos") - 1)
        .drop("_bucket", "_pos", "_start")
    )


def block_rows(size: int, inner: int, *windows: int) -> int:
    """Rows of a block: at least ``size`` and the longest window, and a whole number of sub-blocks."""
    return -(-max(size, *windows) // inner) * inner


def split_blocks(
    numbered: DataFrame, halo: int, keys: Sequence[str] = KEYS, size: int = BLOCK_ROWS, inner: int | None = None,
) -> DataFrame:
    """Adds ``block``, ``j`` (position in the block), ``halo`` (repeated bar), ``sub`` (sub-block of ``inner`` rows) and
    ``i`` (position in it). Repeated bars lie in sub-block -1.
    """
    if not 0 <= halo <= size:
        raise ValueError(f"halo of {halo} bars does not fit blocks of {size}")
    inner = inner or size
    if size % inner:
        raise ValueError(f"blocks of {size} are not a whole number of sub-blocks of {inner}")
    home = F.floor(F.col("rn") / size)
    if halo:
        tail = F.col("rn") % size >= size - halo
        target = F.explode(F.when(tail, F.array(home, home + 1)).otherwise(F.array(home)))
    else:
        target = home
    return (
        numbered.withColumn("block", target)
        .withColumn("j", F.col("rn") - F.col("block") * size)
        .withColumn("halo", F.col("j") < 0)
        .withColumn("sub", F.when(F.col("halo"), F.lit(-1).cast("long")).otherwise(F.floor(F.col("j") / inner)))
        .withColumn("i", F.when(F.col("halo"), F.col("j")).otherwise(F.col("j") % inner))
    )


def whole_series(bars: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One block per series, for series a lookback filter keeps short; adds ``length``.

    A year of daily bars is at most 366 rows, two years of weekly bars 105 and
    five years of monthly bars 60.
    """
    order = W.partitionBy(*keys, "block").orderBy("ts")
    return (
        bars.withColumn("block", F.lit(0).cast("long"))
        .withColumn("rn", (F.row_number().over(order) - 1).cast("long"))
        .withColumn("j", F.col("rn"))
        .withColumn("i", F.col("rn"))
        .withColumn("sub", F.lit(0).cast("long"))
        .withColumn("halo", F.lit(False))
        .withColumn("length", F.count(F.lit(1)).over(W.partitionBy(*keys, "block")))
    )


def with_averages(
    blocks: DataFrame, averages: dict[str, tuple[str, int]], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Adds means of the last ``period`` rows, NULL until that many values exist.

    ``averages`` maps a column name to ``(value, period)``. Every mean is the
    difference of two running sums of its block, so its cost does not grow with
    the period. The mean of equal values is that value.
    """
    for value, period in averages.values():
        if period < 1:
            raise ValueError(f"period must be >= 1, got {period} for {value}")
    window = _over(keys)
    values = sorted({value for value, _ in averages.values()})
    # Deviations from the block's first value keep running sums short; where a run of equal values begins is remembered.
    bases = [f"first({v}, true) OVER ({window} {_SO_FAR}) AS _base_{v}" for v in values]
    running = [f"sum({v} - _base_{v}) OVER ({window} {_SO_FAR}) AS _sum_{v}" for v in values]
    running += [f"count({v}) OVER ({window} {_SO_FAR}) AS _count_{v}" for v in values]
    changes = [f"CASE WHEN {v} <=> lag({v}) OVER ({window}) THEN NULL ELSE j END AS _change_{v}" for v in values]
    starts = [f"max(_change_{v}) OVER ({window} {_SO_FAR}) AS _run_{v}" for v in values]

    def inside(column: str, period: int) -> str:
        return f"({column} - coalesce(lag({column}, {period}) OVER ({window}), 0))"

    means = [
        f"CASE WHEN {inside(f'_count_{value}', period)} < {period} THEN NULL"
        f" WHEN j - _run_{value} >= {period - 1} THEN {value}"
        f" ELSE _base_{value} + {inside(f'_sum_{value}', period)} / {period} END AS {name}"
        for name, (value, period) in averages.items()
    ]
    return blocks.selectExpr("*", *bases, *changes).selectExpr("*", *running, *starts).selectExpr(*blocks.columns, *means)


@dataclass(frozen=True)
class Decay:
    """``y = (1-alpha)·y + alpha·x`` from position ``start``, where ``y = x``.

    NULL for the first ``period - 1`` positions.
    """

    name: str
    value: str
    alpha: float
    period: int
    start: int = 0
    in_ratio: bool = False

    @property
    def beta(self) -> float:
        return 1.0 - self.alpha

    def reach(self, size: int) -> int:
        """How many earlier blocks still matter."""
        floor = NEGLIGIBLE_IN_RATIO if self.in_ratio else NEGLIGIBLE
        return 1 + math.ceil(math.log(floor) / (size * math.log(self.beta)))


def span(name: str, value: str, period: int, start: int = 0) -> Decay:
    if period < 1:
        raise ValueError(f"period must be >= 1, got {period}")
    return Decay(name, value, 2.0 / (period + 1), period, start)


def wilder(name: str, value: str, period: int, start: int = 0) -> Decay:
    if period < 1:
        raise ValueError(f"period must be >= 1, got {period}")
    return Decay(name, value, 1.0 / period, period, start, in_ratio=True)


def block_size(decays: Sequence[Decay], size: int = BLOCK_ROWS) -> int:
    """The largest block whose weights still fit a double."""
    betas = [d.beta for d in decays if d.beta > 0]
    if not betas:
        return size
    return min(size, int(math.log(_MAX_GROWTH) / -math.log(min(betas))))


def _share(decay: Decay, value: str) -> str:
    """Weighted input of one row; repeated and not yet started rows add nothing."""
    weight = f"if(rn = {decay.start}, 1D, {decay.alpha!r}D)"
    return f"if(NOT halo AND rn >= {decay.start}, {weight} * ({value}), 0D)"


def decayed_averages(
    blocks: DataFrame,
    decays: Sequence[Decay],
    keys: Sequence[str] = KEYS,
    size: int | None = BLOCK_ROWS,
    per_block: int = 1,
) -> DataFrame:
    """Adds one column per decay; values must not be NULL from their start on.

    In a sub-block the average is ``b^i · Σ share·b^(-i)``, an ordinary running sum of deviations from its first
    value. Sub-block ``k`` of ``size`` rows ends at ``e_k``, and what those before ``k`` add at its row ``i``
    is ``b^(i+1) · Σ b^(size·(n-1))·e_(k-n)``. The end values are plain sums of deviations from the last value, and the
    carry is a sum over their copies addressed to later sub-blocks, so neither step
    gathers a series. ``per_block`` sub-blocks make a block. ``size=None`` is for :func:`whole_series`: nothing is carried.

    A run of equal values ``x`` that began ``m`` rows ago has ``x + b^m · (y - x)`` with the average ``y`` before it, which
    stays exact however long it is. Decays ``in_ratio`` are of changes, whose runs are zeros, and need no base.
    """
    moving = [d for d in decays if d.beta > 0]
    centred = [d for d in moving if not d.in_ratio]
    values = sorted({(d.value, d.start) for d in centred})
    window = _over_sub(keys)
    tag = lambda v: f"{v[0]}_{v[1]}"
    begun = lambda v: f"if(NOT halo AND rn >= {v[1]}, {v[0]}, NULL)"
    firsts = [f"first({begun(v)}, true) OVER ({window} {_SO_FAR}) AS _first_{tag(v)}" for v in values]
    # Where values change, and where a sub-block or the average begins.
    changes = [
        f"rn = {v[1]} OR i = 0 OR NOT {v[0]} <=> lag({v[0]}) OVER ({window}) AS _change_{tag(v)}" for v in values
    ]
    out = blocks.selectExpr("*", *firsts, *changes)
    if size is not None and moving:
        out = out.join(_carries(blocks, moving, keys, size, per_block), [*keys, "block", "sub"], "left")

    def base(d: Decay) -> str:
        return f"_first_{d.value}_{d.start}"

    def carried(d: Decay) -> str:
        return "0D" if size is None else f"coalesce(_carry_{d.name}, 0D)"

    raw = []
    for d in moving:
        value = d.value if d.in_ratio else f"{d.value} - {base(d)}"
        local = (f"sum({_share(d, value)} * pow({d.beta!r}D, -i)) OVER ({window} {_SO_FAR}) * pow({d.beta!r}D, i)"
                 f" + pow({d.beta!r}D, i + 1) * {carried(d)}")
        raw.append(f"{local if d.in_ratio else f'{base(d)} + {local}'} AS _raw_{d.name}")
    runs = [f"max(if(_change_{tag(v)}, i, NULL)) OVER ({window} {_SO_FAR}) AS _run_{tag(v)}" for v in values]
    before = [
        f"CASE WHEN NOT _change_{d.value}_{d.start} THEN NULL WHEN rn = {d.start} THEN 0D WHEN i = 0 THEN {carried(d)}"
        f" ELSE lag(_raw_{d.name}) OVER ({window}) - {d.value} END AS _step_{d.name}"
        for d in centred
    ]
    away = [f"last(_step_{d.name}, true) OVER ({window} {_SO_FAR}) AS _away_{d.name}" for d in centred]

    def average(d: Decay) -> str:
        if d.beta <= 0:
            value = d.value
        elif d.in_ratio:
            value = f"_raw_{d.name}"
        else:
            value = f"{d.value} + pow({d.beta!r}D, i - _run_{d.value}_{d.start} + 1) * _away_{d.name}"
        return f"CASE WHEN rn - {d.start} + 1 >= {d.period} THEN {value} END AS {d.name}"

    out = out.selectExpr("*", *raw, *runs).selectExpr("*", *before).selectExpr("*", *away)
    return out.selectExpr(*blocks.columns, *[average(d) for d in decays])


def _carries(
    blocks: DataFrame, decays: Sequence[Decay], keys: Sequence[str], size: int, per_block: int
) -> DataFrame:
    """What earlier sub-blocks add at the head of each, as a distance from its first value (``in_ratio``: from zero)."""
    values = sorted({(d.value, d.start) for d in decays if not d.in_ratio})
    home = blocks.where("NOT halo").withColumn("_at", F.col("block") * per_block + F.col("sub"))
    whole = f"PARTITION BY {', '.join(keys)}, block, sub"
    lasts = [
        f"max_by({v}, rn) OVER ({whole}) AS _last_{v}_{start}" for v, start in values
    ]
    tail = lambda d: f"pow({d.beta!r}D, {size - 1} - i)"
    value = lambda d: d.value if d.in_ratio else f"{d.value} - _last_{d.value}_{d.start}"
    ends = home.selectExpr("*", *lasts).groupBy(*keys, "_at").agg(
        *[F.expr(f"sum({_share(d, value(d))} * {tail(d)}) AS _end_{d.name}") for d in decays],
        *[F.expr(f"sum({_share(d, '1D')} * {tail(d)}) AS _weight_{d.name}") for d in decays if not d.in_ratio],
        *[F.expr(f"max(_last_{v}_{start}) AS _last_{v}_{start}") for v, start in values],
        *[F.expr(f"min_by({v}, rn) FILTER (WHERE rn >= {start}) AS _first_{v}_{start}") for v, start in values],
    )
    reach = max(d.reach(size) for d in decays)
    sent = ends.drop(*[f"_first_{v}_{start}" for v, start in values]).withColumn(
        "_step", F.explode(F.sequence(F.lit(1), F.lit(reach)))).withColumn("_at", F.col("_at") + F.col("_step"))
    met = sent.join(ends.select(*keys, "_at", *[f"_first_{v}_{start}" for v, start in values]), [*keys, "_at"])

    def given(d: Decay) -> str:
        if d.in_ratio:
            return f"_end_{d.name}"
        at = f"{d.value}_{d.start}"
        return f"(coalesce(_end_{d.name}, 0D) + _weight_{d.name} * coalesce(_last_{at} - _first_{at}, 0D))"

    sums = [
        f"sum(CASE WHEN _step <= {d.reach(size)} THEN {given(d)} * pow({d.beta**size!r}D, _step - 1) END) AS _carry_{d.name}"
        for d in decays
    ]
    return met.groupBy(
        *keys, F.expr(f"_at div {per_block} AS block"), F.expr(f"_at % {per_block} AS sub"),
    ).agg(*[F.expr(e) for e in sums])
