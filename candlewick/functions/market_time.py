"""Exchange sessions of a UTC timestamp column. Time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlewick import constants as C

FRIDAY = 4
_CLOCK = "HH:mm:ss.SSSSSS"


def new_york(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, C.NEW_YORK)


def jerusalem(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, C.JERUSALEM)


def _clock(local: Column) -> Column:
    return F.date_format(local, _CLOCK)


def _open_day(local: Column) -> Column:
    return F.weekday(local) <= FRIDAY


def is_nyse_open(ts: Column) -> Column:
    """Monday to Friday, both ends of the session included."""
    local = new_york(ts)
    return _open_day(local) & _clock(local).between(*C.NYSE_HOURS)


def is_tase_open(ts: Column) -> Column:
    """Monday to Friday with an early close on Friday, both ends included."""
    local = jerusalem(ts)
    opens, closes = C.TASE_HOURS
    close = F.when(F.weekday(local) == FRIDAY, C.TASE_FRIDAY_CLOSE).otherwise(closes)
    return _open_day(local) & (_clock(local) >= opens) & (_clock(local) <= close)


def is_tase_preopen(ts: Column) -> Column:
    local = jerusalem(ts)
    return _open_day(local) & (_clock(local) >= C.TASE_PREOPEN) & (_clock(local) < C.TASE_HOURS[0])


def is_friday_session(ts: Column) -> Column:
    return F.weekday(jerusalem(ts)) == FRIDAY


def clock_text(ts: Column, local: Column, hours: int, winter: str, summer: str) -> Column:
    """Local time with its zone name; ``hours`` is the winter offset from UTC."""
    offset = F.unix_seconds(local) - F.unix_seconds(ts)
    zone = F.when(offset == hours * 3600, winter).otherwise(summer)
    return F.concat_ws(" ", F.date_format(local, "yyyy-MM-dd HH:mm:ss"), zone)


def market_status(ts: Column) -> Column:
    return F.struct(
        is_nyse_open(ts).alias("nyse_open"),
        is_tase_open(ts).alias("tase_open"),
        is_tase_preopen(ts).alias("tase_preopen"),
        is_friday_session(ts).alias("tase_friday"),
        clock_text(ts, new_york(ts), -5, "EST", "EDT").alias("us_time"),
        clock_text(ts, jerusalem(ts), 2, "IST", "IDT").alias("tase_time"),
    )


def session_label(ts: Column) -> Column:
    """By the New York clock alone: a weekend noon has no label."""
    clock = _clock(new_york(ts))
    return (
        F.when(is_nyse_open(ts), "")
        .when(clock < C.NYSE_HOURS[0], "pre-market")
        .when(clock >= C.NYSE_HOURS[1], "after-hours")
        .otherwise("")
    )


def time_to_nyse_open(ts: Column) -> Column:
    """State of the session, or the countdown to today's open."""
    local = new_york(ts)
    clock, day = _clock(local), F.weekday(local)
    # The clock never jumps between midnight and the open on a trading day, so
    # local minutes count real time.
    opening = F.date_trunc("day", local) + F.expr("INTERVAL '9:30' HOUR TO MINUTE")
    minutes = F.floor((F.unix_micros(opening) - F.unix_micros(local)) / 60_000_000).cast("int")
    hours, rest = F.floor(minutes / 60).cast("int"), minutes % 60
    countdown = F.when(
        hours > 0,
        F.concat(F.lit("Opens in "), hours, F.lit("h "), rest, F.lit("m (9:30 AM ET)")),
    ).otherwise(F.concat(F.lit("Opens in "), minutes, F.lit("m (9:30 AM ET)")))
    return (
        F.when(is_nyse_open(ts), "Open - closes at 4:00 PM ET")
        .when((day <= FRIDAY) & (clock < C.NYSE_HOURS[0]), countdown)
        .when(day >= FRIDAY, "Closed - reopens Monday 9:30 AM ET")
        .otherwise("Closed - reopens tomorrow at 9:30 AM ET")
    )
