"""Text columns: cleaning, hosts, word matches, dates and display formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: patterns and formats ----
HTML_TAG = r"<[^>]+>"
SUFFIX_DASH = r"\s*[-–]\s*"
TICKER = r"^[A-Z.\-]{1,10}$"
RFC_2822 = "d MMM yyyy HH:mm:ss [z][Z]"
RFC_2822_WEEKDAY = r"^\s*[A-Za-z]{3},\s*"


def strip_html(text: Column) -> Column:
    return trimmed(F.regexp_replace(text, HTML_TAG, ""))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_publisher(title: Column, publisher: Column) -> Column:
    """Without the trailing " - Publisher" that aggregated feeds append."""
    pattern = F.concat(F.lit(SUFFIX_DASH + r"\Q"), publisher, F.lit(r"\E\s*$"))
    return trimmed(F.regexp_replace(title, pattern, F.lit("")))


def host(url: Column) -> Column:
    """Third ``/`` part of a URL, or the URL itself when it has fewer."""
    parts = F.split(url, "/", -1)
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(2))).otherwise(url)


def page_host(url: Column) -> Column:
    parts = F.split(url, "/", -1)
    return F.when(F.size(parts) >= 3, F.get(parts, F.lit(2))).otherwise("")


def match_count(text: Column, words: Sequence[str]) -> Column:
    """How many of ``words`` occur anywhere in the text, each counted once.

    A word also matches inside a longer one.
    """
    lowered = F.lower(text)
    hits = [F.contains(lowered, F.lit(w.lower())).cast("int") for w in words]
    return sum(hits[1:], hits[0]) if hits else F.lit(0)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return match_count(text, words) > 0


def rfc_2822_time(raw: Column) -> Column:
    """Timestamp of a mail-style date; NULL when it is not one."""
    return F.try_to_timestamp(F.regexp_replace(raw, RFC_2822_WEEKDAY, ""), F.lit(RFC_2822))


def age_text(published: Column, as_of: Column) -> Column:
    """Age in the largest whole unit; empty when the date is unknown."""
    seconds = F.unix_seconds(as_of) - F.unix_seconds(published)
    unit = lambda size, sign: F.concat(F.floor(seconds / size).cast("string"), F.lit(sign))
    return (
        F.when(seconds.isNull(), "")
        .when(seconds < 60, "just now")
        .when(seconds < 3600, unit(60, "m ago"))
        .when(seconds < 86400, unit(3600, "h ago"))
        .otherwise(unit(86400, "d ago"))
    )


def market_cap_text(cap: Column) -> Column:
    return (
        F.when(cap.isNull(), "N/A")
        .when(cap >= 1_000_000_000, F.format_string("$%.1fB", cap / 1e9))
        .when(cap >= 1_000_000, F.format_string("$%.0fM", cap / 1e6))
        .otherwise(F.concat(F.lit("$"), F.format_number(cap, 0)))
    )


def revenue_text(value: Column) -> Column:
    return market_cap_text(value)


def number_text(value: Column, suffix: str = "", digits: int = 2) -> Column:
    form = f"%.{digits}f{suffix.replace('%', '%%')}"
    return F.when(value.isNull(), "N/A").otherwise(F.format_string(form, value))


def percent_text(value: Column) -> Column:
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.2f%%", value * 100))


def shortened(text: Column, size: int = 400) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def ticker_text(raw: Column) -> Column:
    return F.trim(F.upper(raw))


def is_ticker(ticker: Column) -> Column:
    return F.rlike(ticker, F.lit(TICKER))
