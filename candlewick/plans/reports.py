"""Report tables: the rows behind each report, one lazy plan per report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick import constants as C
from candlewick.functions import market_time, scores
from candlewick.operators import alerts as AL
from candlewick.operators import fundamentals as FU
from candlewick.operators import news as N
from candlewick.operators import prices as P
from candlewick.operators import signals as SG
from candlewick.operators import zones as Z
from candlewick.sources import dims


@dataclass(frozen=True)
class Market:
    """The tables a report reads."""

    bars: DataFrame
    quotes: DataFrame
    articles: DataFrame
    facts: DataFrame
    statements: DataFrame
    calendar: DataFrame
    filings: DataFrame
    #: The zone map of ``bars``; without it newest rows are found by reading the history.
    zones: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.bars.sparkSession

    def newest_day(self) -> Column:
        if self.zones is not None:
            return Z.newest(self.zones, "1d")
        return P.newest(self.bars.where(F.col("timeframe") == "1d"))


@dataclass(frozen=True)
class Words:
    positive: Sequence[str] = C.POSITIVE_WORDS
    negative: Sequence[str] = C.NEGATIVE_WORDS


# ---- market wide ----


def market_snapshot(quotes: DataFrame, bars: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Every snapshot symbol in its declared order; NULL figures where nothing is known."""
    symbols = dims.snapshot_symbols(bars.sparkSession)
    own_bars, own_quotes = _only(bars, symbols), _only(quotes, symbols)
    rows = P.quote_or_close(symbols, own_quotes, own_bars, _only(zones, symbols))
    pct = F.when(F.col("price").isNotNull(), P.percent_change(F.col("price"), F.col("previous")))
    return (
        rows.withColumn("pct", pct)
        .withColumn("direction", F.when(F.col("pct").isNotNull(), P.direction(F.col("pct"))))
        .select("pos", "ticker", "label", "market_group", "price", "pct", "direction")
        .orderBy("pos")
    )


def market_group(tickers: DataFrame) -> DataFrame:
    """Snapshot group of any symbol; unknown ones fall into the default group."""
    known = dims.snapshot_symbols(tickers.sparkSession).select("ticker", "market_group")
    return tickers.join(F.broadcast(known), "ticker", "left").withColumn(
        "market_group", F.coalesce("market_group", F.lit(C.DEFAULT_GROUP))
    )


def _only(rows: DataFrame | None, tickers: DataFrame) -> DataFrame | None:
    """Rows of a fixed list of tickers; the list is small by construction."""
    return None if rows is None else rows.join(F.broadcast(tickers.select("ticker")), "ticker", "left_semi")


def sector_rows(quotes: DataFrame, bars: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    symbols = dims.sectors(bars.sparkSession)
    rows = P.quote_or_close(symbols, _only(quotes, symbols), _only(bars, symbols), _only(zones, symbols))
    pct = F.round(P.percent_change(F.col("price"), F.col("previous")), 2)
    return (
        rows.where(F.col("price").isNotNull())
        .select("pos", "ticker", "name", pct.alias("pct_change"),
                F.round("price", 2).alias("price"))
        .withColumn("band", scores.sector_band(F.col("pct_change")))
    )


def sector_rotation(quotes: DataFrame, bars: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Sectors with a price, best first; ties keep the declared order."""
    return sector_rows(quotes, bars, zones).orderBy(F.desc("pct_change"), "pos")


def sector_breadth(quotes: DataFrame, bars: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    return sector_rows(quotes, bars, zones).agg(
        F.count_if(F.col("pct_change") >= 0).alias("advancing"),
        F.count_if(F.col("pct_change") < 0).alias("declining"),
    )


# ---- watchlist ----


def watch_signals(market: Market, tickers: Sequence[str], as_of: Column | None = None) -> DataFrame:
    """One row per watchlist entry, in order; NULL figures for a ticker without bars."""
    watch = dims.watchlist(market.spark, tickers)
    end = market.newest_day() if as_of is None else as_of
    signals = SG.signal_snapshot(_only(market.bars, watch), as_of=end)
    signals = SG.with_momentum(P.live_override(signals, _only(market.quotes, watch)))
    pct = P.percent_change(F.col("close"), F.col("open"))
    return (
        watch.join(signals, "ticker", "left")
        .withColumn("pct", F.when(F.col("close").isNotNull(), pct))
        .withColumn("direction", F.when(F.col("pct").isNotNull(), P.direction(F.col("pct"))))
    )


def best_worst(rows: DataFrame) -> DataFrame:
    """Best and worst change; unchanged tickers do not take part, ties go to the first."""
    moved = F.col("pct") != 0
    pct = F.when(moved, F.col("pct"))
    best = F.when(moved, F.struct("pct", -F.col("pos")))
    worst = F.when(moved, F.struct("pct", "pos"))
    return rows.agg(
        F.max_by("ticker", best).alias("best"), F.max(pct).alias("best_pct"),
        F.min_by("ticker", worst).alias("worst"), F.min(pct).alias("worst_pct"),
    )


def best_momentum(rows: DataFrame) -> DataFrame:
    order = F.when(F.col("price").isNotNull(), F.struct("momentum", -F.col("pos")))
    return rows.agg(
        F.max_by("ticker", order).alias("ticker"),
        F.max_by("momentum", order).alias("momentum"),
        F.max_by("momentum_label", order).alias("momentum_label"),
    )


def _counts() -> dict[str, Column]:
    """A ticker without RSI, or with exactly 0, is neutral."""
    over = F.count_if(F.col("rsi") > C.RSI_OVERBOUGHT)
    under = F.count_if((F.col("rsi") < C.RSI_OVERSOLD) & (F.col("rsi") != 0))
    return {
        "overbought": over, "oversold": under, "neutral": F.count(F.lit(1)) - over - under,
    }


def rsi_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(*[c.alias(n) for n, c in _counts().items()])


def _entry(section: str, pos: Column, ticker: Column, label: Column, value: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"), pos.cast("int").alias("pos"),
        ticker.cast("string").alias("ticker"), label.cast("string").alias("label"),
        value.cast("double").alias("value"),
    )


_ENTRY = "section", "pos", "ticker", "label", "value"


def _per_ticker(rows: DataFrame, *entries: Column) -> DataFrame:
    return rows.select(F.inline(F.array(*entries)))


def _market_entries(market: Market) -> DataFrame:
    snapshot = market_snapshot(market.quotes, market.bars, market.zones)
    sectors = sector_rows(market.quotes, market.bars, market.zones)
    pick = lambda rows, section, label, value: rows.select(
        F.inline(F.array(_entry(section, F.col("pos"), F.col("ticker"), F.col(label), F.col(value))))
    )
    return pick(snapshot, "snapshot", "market_group", "pct").unionByName(
        pick(sectors, "sectors", "band", "pct_change")
    )


def watch_sentiment(market: Market, tickers: Sequence[str], words: Words) -> DataFrame:
    watch = dims.watchlist(market.spark, tickers)
    report = N.sentiment_report(
        watch, _only(market.articles, watch), words.positive, words.negative
    )
    return F.broadcast(watch).join(report, "ticker")


def _earnings_entries(market: Market, tickers: Sequence[str], today: Column) -> DataFrame:
    watch = dims.watchlist(market.spark, tickers)
    facts = FU.newest_per_ticker(_only(market.facts, watch), "fact_id")
    reported = FU.reported_today(facts, today).select("ticker")
    report = FU.earnings_report(
        _only(market.statements, watch), facts, _only(market.calendar, watch)
    )
    rows = F.broadcast(watch).join(reported, "ticker").join(report, "ticker")
    return _per_ticker(
        rows, _entry("earnings", F.col("pos"), F.col("ticker"), F.col("quarter"),
                     F.col("eps_surprise_pct")),
    )


def close_report(
    market: Market, today: Column, words: Words = Words(),
    tickers: Sequence[str] = C.REPORT_WATCHLIST,
) -> DataFrame:
    """End-of-day report as ``(section, pos, ticker, label, value)`` rows.

    The watchlist has a fixed size, so its rows fold into one row that carries
    every per-ticker and summary entry; the signals are computed once.
    """
    pos, ticker = F.col("pos"), F.col("ticker")
    histogram = F.coalesce("macd_histogram", F.lit(0.0))
    rsi = F.col("rsi")
    keep = lambda hit, entry: F.when(F.coalesce(hit, F.lit(False)), entry)
    own = F.array_compact(
        F.array(
            _entry("change", pos, ticker, F.col("direction"), F.col("pct")),
            _entry("rsi", pos, ticker, F.col("rsi_signal"), rsi),
            keep((rsi < 35) & (rsi != 0), _entry("watch", pos, ticker, F.lit("bounce"), rsi)),
            keep(rsi > 70, _entry("watch", pos, ticker, F.lit("pullback"), rsi)),
            keep((F.abs(histogram) < 0.05) & (histogram != 0),
                 _entry("watch", pos, ticker, F.lit("near_cross"), histogram)),
        )
    )
    rows = watch_signals(market, tickers)
    moved = F.col("pct") != 0
    best = F.when(moved, F.struct("pct", -pos))
    worst = F.when(moved, F.struct("pct", "pos"))
    momentum = F.when(F.col("price").isNotNull(), F.struct("momentum", -pos))
    none = F.lit(0)
    summary = rows.agg(
        F.flatten(F.collect_list(own)).alias("own"),
        F.max_by(_entry("best", none, ticker, F.lit("best"), F.col("pct")), best).alias("best"),
        F.min_by(_entry("worst", none, ticker, F.lit("worst"), F.col("pct")), worst).alias("worst"),
        F.max_by(_entry("momentum", none, ticker, F.col("momentum_label"), F.col("momentum")),
                 momentum).alias("momentum"),
        *[c.alias(n) for n, c in _counts().items()],
    )
    counts = [
        _entry("rsi_summary", F.lit(i), F.lit(None), F.lit(n), F.col(n))
        for i, n in enumerate(_counts())
    ]
    entries = F.concat(
        F.col("own"), F.array_compact(F.array("best", "worst", "momentum")), F.array(*counts)
    )
    sentiment = _per_ticker(
        watch_sentiment(market, tickers, words),
        _entry("sentiment", pos, ticker, F.col("band"), F.col("score")),
    )
    return (
        summary.select(F.inline(entries)).select(*_ENTRY)
        .unionByName(sentiment)
        .unionByName(_earnings_entries(market, tickers, today))
        .unionByName(_market_entries(market))
    )


def open_report(
    market: Market, today: Column, tickers: Sequence[str] = C.REPORT_WATCHLIST
) -> DataFrame:
    """Morning report: changes, RSI and MACD direction, earnings just in, market tables."""
    pos, ticker = F.col("pos"), F.col("ticker")
    macd = F.when(F.col("macd_bullish"), "bullish").otherwise("bearish")
    own = _per_ticker(
        watch_signals(market, tickers),
        _entry("change", pos, ticker, F.col("direction"), F.col("pct")),
        _entry("rsi", pos, ticker, F.col("rsi_signal"), F.col("rsi")),
        _entry("macd", pos, ticker, macd, F.col("macd_histogram")),
    )
    return own.unionByName(_earnings_entries(market, tickers, today)).unionByName(
        _market_entries(market)
    )


def preopen_report(
    market: Market, today: Column, news_as_of: Column, tickers: Sequence[str] = C.PREVIEW_WATCHLIST
) -> DataFrame:
    """Preview: changes, RSI, top headline, mood, earnings expected today, market tables."""
    spark = market.spark
    pos, ticker = F.col("pos"), F.col("ticker")
    watch = dims.watchlist(spark, tickers)
    # The mood opens with the broad market's change, where it is known.
    broad = F.when((ticker == "SPY") & F.col("pct").isNotNull(), _entry("mood", F.lit(0), ticker, F.col("direction"), F.col("pct")))
    own = watch_signals(market, tickers).select(F.inline(F.array_compact(F.array(
        _entry("change", pos, ticker, F.col("direction"), F.col("pct")),
        _entry("rsi", pos, ticker, F.col("rsi_signal"), F.col("rsi")),
        broad,
    ))))
    news = N.report_articles(_only(market.articles, watch))
    top = N.top_headlines(news, 1, news_as_of).select("ticker", "title", "source")
    headline = _per_ticker(
        F.broadcast(watch).join(top, "ticker"),
        _entry("headline", pos, ticker, F.concat_ws(" | ", "title", "source"), F.lit(None)),
    )
    due = FU.reporting_today(
        FU.newest_per_ticker(_only(market.calendar, watch), "announcement_id"), today
    )
    expected = _per_ticker(
        F.broadcast(watch).join(due, "ticker"),
        _entry("due", pos, ticker, F.lit("eps"), F.col("eps_estimate")),
        _entry("due", pos, ticker, F.lit("revenue"), F.col("revenue_estimate")),
    )
    vix = vix_mood(market.bars, market.zones)
    mood = _per_ticker(vix, _entry("mood", F.lit(1), ticker, F.col("mood"), F.col("vix")))
    return (
        own.unionByName(headline).unionByName(expected).unionByName(mood)
        .unionByName(_market_entries(market))
    )


def vix_mood(bars: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    own = (F.col("ticker") == "^VIX") & (F.col("timeframe") == "1d")
    part = [] if zones is None else ["part"]
    last = P.last_bar(bars.where(own).select("ticker", "timeframe", *part, "ts", "close"), None if zones is None else zones.where(own))
    vix = F.col("close").cast("double")
    return last.select("ticker", "timeframe", "ts", vix.alias("vix"), scores.vix_label(vix).alias("mood"))


# ---- one ticker or a pair ----

COMPARED = (
    "price", "rsi", "macd_histogram", "momentum", "pe_trailing", "eps_trailing", "market_cap",
)


def compare_pair(market: Market, first: str, second: str) -> DataFrame:
    """Metrics of two tickers side by side; NULL where one is unknown.

    The comparison has no price history at hand, so the 5-bar part of the score is 0.
    """
    names = (first.upper(), second.upper())
    pair = dims.watchlist(market.spark, names)
    signals = SG.signal_snapshot(_only(market.bars, pair), as_of=market.newest_day())
    signals = SG.with_momentum(
        P.live_override(signals, _only(market.quotes, pair)), use_change=False
    )
    profile, _ = FU.company_profile(
        FU.newest_per_ticker(_only(market.facts, pair), "fact_id")
    )
    wide = pair.join(signals, "ticker", "left").join(profile, "ticker", "left")
    metrics = [
        F.struct(F.lit(i).alias("pos"), F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"))
        for i, n in enumerate(COMPARED)
    ]
    pick = lambda name: F.max(F.when(F.col("ticker") == name, F.col("value")))
    return (
        wide.select("ticker", F.inline(F.array(*metrics)))
        .groupBy("pos", "metric")
        .agg(pick(names[0]).alias("first"), pick(names[1]).alias("second"))
    )


def analyze(
    market: Market, news_as_of: Column, words: Words = Words(), as_of: Column | None = None
) -> DataFrame:
    """Full analysis, one row for every ticker that has bars in the lookback.

    Each part arrives as one row per ticker, so the joins are between small
    tables and the size of a join never depends on how much history a ticker has.
    """
    signals = P.live_override(SG.with_timeframes(market.bars, as_of, market.zones), market.quotes)
    usable_quote = F.col("prev_close") > 0
    day_pct = F.when(
        usable_quote, P.percent_change(F.col("price"), F.col("prev_close"))
    ).when(
        F.col("close_before").isNotNull(), P.percent_change(F.col("close"), F.col("close_before"))
    )
    out = SG.with_levels(SG.with_momentum(signals)).withColumn("day_pct", day_pct)
    facts = FU.newest_per_ticker(market.facts, "fact_id")
    profile, _ = FU.company_profile(facts)
    profile = profile.select("ticker", "name", "sector", "exchange", "market_cap", "pe_trailing")
    earnings = FU.earnings_report(market.statements, facts, market.calendar).select(
        "ticker", "quarter", "eps_actual", "eps_surprise_pct", "beat_eps", "revenue_surprise_pct",
        "beat_revenue",
    )
    filings = FU.insider_recent(market.filings).groupBy("ticker").agg(
        F.count_if(F.col("transaction_type") == "BUY").alias("insider_buys"),
        F.count_if(F.col("transaction_type") == "SELL").alias("insider_sells"),
    )
    # Both news parts read the same shuffled articles, so texts are scanned once.
    news = N.report_articles(N.with_score(market.articles, words.positive, words.negative))
    top = N.top_headlines(news, 1, news_as_of).select(
        "ticker", F.col("title").alias("top_headline")
    )
    for part in (profile, earnings, filings, top):
        out = out.join(part, "ticker", "left")
    out = N.with_sentiment(out, N.sentiment_totals(news)).withColumnRenamed("score", "sentiment")
    return out.drop(
        "close_before_5", "positive_count", "negative_count", "neutral_count", "source_count",
        "summary",
    )


def market_status_rows(times: DataFrame, ts: str = "ts") -> DataFrame:
    """Session state of both exchanges at every given time."""
    return times.select(
        *times.columns, F.inline(F.array(market_time.market_status(F.col(ts)))),
    )


def alert_check(market: Market, alerts: DataFrame) -> DataFrame:
    """Alerts that fire at the current prices: live where known, else the last close."""
    closes = P.last_two_closes(market.bars, zones=market.zones)
    live = P.latest_quote(market.quotes).select("ticker", "last_price")
    prices = closes.join(live, "ticker", "full_outer").select(
        "ticker", F.coalesce("last_price", F.col("last_close").cast("double")).alias("price")
    )
    return AL.triggered(alerts, prices)
