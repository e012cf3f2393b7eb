"""Named queries over the landed tables.

Every query takes a session and a folder of landed tables and returns one
DataFrame. Floating-point results are rounded to a stated number of digits, so
that they can be compared with another engine's.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from candlewick import constants as C
from candlewick.functions import market_time as MT
from candlewick.functions import scores, text
from candlewick.functions import sql as SQL
from candlewick.operators import alerts as AL
from candlewick.operators import arbitrage as AR
from candlewick.operators import fundamentals as FU
from candlewick.operators import indicators as I
from candlewick.operators import levels as L
from candlewick.operators import news as N
from candlewick.operators import percentile as PC
from candlewick.operators import prices as P
from candlewick.operators import resample as RS
from candlewick.operators import signals as SG
from candlewick.operators import stored as ST
from candlewick.operators.series import KEYS
from candlewick.plans import reports as R
from candlewick.session import shared_folder, use_utc
from candlewick.sources import dims
from candlewick.sources import market as M
from candlewick.sources import sinks
from candlewick.sources.schemas import LANDED
from candlewick.sources.versioned import VersionedTable
from candlewick.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The landed articles are from early January 2024 and use invented words.
NEWS_AS_OF = "2024-01-04 00:00:00"
TODAY = "2024-01-05"
QUOTE_AS_OF = "2024-01-20 12:00:00"
WORDS = R.Words(positive=("that", "with"), negative=("this", "from"))
EARNINGS_WORDS = ("the", "der")
IMPACT_WORDS = ("and", "que")
ALLOWED_SITES = ("example.com", "example.org")


def query(fn: Query) -> Query:
    """Registers a query under its function name; timestamps leave as plain UTC."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = fn(use_utc(spark), folder)
        plain = {
            f.name: F.col(f.name).cast("timestamp_ntz")
            for f in df.schema if isinstance(f.dataType, TimestampType)
        }
        return df.withColumns(plain) if plain else df

    QUERIES[fn.__name__] = run
    return run


def at(moment: str) -> Column:
    return F.lit(moment).cast("timestamp")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


SERIES = (
    "ticker STRING, exchange STRING, ts TIMESTAMP, timeframe STRING, open DOUBLE, high DOUBLE, "
    "low DOUBLE, close DOUBLE, volume BIGINT"
)
_stored: dict[tuple, str] = {}


def stored_bars(spark: SparkSession, sf: str, with_part: bool = False) -> DataFrame:
    """The bar table of a folder, written once per application and state of its trades.

    Bars are a stored table: trades are folded into bars once, and every query
    then reads the few columns and partitions it needs, as often as it has to.
    """
    key = (spark.sparkContext.applicationId, sf, *M.state_of(spark, sf, "lineitem"))
    if key not in _stored:
        path = f"{shared_folder(spark)}/bars-{uuid.uuid4().hex}"
        sinks.write_series(M.daily_bars(spark, sf), path)
        _stored[key] = path
    return sinks.read_bars(spark, _stored[key], SERIES, with_part)


def zones(spark: SparkSession, sf: str) -> DataFrame:
    """The zone map of the bar table."""
    stored_bars(spark, sf)
    return sinks.read_zones(spark, _stored[(spark.sparkContext.applicationId, sf, *M.state_of(spark, sf, "lineitem"))])


def stored_gaps(spark: SparkSession, sf: str) -> VersionedTable:
    """The gap table of a folder, written once: a first batch that lacks newer exchange rates, then the corrected rows."""
    key = ("gaps", spark.sparkContext.applicationId, sf, *M.state_of(spark, sf, "lineitem"), *M.state_of(spark, sf, "orders"))
    table = VersionedTable(
        spark, _stored.setdefault(key, f"{shared_folder(spark)}/gaps-{uuid.uuid4().hex}"), AR.GAPS, AR.GAP_KEY)
    if not table.commits()[1]:
        bars, rates = stored_bars(spark, sf), M.fx_rates(spark, sf)
        late = F.col("ts") >= "1995-01-01"
        gaps, _ = AR.arbitrage_gap(bars, rates)
        unknown, _ = AR.arbitrage_gap(bars, rates.where("false"))
        table.append(gaps.where(~late).unionByName(unknown.where(late)), 1)
        table.append(gaps.where(late), 2)
    return table


def scan_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The bar table with its folder column, for queries over a known period."""
    return stored_bars(spark, sf, with_part=True)


def market(spark: SparkSession, sf: str) -> R.Market:
    return R.Market(
        bars=scan_bars(spark, sf), quotes=M.quotes(spark, sf), articles=M.articles(spark, sf),
        facts=M.company_facts(spark, sf), statements=M.income_statements(spark, sf),
        calendar=M.earnings_calendar(spark, sf), filings=M.insider_raw(spark, sf), zones=zones(spark, sf),
    )


def all_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return zones(spark, sf).select("ticker").distinct()


# ---- scans, stored-table lookups ----


@query
def daily_bars(spark, sf):
    """Bars straight from the trades, without the stored table."""
    return M.daily_bars(spark, sf)


@query
def bar_scan(spark, sf):
    return P.bar_scan(scan_bars(spark, sf), "6mo", zones=zones(spark, sf)).drop("exchange")


@query
def last_bar(spark, sf):
    return P.last_bar(scan_bars(spark, sf), zones(spark, sf))


@query
def last_n_bars(spark, sf):
    return P.last_bars(M.minute_bars(spark, sf), 10)


@query
def latest_quote(spark, sf):
    return P.latest_quote(M.quotes(spark, sf))


@query
def quote_or_close(spark, sf):
    return P.quote_or_close(all_symbols(spark, sf), M.quotes(spark, sf), stored_bars(spark, sf), zones(spark, sf))


@query
def price_query(spark, sf):
    return ST.price_query(scan_bars(spark, sf), "aapl", "1997-01-01", "1999-12-31", 100)


@query
def gap_history(spark, sf):
    return ST.gap_history(stored_gaps(spark, sf).read(), "teva", 5.0)


@query
def active_alerts(spark, sf):
    return ST.active_alerts(M.user_alerts(spark, sf), chat_id="chat-7")


@query
def sentiment_history(spark, sf):
    articles = N.with_published(M.articles(spark, sf))
    return ST.sentiment_history(N.sentiment_records(articles, WORDS.positive, WORDS.negative), "msft")


@query
def volume_top_decile(spark, sf):
    return rounded(ST.volume_top_decile(stored_bars(spark, sf)), 6, "threshold")


@query
def volume_sketch(spark, sf):
    """The volume percentile from sketches per ticker and year: whether its rank is within 1 % (and a bar) of the asked one."""
    bars = scan_bars(spark, sf).where("volume IS NOT NULL").select("ticker", "part", "volume")
    level = PC.sketched_percentile(PC.percentile_sketches(bars, ["ticker", "part"], "volume"), ["ticker"], 0.9)
    below = lambda test: F.sum(F.when(test, 1).otherwise(0)) / F.count(F.lit(1))
    ranks = bars.join(level, "ticker").groupBy("ticker").agg(
        F.count(F.lit(1)).alias("bars"), below(F.col("volume") < F.col("threshold")).alias("_low"),
        below(F.col("volume") <= F.col("threshold")).alias("_high"))
    room = 0.01 + 1 / F.col("bars")
    return ranks.select("ticker", "bars", ((F.col("_low") - room <= 0.9) & (F.col("_high") + room >= 0.9)).alias("near"))


@query
def table_counts(spark, sf):
    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))

    return (
        counted("bars", stored_bars(spark, sf))
        .unionByName(counted("user_alerts", M.user_alerts(spark, sf)))
        .unionByName(counted("insider_raw", M.insider_raw(spark, sf)))
        .unionByName(counted("articles", M.articles(spark, sf)))
    )


@query
def fresh_lookup(spark, sf):
    return P.fresh_lookup(M.quotes(spark, sf), "ticker", at(QUOTE_AS_OF), C.TTL_SECONDS["fundamentals"])


@query
def bar_upsert(spark, sf):
    """Daily bars as stored; the batch holds revised and new bars, several per key."""
    return sinks.merge_bars(stored_bars(spark, sf), _revised_bars(spark, sf), "o_orderkey")


def _revised_bars(spark: SparkSession, sf: str) -> DataFrame:
    order = F.pmod("o_orderkey", F.lit(2))
    return M.landed(spark, sf, "orders").select(
        M.symbol("o_custkey").alias("ticker"),
        F.lit("NEW").alias("exchange"),
        (F.col("o_orderdate") + F.make_interval(years=order.cast("int"))).alias("ts"),
        F.lit("1d").alias("timeframe"),
        *[(F.col("o_totalprice") / d).alias(n) for n, d in (("open", 16), ("high", 8), ("low", 32), ("close", 16))],
        F.col("o_custkey").alias("volume"),
        "o_orderkey",
    )


@query
def bar_upsert_versions(spark, sf):
    """The same upsert into a table that grows by versions: the stored bars, a batch of odd and one of even months."""
    table = VersionedTable(
        spark, f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}", SERIES, sinks.BAR_KEY, ("exchange", "open", "high", "low"))
    batch, odd = _revised_bars(spark, sf), F.month("ts") % 2 == 1
    table.append(stored_bars(spark, sf), 0)
    table.append(batch.where(odd), 1, "o_orderkey")
    table.append(batch.where(~odd), 2, "o_orderkey")
    return table.read()


@query
def bar_rejects(spark, sf):
    """Orders as bars of which some lack a price, a volume or a ticker: what the writer of the bar table turns away."""
    landed = M.landed(spark, sf, "orders").select(
        F.when(F.col("o_custkey") % 50 != 0, M.symbol("o_custkey")).alias("ticker"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("1d").alias("timeframe"),
        *[(F.col("o_totalprice") / d).alias(n) for n, d in (("open", 16), ("high", 8), ("low", 32))],
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 16).alias("close"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey")).alias("volume"),
    )
    path = f"{shared_folder(spark)}/landing-{uuid.uuid4().hex}"
    sinks.write_bars(landed, path)
    return sinks.read_rejects(spark, path).groupBy("ticker", "reason").agg(
        F.count(F.lit(1)).alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


# ---- indicators over the full history ----


@query
def sma(spark, sf):
    return rounded(I.sma(stored_bars(spark, sf), 20, name="sma_20"), 4, "sma_20")


@query
def ema(spark, sf):
    return rounded(I.ema(stored_bars(spark, sf), 20, name="ema_20"), 6, "ema_20")


@query
def rsi(spark, sf):
    return rounded(I.rsi(stored_bars(spark, sf)), 6, "rsi")


@query
def rsi_bands(spark, sf):
    return rounded(SG.rsi_bands(I.rsi(stored_bars(spark, sf))), 6, "rsi")


@query
def macd(spark, sf):
    return rounded(I.macd(stored_bars(spark, sf)), 6, "macd_line", "macd_signal", "macd_histogram")


@query
def volume_spike(spark, sf):
    return I.volume_spike(stored_bars(spark, sf))


@query
def moving_averages(spark, sf):
    return rounded(I.moving_averages(stored_bars(spark, sf)), 4, *I.ma_columns())


@query
def rolling_range(spark, sf):
    return L.rolling_range(stored_bars(spark, sf))


@query
def chart_series(spark, sf):
    """Bars, selected averages, RSI, direction flag and the level lines of the newest range."""
    bars = stored_bars(spark, sf)
    levels = L.fibonacci_levels(scan_bars(spark, sf), zones=zones(spark, sf)).select(*KEYS, *[L.column_name(n) for n, _ in C.RETRACEMENTS[1:-1]])
    series = I.indicator_series(bars, (50, 200)).select(
        *KEYS, "ts", "open", "high", "low", "close", "volume", "sma_50", "sma_200", "ema_50",
        "ema_200", "rsi",
    )
    out = series.withColumn("is_up", F.col("close") >= F.col("open")).join(levels, list(KEYS), "left")
    return rounded(out, 6, "sma_50", "sma_200", "ema_50", "ema_200", "rsi")


# ---- newest signals ----

_MAS = I.ma_columns()


@query
def signal_snapshot(spark, sf):
    out = SG.signal_snapshot(scan_bars(spark, sf), zones=zones(spark, sf)).select(
        *KEYS, "ts", "price", "rsi", "rsi_signal", "macd_line", "macd_signal", "macd_histogram",
        "macd_bullish", "volume_spike", *_MAS,
    )
    return rounded(out, 6, "macd_line", "macd_signal", "macd_histogram", *_MAS, "rsi")


@query
def live_override(spark, sf):
    signals = SG.signal_snapshot(scan_bars(spark, sf), zones=zones(spark, sf)).select("ticker", "price", "rsi", "close")
    return rounded(P.live_override(signals, M.quotes(spark, sf)), 6, "rsi")


@query
def momentum_score(spark, sf):
    signals = SG.signal_snapshot(scan_bars(spark, sf), zones=zones(spark, sf))
    return SG.with_momentum(signals).select("ticker", "momentum", "momentum_label", *SG.PART_NAMES)


@query
def ma_relation(spark, sf):
    return rounded(SG.ma_relation(SG.signal_snapshot(scan_bars(spark, sf), zones=zones(spark, sf))), 6, "value")


@query
def watch_rules(spark, sf):
    return rounded(SG.watch_rules(SG.signal_snapshot(scan_bars(spark, sf), zones=zones(spark, sf))), 6, "value")


@query
def multi_timeframe(spark, sf):
    return rounded(SG.multi_timeframe(scan_bars(spark, sf), zones=zones(spark, sf)), 6, "rsi")


@query
def resample_bars(spark, sf):
    bars = stored_bars(spark, sf)
    return RS.resample(bars, "1wk").unionByName(RS.resample(bars, "1mo"))


@query
def tick_bars(spark, sf):
    return M.minute_bars(spark, sf)


@query
def bar_change(spark, sf):
    bars = stored_bars(spark, sf).select(*KEYS, "ts", "open", "close")
    return rounded(P.bar_change(bars), 6, "pct")


@query
def day_change(spark, sf):
    return rounded(P.day_change(stored_bars(spark, sf), M.quotes(spark, sf), zones(spark, sf)), 6, "pct")


@query
def key_metrics(spark, sf):
    out = P.key_metrics(P.bar_scan(scan_bars(spark, sf), "1y", zones=zones(spark, sf)))
    return rounded(out, 6, "change", "change_pct")


@query
def listing_attrs(spark, sf):
    return P.listing_attributes(all_symbols(spark, sf))


# ---- levels ----


@query
def range_52w(spark, sf):
    return L.price_range(scan_bars(spark, sf), zones=zones(spark, sf)).drop("trend")


@query
def trend(spark, sf):
    return L.price_range(scan_bars(spark, sf), zones=zones(spark, sf)).select(*KEYS, "current_price", "trend")


_LEVELS = [L.column_name(n) for n, _ in C.RETRACEMENTS]
_EXTENSIONS = [L.column_name(n, "ext") for n, _ in C.EXTENSIONS]


@query
def fibonacci_levels(spark, sf):
    out = L.fibonacci_levels(scan_bars(spark, sf), zones=zones(spark, sf))
    return rounded(out, 6, "position_pct").drop("nearest_support", "nearest_resistance")


@query
def support_resistance(spark, sf):
    return L.fibonacci_levels(scan_bars(spark, sf), zones=zones(spark, sf)).select(
        *KEYS, "current_price", "nearest_support", "nearest_resistance"
    )


@query
def fib_markers(spark, sf):
    return L.fibonacci_rows(scan_bars(spark, sf), zones=zones(spark, sf))


# ---- listings and gaps ----


@query
def dual_listing_map(spark, sf):
    return AR.local_listing(all_symbols(spark, sf).withColumnRenamed("ticker", "ticker_us"))


@query
def competitors(spark, sf):
    return AR.competitors_of(all_symbols(spark, sf))


@query
def arbitrage_gap(spark, sf):
    gaps, _ = AR.arbitrage_gap(stored_bars(spark, sf), M.fx_rates(spark, sf))
    return gaps


# ---- news ----


@query
def rss_articles(spark, sf):
    return N.rss_articles(M.feeds(spark, sf), C.FEED_ITEMS)


@query
def search_results(spark, sf):
    return N.search_results(M.search_responses(spark, sf))


@query
def search_queries(spark, sf):
    return N.search_queries(all_symbols(spark, sf))


@query
def page_extract(spark, sf):
    return N.page_extract(M.landed(spark, sf, "pages"), ALLOWED_SITES)


@query
def tier_fallback(spark, sf):
    return N.tier_fallback(M.articles(spark, sf)).select("ticker", "pos", "tier")


@query
def title_dedup(spark, sf):
    return N.title_dedup(M.articles(spark, sf).select("ticker", "title", "pos", "source"))


@query
def url_dedup(spark, sf):
    """Documents of one source and language share a URL here, so that URLs repeat."""
    shared = F.concat(F.lit("http://"), "source", F.lit("/"), F.floor(F.col("pos") / 100))
    results = M.articles(spark, sf).select("ticker", "pos", shared.alias("url"))
    return N.url_dedup(results)


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("tier") == 0, 0).otherwise(1)
    # A handful of source names, so that the cap per source is reached.
    source = F.concat(F.lit("s"), F.pmod("pos", F.lit(4)).cast("string"))
    return M.articles(spark, sf).select(
        "ticker", "title", "pos", rank.alias("feed_rank"), source.alias("source")
    )


@query
def feed_merge(spark, sf):
    return N.feed_merge(_ranked(spark, sf))


@query
def feed_merge_greedy(spark, sf):
    return N.feed_merge_greedy(_ranked(spark, sf))


@query
def headline_score(spark, sf):
    out = N.with_score(M.articles(spark, sf), WORDS.positive, WORDS.negative)
    out = out.select("ticker", "pos", "positive_hits", "negative_hits", "score")
    return rounded(out, 6, "score")


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    return N.report_articles(M.articles(spark, sf).drop("tier"))


@query
def fresh_news(spark, sf):
    out = N.fresh_news(_articles(spark, sf), at(NEWS_AS_OF))
    age = text.age_text(F.col("published_at"), at(NEWS_AS_OF))
    return out.select("ticker", "pos", "title", "published_at", "is_fresh", age.alias("age"))


@query
def top_headlines(spark, sf):
    return N.top_headlines(_articles(spark, sf), as_of=at(NEWS_AS_OF))


@query
def first_headlines(spark, sf):
    return N.first_headlines(N.title_dedup(M.articles(spark, sf).select("ticker", "title", "pos")))


@query
def earnings_headlines(spark, sf):
    top = N.top_headlines(_articles(spark, sf), as_of=at(NEWS_AS_OF))
    return N.earnings_headlines(top, EARNINGS_WORDS).select("ticker", "rank", "place", "title")


@query
def high_impact_news(spark, sf):
    return N.high_impact(M.articles(spark, sf), IMPACT_WORDS).select(
        "ticker", "pos", "title", "is_high_impact"
    )


@query
def sentiment_report(spark, sf):
    return N.sentiment_report(
        all_symbols(spark, sf), M.articles(spark, sf), WORDS.positive, WORDS.negative
    )


@query
def sentiment_sources(spark, sf):
    return N.sentiment_sources(
        N.title_dedup(M.articles(spark, sf).select("ticker", "title", "pos", "url"))
    )


@query
def sentiment_bands(spark, sf):
    report = N.sentiment_report(
        all_symbols(spark, sf), M.articles(spark, sf), WORDS.positive, WORDS.negative
    )
    return report.select("ticker", "score", "band", scores.sentiment_bar(F.col("score")).alias("bar"))


# ---- company facts ----


@query
def company_profile(spark, sf):
    profile, _ = FU.company_profile(M.company_facts(spark, sf))
    return profile.drop("summary", "target_price_mean", "week_52_high", "week_52_low", "short_pct",
                        "short_ratio")


@query
def company_rejects(spark, sf):
    _, rejected = FU.company_profile(M.company_facts(spark, sf))
    return rejected


@query
def display_texts(spark, sf):
    profile, _ = FU.company_profile(M.company_facts(spark, sf))
    return FU.display_texts(profile).select("fact_id", "market_cap_text")


@query
def quarter_facts(spark, sf):
    return FU.quarter_facts(M.income_statements(spark, sf))


@query
def earnings_surprise(spark, sf):
    out = FU.earnings_report(
        M.income_statements(spark, sf), M.company_facts(spark, sf), M.earnings_calendar(spark, sf)
    )
    return out.drop("reported_at")


@query
def reporting_today(spark, sf):
    return FU.reporting_today(M.earnings_calendar(spark, sf), F.lit(TODAY).cast("date"))


@query
def reported_today(spark, sf):
    out = FU.reported_today(M.company_facts(spark, sf), F.lit(TODAY).cast("date"))
    return out.select("ticker", "fact_id", "reported_at")


@query
def insider_recent(spark, sf):
    return FU.insider_recent(M.insider_raw(spark, sf))


@query
def insider_insert_new(spark, sf):
    """Filings up to mid-1998 are stored; the batch brings all filings again."""
    rows = FU.normalised(M.insider_raw(spark, sf).where(F.col("filed_at").isNotNull()), "filing_id")
    stored = rows.where(F.col("transaction_date") < at("1998-07-01 00:00:00"))
    return FU.new_filings(stored, rows).select(*FU.FILING_KEY, "filing_id")


# ---- alerts ----


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    return P.last_two_closes(stored_bars(spark, sf), zones=zones(spark, sf)).select("ticker", F.col("last_close").alias("price"))


@query
def alert_validate(spark, sf):
    good, bad = AL.validate(M.alert_requests(spark, sf))
    columns = ("request_id", "chat_id", "ticker", "threshold", "reason")
    return good.withColumn("reason", F.lit(None).cast("string")).select(*columns).unionByName(
        bad.select(*columns)
    )


@query
def alert_set(spark, sf):
    good, _ = AL.validate(M.alert_requests(spark, sf))
    return AL.set_alerts(M.user_alerts(spark, sf), good, _prices(spark, sf)).drop("triggered_at")


@query
def alert_cancel(spark, sf):
    good, _ = AL.validate(M.alert_requests(spark, sf))
    updated, _ = AL.cancel_alerts(M.user_alerts(spark, sf), good)
    return updated.drop("triggered_at")


@query
def alert_cancel_missing(spark, sf):
    good, _ = AL.validate(M.alert_requests(spark, sf))
    _, missing = AL.cancel_alerts(M.user_alerts(spark, sf), good)
    return missing


@query
def alert_triggers(spark, sf):
    return R.alert_check(market(spark, sf), M.user_alerts(spark, sf))


@query
def alert_fired(spark, sf):
    alerts = M.user_alerts(spark, sf)
    fired = R.alert_check(market(spark, sf), alerts)
    return AL.mark_triggered(alerts, fired, at(NEWS_AS_OF)).select("id", "is_active", "triggered_at")


# ---- market time ----


def _times(spark: SparkSession, sf: str) -> DataFrame:
    return M.landed(spark, sf, "events").select("event_id", "ts")


@query
def is_nyse_open(spark, sf):
    return _times(spark, sf).withColumn("is_open", MT.is_nyse_open(F.col("ts")))


@query
def is_tase_open(spark, sf):
    return _times(spark, sf).withColumn("is_open", MT.is_tase_open(F.col("ts")))


@query
def sql_functions(spark, sf):
    """The SQL functions, called from SQL over the events: session, score label and place in a range."""
    SQL.register(spark)
    return spark.sql(
        """SELECT event_id, ts, is_nyse_open(ts) AS is_open, momentum_label(score) AS label,
        price_position(score, 20D, 80D) AS position
        FROM (SELECT event_id, ts, CAST(event_id * 7 % 101 AS INT) AS score FROM {events})""",
        events=_times(spark, sf))


@query
def market_status(spark, sf):
    return R.market_status_rows(_times(spark, sf))


@query
def session_label(spark, sf):
    return _times(spark, sf).withColumn("label", MT.session_label(F.col("ts")))


@query
def time_to_open(spark, sf):
    return _times(spark, sf).withColumn("countdown", MT.time_to_nyse_open(F.col("ts")))


# ---- reports ----


@query
def market_snapshot(spark, sf):
    out = R.market_snapshot(M.quotes(spark, sf), stored_bars(spark, sf), zones(spark, sf))
    return rounded(out, 6, "pct")


@query
def market_groups(spark, sf):
    return R.market_group(all_symbols(spark, sf))


@query
def sector_rotation(spark, sf):
    return R.sector_rotation(M.quotes(spark, sf), stored_bars(spark, sf), zones(spark, sf))


@query
def sector_breadth(spark, sf):
    return R.sector_breadth(M.quotes(spark, sf), stored_bars(spark, sf), zones(spark, sf))


@query
def vix_mood(spark, sf):
    return R.vix_mood(scan_bars(spark, sf), zones(spark, sf))


@query
def best_worst(spark, sf):
    out = R.best_worst(R.watch_signals(market(spark, sf), C.REPORT_WATCHLIST))
    return rounded(out, 6, "best_pct", "worst_pct")


@query
def best_momentum(spark, sf):
    return R.best_momentum(R.watch_signals(market(spark, sf), C.REPORT_WATCHLIST))


@query
def rsi_summary(spark, sf):
    return R.rsi_summary(R.watch_signals(market(spark, sf), C.REPORT_WATCHLIST))


@query
def compare_pair(spark, sf):
    return rounded(R.compare_pair(market(spark, sf), "AAPL", "MSFT"), 6, "first", "second")


@query
def analyze(spark, sf):
    out = R.analyze(market(spark, sf), at(NEWS_AS_OF), WORDS)
    out = rounded(out, 6, "rsi", "weekly_rsi", "monthly_rsi", "day_pct", "position_pct")
    return rounded(out, 6, "macd_line", "macd_signal", "macd_histogram", *_MAS)


@query
def close_report(spark, sf):
    return rounded(R.close_report(market(spark, sf), F.lit(TODAY).cast("date"), WORDS), 4, "value")


@query
def open_report(spark, sf):
    return rounded(R.open_report(market(spark, sf), F.lit(TODAY).cast("date")), 3, "value")


@query
def preopen_report(spark, sf):
    out = R.preopen_report(market(spark, sf), F.lit(TODAY).cast("date"), at(NEWS_AS_OF))
    return rounded(out, 4, "value")


# ---- streaming ----


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    # A glob, so that the table may be one file as well as a folder of files.
    events = spark.readStream.schema(LANDED["events"]).parquet(f"{sf}/event[s].parquet")
    return events.select(
        "event_id", M.symbol("user_id").alias("ticker"), "ts", (F.col("value") * 100).alias("price"),
        F.get_json_object("props", "$.k").try_cast("bigint").alias("size"),
    )


def _streamed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jobs.run_available(rows, f"{folder}/rows", f"{folder}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query
def stream_bars(spark, sf):
    return _streamed(spark, jobs.minute_bars(_event_stream(spark, sf)), "bars")


def _alerted(spark: SparkSession, sf: str) -> str:
    """An alert table that the event stream has run over."""
    folder = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    M.user_alerts(spark, sf).write.parquet(f"{folder}/table/version=-1")
    ticks = _event_stream(spark, sf).select("ticker", "ts", "price")
    writer = jobs.alert_writer(ticks, f"{folder}/table", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return f"{folder}/table"


@query
def stream_alerts(spark, sf):
    return jobs.fired_alerts(spark, _alerted(spark, sf)).drop("version")


@query
def stream_alert_table(spark, sf):
    """The alert table after the event stream: fired alerts are off and carry the time they fired."""
    return jobs.alert_table(spark, _alerted(spark, sf))


@query
def company_texts(spark, sf):
    """Company figures as they are shown, N/A where unknown, and each row as JSON."""
    profile, _ = FU.company_profile(FU.newest_per_ticker(M.company_facts(spark, sf), "fact_id"))
    shown = profile.select(
        "ticker", text.number_text(F.col("pe_trailing")).alias("pe_text"), text.number_text(F.col("eps_trailing")).alias("eps_text"),
        text.percent_text(F.col("dividend_yield")).alias("yield_text"), text.market_cap_text(F.col("market_cap")).alias("cap_text"),
        text.shortened(F.col("name"), 8).alias("short_name"))
    return shown.join(ST.json_rows(shown, "ticker"), "ticker")


@query
def stream_fresh(spark, sf):
    ticks = _event_stream(spark, sf).select("event_id", "ticker", "ts", "price")
    fresh = jobs.fresh_stream(ticks, "ticker", C.TTL_SECONDS["quote"], order=("ts", "event_id"))
    return _streamed(spark, fresh, "fresh").select("ticker", "period_ts", "ts", "price")


@query
def stream_signals(spark, sf):
    """Daily bars of the events of open sessions, merged into a bar table; newest signals of each batch."""
    folder = f"{shared_folder(spark)}/signals-{uuid.uuid4().hex}"
    table, out = f"{folder}/table", f"{folder}/signals"
    sinks.write_bars(stored_bars(spark, sf), table)
    ticks = jobs.while_open(_event_stream(spark, sf))
    bars = jobs.daily_bars(ticks.select("ticker", "ts", *[F.col("price").alias(n) for n in
                           ("open", "high", "low", "close")], F.col("size").alias("volume")))
    writer = jobs.signal_writer(bars, table, out, f"{folder}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    signals = spark.read.option("recursiveFileLookup", "true").parquet(out)
    return rounded(signals.select("ticker", "ts", "price", "rsi", "rsi_signal"), 6, "price", "rsi")
