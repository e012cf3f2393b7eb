"""Company profiles, quarterly figures, earnings surprises and insider filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from candlewick.functions import text
from candlewick.sources import dims

FILINGS = 10
FILING_KEY = ["ticker", "insider_name", "transaction_date", "shares"]


def _fact(name: str) -> Column:
    return F.element_at("facts", F.lit(name))


def _text(name: str) -> Column:
    """Empty text counts as missing."""
    return F.when(_fact(name) != "", _fact(name))


def _double(name: str) -> Column:
    return _fact(name).try_cast("double")


def _long(name: str) -> Column:
    """Whole numbers as they are; numbers with a fraction or an exponent lose what follows the point."""
    fact = _fact(name)
    return F.coalesce(fact.try_cast("bigint"), fact.try_cast("double").try_cast("bigint"))


def company_profile(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed profiles, and rejected rows that carry neither a price nor a P/E.

    Unusable numbers become NULL. The exchange code table has a fixed size.
    """
    empty = (
        _fact("regularMarketPrice").isNull() & _fact("currentPrice").isNull()
        & _fact("trailingPE").isNull()
    )
    keep = [c for c in facts.columns if c not in ("ticker", "facts")]
    ticker = F.upper("ticker")
    names = dims.exchanges(facts.sparkSession)
    profile = (
        facts.where(~empty)
        .withColumn("code", _text("exchange"))
        .join(F.broadcast(names), "code", "left")
        .select(
            ticker.alias("ticker"), *keep,
            F.coalesce(_text("longName"), _text("shortName"), ticker).alias("name"),
            F.coalesce(_text("sector"), F.lit("")).alias("sector"),
            F.coalesce(_text("industry"), F.lit("")).alias("industry"),
            F.coalesce(_text("longBusinessSummary"), F.lit("")).alias("summary"),
            _long("marketCap").alias("market_cap"),
            _double("trailingPE").alias("pe_trailing"),
            _double("forwardPE").alias("pe_forward"),
            _double("trailingEps").alias("eps_trailing"),
            _double("forwardEps").alias("eps_forward"),
            _double("dividendYield").alias("dividend_yield"),
            _double("targetMeanPrice").alias("target_price_mean"),
            _double("fiftyTwoWeekHigh").alias("week_52_high"),
            _double("fiftyTwoWeekLow").alias("week_52_low"),
            F.when(F.endswith(ticker, F.lit(".TA")), "ILS").otherwise("USD").alias("currency"),
            _long("fullTimeEmployees").alias("employees"),
            F.coalesce("exchange", "code", F.lit("N/A")).alias("exchange"),
            _double("shortPercentOfFloat").alias("short_pct"),
            _double("shortRatio").alias("short_ratio"),
        )
    )
    rejected = facts.where(empty).select(
        ticker.alias("ticker"), *keep, F.lit("no fundamentals").alias("reason")
    )
    return profile, rejected


def newest_per_ticker(rows: DataFrame, order: str) -> DataFrame:
    """The row with the greatest ``order`` of every ticker; a row of NULLs where a ticker has none.

    The greatest ``order`` comes first, from a hash aggregation of two narrow columns. Only rows that
    carry it are folded: an aggregation of whole rows sorts all of a task's rows in memory.
    One number per ticker is broadcast.
    """
    fields = [c for c in rows.columns if c != "ticker"]
    top = rows.groupBy("ticker").agg(F.max(order).alias("_top")).withColumnRenamed("ticker", "_ticker")
    newest = rows.join(
        F.broadcast(top),
        F.col("ticker").eqNullSafe(F.col("_ticker")) & F.col(order).eqNullSafe(F.col("_top")))
    known = F.when(F.col("_top").isNotNull(), F.struct(*fields))
    return newest.select("ticker", "_top", known.alias("_row")).groupBy("ticker").agg(
        F.max_by("_row", "_top").alias("_row")
    ).select("ticker", "_row.*")


def display_texts(profile: DataFrame) -> DataFrame:
    """Display forms of the profile's numbers."""
    keep = [c for c in ("ticker", "fact_id") if c in profile.columns]
    return profile.select(
        *keep,
        text.market_cap_text(F.col("market_cap")).alias("market_cap_text"),
        text.number_text(F.col("pe_trailing"), "x", 1).alias("pe_text"),
        text.number_text(F.col("eps_trailing")).alias("eps_text"),
        text.percent_text(F.col("dividend_yield")).alias("yield_text"),
    )


# ---- quarterly figures ----


def quarter_facts(statements: DataFrame) -> DataFrame:
    """Newest quarter of every ticker: diluted EPS, revenue and the quarter's name."""
    item = lambda name: F.max(F.when(F.col("line_item") == name, F.col("value")))
    # Folded to one row per quarter first, so choosing the newest needs no second scan.
    quarters = statements.groupBy("ticker", "quarter_end").agg(
        item("Diluted EPS").alias("eps_actual"),
        F.coalesce(item("Total Revenue"), item("Operating Revenue")).alias("revenue_actual"),
    )
    newest = quarters.groupBy("ticker").agg(
        F.max("quarter_end").alias("quarter_end"),
        F.max_by("eps_actual", "quarter_end").alias("eps_actual"),
        F.max_by("revenue_actual", "quarter_end").alias("revenue_actual"),
    )
    label = F.concat(
        F.lit("Q"), F.quarter("quarter_end").cast("string"), F.lit(" "),
        F.year("quarter_end").cast("string"),
    )
    return newest.select(
        "ticker", "quarter_end", label.alias("quarter"), "eps_actual", "revenue_actual"
    )


def earnings_facts(facts: DataFrame) -> DataFrame:
    """What earnings reports need from the company facts."""
    keep = [c for c in facts.columns if c not in ("ticker", "facts")]
    return facts.select(
        F.upper("ticker").alias("ticker"), *keep,
        F.timestamp_seconds(_long("earningsTimestamp")).alias("reported_at"),
        F.round(_double("trailingEps") / 4, 2).alias("eps_estimate"),
        _double("revenueGrowth").alias("revenue_growth_yoy"),
        _double("grossMargins").alias("gross_margin"),
    )


def _surprise(actual: str, estimate: str) -> tuple[Column, Column]:
    a, e = F.col(actual), F.col(estimate)
    usable = a.isNotNull() & e.isNotNull() & (e != 0)
    return F.when(usable, F.round((a - e) / F.abs(e) * 100, 2)), F.when(usable, a >= e)


def earnings_surprise(figures: DataFrame) -> DataFrame:
    """Surprise in percent and beat flags; tickers with neither actual have no report.

    ``figures`` has the actuals and estimates of EPS and revenue per ticker.
    """
    eps, beat_eps = _surprise("eps_actual", "eps_estimate")
    revenue, beat_revenue = _surprise("revenue_actual", "revenue_estimate")
    return figures.where(
        F.col("eps_actual").isNotNull() | F.col("revenue_actual").isNotNull()
    ).withColumns(
        {
            "eps_surprise_pct": eps,
            "revenue_surprise_pct": revenue,
            "beat_eps": beat_eps,
            "beat_revenue": beat_revenue,
        }
    )


def earnings_report(statements: DataFrame, facts: DataFrame, calendar: DataFrame) -> DataFrame:
    """Newest quarterly report of every ticker against the newest facts and estimates."""
    estimates = newest_per_ticker(
        calendar.select("ticker", "announcement_id", "revenue_estimate"), "announcement_id"
    ).drop("announcement_id")
    known = newest_per_ticker(earnings_facts(facts), "fact_id").drop("fact_id")
    date = F.coalesce(F.date_format("reported_at", "MMM d, yyyy"), F.lit("N/A"))
    return earnings_surprise(
        quarter_facts(statements).join(known, "ticker", "left").join(estimates, "ticker", "left")
    ).withColumn("report_date", date)


def reporting_today(calendar: DataFrame, today: Column) -> DataFrame:
    """Announcements dated today, with the first estimate that is present."""
    return calendar.where(F.exists("earnings_dates", lambda d: d == today)).select(
        "ticker", "announcement_id",
        F.coalesce("earnings_average", "eps_estimate").alias("eps_estimate"),
        F.coalesce("revenue_average", "revenue_estimate").alias("revenue_estimate"),
    )


def reported_today(facts: DataFrame, today: Column) -> DataFrame:
    """Company facts whose earnings time falls on today's UTC date."""
    return earnings_facts(facts).where(F.to_date("reported_at") == today)


# ---- insider filings ----


def insider_recent(filings: DataFrame, limit: int = FILINGS) -> DataFrame:
    """The newest filings per ticker, normalised.

    The newest ``limit`` are chosen first and undated ones dropped afterwards.
    Anything that is not a purchase counts as a sale.
    """
    order = [F.col("filed_at").desc_nulls_last(), F.col("filing_id")]
    rank = F.row_number().over(W.partitionBy("ticker").orderBy(*order))
    recent = filings.withColumn("rank", rank).where(F.col("rank") <= limit)
    return normalised(recent.where(F.col("filed_at").isNotNull()), "rank")


def normalised(filings: DataFrame, *keep: str) -> DataFrame:
    bought = F.contains("transaction", F.lit("Purchase")) | F.contains("transaction", F.lit("Buy"))
    shares = F.abs(F.coalesce(F.col("shares").cast("bigint"), F.lit(0)))
    value = F.abs(F.col("value").cast("double"))
    return filings.select(
        F.upper("ticker").alias("ticker"), *keep,
        F.coalesce("insider", F.lit("Unknown")).alias("insider_name"),
        F.when(F.col("position") != "", F.col("position")).alias("insider_title"),
        F.col("filed_at").alias("transaction_date"),
        F.when(F.coalesce(bought, F.lit(False)), "BUY").otherwise("SELL").alias("transaction_type"),
        shares.alias("shares"),
        F.when(shares > 0, F.round(value / shares, 4)).alias("price_per_share"),
        value.alias("total_value"),
        F.when(F.col("url") != "", F.col("url")).alias("filing_url"),
    )


def new_filings(stored: DataFrame, batch: DataFrame, order: str = "filing_id") -> DataFrame:
    """Filings of a batch that are not stored yet; a key that repeats is taken once."""
    fields = [c for c in batch.columns if c not in FILING_KEY]
    once = batch.groupBy(*FILING_KEY).agg(F.min_by(F.struct(*fields), order).alias("_row")).select(
        *FILING_KEY, "_row.*"
    )
    return once.join(stored.select(*FILING_KEY), FILING_KEY, "left_anti")
