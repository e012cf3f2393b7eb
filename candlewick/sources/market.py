"""Market tables derived from the landed tables.

Prices, quotes, rates, articles, facts, filings and alerts are cut out of the
generic landed tables by fixed rules. Assigning a symbol by key remainder gives
every landed row exactly one ticker; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.operators.resample import bars_from_ticks
from candlewick.sources.schemas import LANDED

SYMBOLS = (
    "AAPL", "MSFT", "NVDA", "GOOGL", "SPY", "QQQ",
    "TEVA", "TEVA.TA", "NICE", "NICE.TA", "CHKP", "CHKP.TA",
    "DIA", "IWM", "^VIX", "TLT", "GLD", "BTC-USD", "DX-Y.NYB",
    "XLK", "XLV", "XLF", "XLE", "XLI", "XLU",
)


def landed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(LANDED[name]).parquet(f"{folder}/{name}.parquet")


def state_of(spark: SparkSession, folder: str, name: str) -> tuple:
    """Number, size and last change of a landed table's files; their content is not read."""
    files = spark.read.format("binaryFile").load(f"{folder}/{name}.parquet")
    return tuple(
        files.agg(F.count("path"), F.sum("length"), F.max("modificationTime")).first()
    )


def symbol(key: str) -> Column:
    names = ", ".join(f"'{s}'" for s in SYMBOLS)
    return F.expr(f"element_at(array({names}), int(pmod({key}, {len(SYMBOLS)}) + 1))")


def exchange_of(ticker: Column) -> Column:
    return F.when(F.endswith(F.upper(ticker), F.lit(".TA")), "TASE").otherwise("NYSE")


def trades(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as trades at their unit price.

    ``seq`` orders them; it packs order, line, amount in cents and quantity into one
    number, because lines of an order may repeat and a number, unlike a struct, can be the
    buffer of a hash aggregation.
    """
    whole = lambda column, digits: column.cast(f"decimal({digits},0)")
    line = whole(F.col("l_orderkey") * 8 + F.col("l_linenumber"), 20)
    cents = whole(F.round(F.col("l_extendedprice") * 100), 10)
    seq = (line * whole(F.lit(10**9), 10) + cents) * whole(F.lit(100), 3) + whole(
        F.col("l_quantity"), 2
    )
    return landed(spark, folder, "lineitem").select(
        symbol("l_partkey").alias("ticker"),
        F.col("l_shipdate").alias("ts"),
        seq.alias("seq"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
    )


def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    """One bar per ticker and day; map tasks already fold their trades to one row each."""
    return (
        trades(spark, folder)
        .groupBy("ticker", "ts")
        .agg(
            F.min_by("price", "seq").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "seq").alias("close"),
            F.sum("size").cast("bigint").alias("volume"),
        )
        .select(
            "ticker",
            exchange_of(F.col("ticker")).alias("exchange"),
            "ts",
            F.lit("1d").alias("timeframe"),
            "open", "high", "low", "close", "volume",
        )
    )


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return landed(spark, folder, "events").select(
        "event_id",
        symbol("user_id").alias("ticker"),
        "ts",
        (F.col("value") * 100).alias("price"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )


def minute_bars(spark: SparkSession, folder: str) -> DataFrame:
    return bars_from_ticks(ticks(spark, folder).withColumn("size", F.col("k").cast("bigint")))


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes; a fifth of them come without a previous close."""
    previous = F.when(F.col("k") >= 20, F.col("price") / (1 + (F.col("k") - 60) / 1000.0))
    return ticks(spark, folder).select(
        "ticker", "ts", "event_id", F.col("price").alias("last_price"),
        previous.alias("prev_close"),
    )


def fx_rates(spark: SparkSession, folder: str) -> DataFrame:
    """One rate per pair and day: the day's last order sets it."""
    pair = (
        F.when(F.col("o_orderstatus") == "P", "USD/ILS")
        .when(F.col("o_orderstatus") == "F", "EUR/ILS")
        .otherwise("GBP/ILS")
    )
    return (
        landed(spark, folder, "orders")
        .groupBy(pair.alias("pair"), F.col("o_orderdate").alias("ts"))
        .agg(F.max_by(3.0 + F.col("o_totalprice") / 500000.0, "o_orderkey").alias("rate"))
    )


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """One article per document: its first line is the title, the whole text the snippet."""
    hours = F.make_interval(hours=F.pmod("doc_id", F.lit(72)).cast("int"))
    return (
        landed(spark, folder, "documents")
        .select(
            symbol("doc_id").alias("ticker"),
            F.col("doc_id").alias("pos"),
            F.pmod("doc_id", F.lit(3)).cast("int").alias("tier"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.concat(F.lit("http://"), "source", F.lit(".example.com/"), F.col("doc_id")).alias("url"),
            F.regexp_replace("text", "\n", " ").alias("snippet"),
            "source",
            (F.lit("2024-01-01").cast("timestamp") + hours).alias("_at"),
        )
        .withColumn(
            "published_raw",
            F.concat(F.date_format("_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")),
        )
        .drop("_at")
    )


FEED_SIZE = 12


def _escaped(text: Column) -> Column:
    # XML 1.0 has no place for control characters.
    text = F.regexp_replace(text, r"[\x00-\x1f\x7f￾￿]", " ")
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def feeds(spark: SparkSession, folder: str) -> DataFrame:
    """RSS text of at most ``FEED_SIZE`` consecutive articles; every third names no publisher."""
    feed_id = F.floor(F.col("pos") / FEED_SIZE)
    named = F.pmod("pos", F.lit(3)) != 0
    title = F.when(named, F.concat("title", F.lit(" - "), "source")).otherwise(F.col("title"))
    source = F.when(named, F.concat(F.lit('<source url="u">'), _escaped(F.col("source")),
                                    F.lit("</source>"))).otherwise("")
    item = F.concat(
        F.lit("<item><title>"), _escaped(title),
        F.lit("</title><link>"), F.col("url"),
        F.lit("</link><description>"), _escaped(F.concat(F.lit("<p>"), "snippet", F.lit("</p>"))),
        F.lit("</description><pubDate>"), F.col("published_raw"), F.lit("</pubDate>"),
        source, F.lit("</item>"),
    )
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"])
    return (
        articles(spark, folder)
        .select(feed_id.alias("feed_id"), "pos", item.alias("item"))
        .groupBy("feed_id")
        .agg(F.concat(F.lit("<rss><channel><title>feed</title>"), F.array_join(items, ""),
                      F.lit("</channel></rss>")).alias("xml"))
        .select("feed_id", F.lit("Feed").alias("fallback_source"), "xml")
    )


def search_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Search answers as JSON text, two queries per document's ticker; some fields missing."""
    item = F.struct(
        F.col("title"),
        F.col("url").alias("link"),
        F.when(F.pmod("pos", F.lit(5)) != 0, F.col("snippet")).alias("snippet"),
        F.col("source").alias("displayLink"),
    )
    return articles(spark, folder).select(
        "ticker",
        F.col("pos").alias("query_id"),
        F.to_json(F.struct(F.array(item).alias("items"))).alias("body"),
    )


def company_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts as they arrive: text values, missing keys, unusable numbers."""
    size = F.col("p_size")
    code = F.element_at(
        F.array(*[F.lit(c) for c in ("NYQ", "NYSEArca", "NMS", "NGM", "NCM", "LSE", "")]),
        F.pmod(size, F.lit(7)) + 1,
    )
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    number = lambda column: column.cast("string")
    facts = {
        "longName": F.when(F.pmod(size, F.lit(4)) != 0, F.col("p_name")),
        "shortName": F.when(F.pmod(size, F.lit(8)) != 0, F.col("p_brand")),
        "sector": F.col("p_type"),
        "industry": F.when(F.pmod(size, F.lit(3)) != 0, F.col("p_brand")),
        "exchange": code,
        "marketCap": F.when(F.pmod(size, F.lit(5)) == 0, F.lit("n/a"))
        .otherwise(number(cents * 10 * size * size)),
        "trailingPE": F.when(F.pmod(size, F.lit(6)) != 0, number(cents / 4096.0)),
        "forwardPE": F.when(F.pmod(size, F.lit(9)) != 0, number(cents / 8192.0)),
        "trailingEps": F.when(F.pmod(size, F.lit(11)) != 0, number(size / 8.0)),
        "forwardEps": number(size / 4.0),
        "dividendYield": F.when(F.pmod(size, F.lit(2)) == 0, number(size / 1024.0)),
        "currentPrice": F.when(F.pmod(size, F.lit(12)) != 0, number(cents / 64.0)),
        "fullTimeEmployees": number(cents),
        "revenueGrowth": F.when(F.pmod(size, F.lit(10)) != 0, number((size - 25) / 256.0)),
        "grossMargins": number(size / 64.0),
        "earningsTimestamp": F.when(
            F.pmod(size, F.lit(13)) != 0, number(F.lit(1704067200) + size * 21600)
        ),
    }
    pairs = [part for key, value in facts.items() for part in (F.lit(key), value)]
    return landed(spark, folder, "part").select(
        symbol("p_partkey").alias("ticker"),
        F.col("p_partkey").alias("fact_id"),
        F.create_map(*pairs).alias("facts"),
    )


def insider_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Filings as they arrive; one per order."""
    status = F.col("o_orderstatus")
    return landed(spark, folder, "orders").select(
        symbol("o_custkey").alias("ticker"),
        F.concat(F.lit("Insider "), F.pmod("o_custkey", F.lit(40)).cast("string")).alias("insider"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("position"),
        F.when(F.pmod("o_orderkey", F.lit(17)) != 0, F.col("o_orderdate")).alias("filed_at"),
        F.when(status == "F", "Sale at price").when(status == "O", "Purchase at price")
        .otherwise("Stock Award").alias("transaction"),
        (F.pmod("o_orderkey", F.lit(1000)) - 500).alias("shares"),
        F.when(F.pmod("o_orderkey", F.lit(9)) != 0, F.col("o_totalprice")).alias("value"),
        F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.concat(F.lit("http://filings.example/"),
               F.col("o_orderkey"))).alias("url"),
        F.col("o_orderkey").alias("filing_id"),
    )


def income_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Long quarterly statements: one line item per order status."""
    item = (
        F.when(F.col("o_orderstatus") == "F", "Total Revenue")
        .when(F.col("o_orderstatus") == "O", "Operating Revenue")
        .otherwise("Diluted EPS")
    )
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return (
        landed(spark, folder, "orders")
        .groupBy(
            symbol("o_custkey").alias("ticker"),
            item.alias("line_item"),
            F.date_trunc("quarter", "o_orderdate").alias("quarter_end"),
        )
        .agg(cents.alias("_cents"), F.count(F.lit(1)).alias("_n"))
        .select(
            "ticker", "line_item", "quarter_end",
            F.when(F.col("line_item") == "Diluted EPS",
                   F.floor(F.col("_cents") / F.col("_n") / 1000) / 1024.0)
            .otherwise(F.col("_cents") / 128.0).alias("value"),
        )
    )


def earnings_calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Announced dates and estimates, one row per customer."""
    key = F.col("c_custkey")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(key, F.lit(n)).cast("int"))
    return landed(spark, folder, "customer").select(
        symbol("c_custkey").alias("ticker"),
        key.alias("announcement_id"),
        F.array(day(30), day(40)).alias("earnings_dates"),
        F.when(F.pmod(key, F.lit(3)) != 0, key / 64.0).alias("earnings_average"),
        F.when(F.pmod(key, F.lit(4)) != 0, key / 32.0).alias("eps_estimate"),
        F.when(F.pmod(key, F.lit(5)) != 0, key * 1048576.0).alias("revenue_average"),
        F.when(F.pmod(key, F.lit(6)) != 0, key * 2097152.0).alias("revenue_estimate"),
    )


def user_alerts(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    return landed(spark, folder, "customer").select(
        key.alias("id"),
        F.concat(F.lit("chat-"), F.pmod(key, F.lit(40)).cast("string")).alias("chat_id"),
        symbol("c_custkey").alias("ticker"),
        F.when(F.pmod(key, F.lit(2)) == 0, "PRICE_ABOVE").otherwise("PRICE_BELOW").alias("alert_type"),
        (500 + F.col("c_acctbal")).alias("threshold"),
        (F.pmod(key, F.lit(7)) != 0).alias("is_active"),
        F.lit(None).cast("timestamp").alias("triggered_at"),
    )


def alert_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Requests as typed: any case, stray blanks, bad tickers and bad prices."""
    key = F.col("c_custkey")
    typed = F.concat(
        F.lit(" "), F.lower(symbol("c_custkey")),
        F.when(F.pmod("c_nationkey", F.lit(6)) == 0, "1").otherwise(""), F.lit(" "),
    )
    return landed(spark, folder, "customer").select(
        (key + 10_000_000).alias("request_id"),
        F.concat(F.lit("chat-"), F.pmod(key, F.lit(55)).cast("string")).alias("chat_id"),
        typed.alias("raw_ticker"),
        F.when(F.pmod(key, F.lit(8)) == 0, "abc")
        .otherwise((F.floor("c_acctbal") / 4.0).cast("string")).alias("raw_price"),
    )
