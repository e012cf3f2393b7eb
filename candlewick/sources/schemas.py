"""Declared schemas: the landed tables and the market tables at rest."""

from __future__ import annotations

LANDED = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, "
    "props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
}

BARS = (
    "ticker STRING, exchange STRING, ts TIMESTAMP, timeframe STRING, open DECIMAL(18,6), "
    "high DECIMAL(18,6), low DECIMAL(18,6), close DECIMAL(18,6), volume BIGINT, "
    "adj_close DECIMAL(18,6), created_at TIMESTAMP"
)
DUAL_LISTING_GAPS = (
    "ticker_us STRING, ticker_tase STRING, ts TIMESTAMP, price_us_usd DECIMAL(18,6), "
    "price_tase_ils DECIMAL(18,6), usd_ils_rate DECIMAL(10,6), "
    "price_tase_in_usd DECIMAL(18,6), gap_pct DECIMAL(8,4), gap_direction STRING"
)
USER_ALERTS = (
    "id BIGINT, chat_id STRING, ticker STRING, alert_type STRING, threshold DECIMAL(18,6), "
    "is_active BOOLEAN, triggered_at TIMESTAMP, created_at TIMESTAMP"
)
INSIDER_TRANSACTIONS = (
    "ticker STRING, insider_name STRING, insider_title STRING, transaction_date TIMESTAMP, "
    "transaction_type STRING, shares BIGINT, price_per_share DECIMAL(18,6), "
    "total_value DECIMAL(20,2), filing_url STRING"
)
SENTIMENT_RECORDS = (
    "ticker STRING, ts TIMESTAMP, score DECIMAL(5,4), headline_count INT, sources ARRAY<STRING>, "
    "summary_he STRING, summary_en STRING"
)
MARKET_TABLES = {
    "bars": BARS,
    "dual_listing_gaps": DUAL_LISTING_GAPS,
    "user_alerts": USER_ALERTS,
    "insider_transactions": INSIDER_TRANSACTIONS,
    "sentiment_records": SENTIMENT_RECORDS,
}

# One feed: items of an RSS channel. A ``source`` element has an attribute, so its
# text arrives as ``_VALUE``.
RSS = (
    "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, "
    "pubDate: STRING, source: STRUCT<_VALUE: STRING, _url: STRING>>>>"
)
SEARCH_RESPONSE = (
    "items ARRAY<STRUCT<title: STRING, link: STRING, snippet: STRING, displayLink: STRING>>"
)
