"""SQL counterparts of the named queries, for checking results with DuckDB.

Each query is a SELECT over common table expressions; only those it needs are
put in front of it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from candlewick import constants as C
from candlewick.operators.levels import column_name
from candlewick.plans.registry import (
    ALLOWED_SITES,
    EARNINGS_WORDS,
    IMPACT_WORDS,
    NEWS_AS_OF,
    QUOTE_AS_OF,
    TODAY,
    WORDS,
)
from candlewick.sources.market import SYMBOLS

CTE: dict[str, str] = {}
MATERIALIZED: set[str] = set()
ORACLE: dict[str, str] = {}


def _str(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _values(rows: Sequence[Sequence[object]], columns: str) -> str:
    cell = lambda v: str(v).lower() if isinstance(v, bool) else (
        str(v) if isinstance(v, int | float) else _str(v))
    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


def cte(name: str, sql: str, materialized: bool = False) -> None:
    CTE[name] = sql
    if materialized:
        MATERIALIZED.add(name)


def oracle(name: str, sql: str) -> None:
    needed: list[str] = []

    def visit(text: str) -> None:
        for other in CTE:
            if other not in needed and re.search(rf"\b{other}\b", text):
                if other in visiting:
                    continue
                visiting.add(other)
                visit(CTE[other])
                if other not in needed:
                    needed.append(other)

    visiting: set[str] = set()
    visit(sql)
    parts = []
    for other in needed:
        head = other
        body = CTE[other]
        if body.startswith("("):
            columns, body = body.split(")", 1)
            head = f"{other}{columns})"
        hint = "MATERIALIZED " if other in MATERIALIZED else ""
        parts.append(f"{head} AS {hint}({body})")
    ORACLE[name] = (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + sql


def sym(key: str) -> str:
    return f"([{', '.join(_str(s) for s in SYMBOLS)}])[({key} % {len(SYMBOLS)}) + 1]"


# ---- market tables ----

_ORDER = "(l_orderkey, l_linenumber, l_extendedprice, l_quantity)"
_PX = "(l_extendedprice / l_quantity)"
cte("bars", f"""SELECT ticker, CASE WHEN ticker LIKE '%.TA' THEN 'TASE' ELSE 'NYSE' END AS exchange,
 ts, '1d' AS timeframe, open, high, low, close, volume FROM (
 SELECT {sym('l_partkey')} AS ticker, l_shipdate AS ts, arg_min({_PX}, {_ORDER}) AS open,
 max({_PX}) AS high, min({_PX}) AS low, arg_max({_PX}, {_ORDER}) AS close,
 CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem GROUP BY ALL)""", True)
cte("symbols", "SELECT DISTINCT ticker FROM bars")
cte("ticks", f"""SELECT event_id, {sym('user_id')} AS ticker, ts, value * 100 AS price,
 CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""")
cte("minute_bars", """SELECT ticker, date_trunc('minute', ts) AS bar_ts, '1m' AS timeframe,
 arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
 arg_max(price, (ts, event_id)) AS close, CAST(sum(k) AS BIGINT) AS volume FROM ticks GROUP BY ALL""")
cte("quotes", """SELECT ticker, ts, event_id, price AS last_price,
 CASE WHEN k >= 20 THEN price / (1 + (k - 60) / 1000.0::DOUBLE) END AS prev_close FROM ticks""")
cte("latest", """SELECT ticker, ts, last_price, prev_close FROM quotes
 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) = 1""", True)
cte("fx", """SELECT CASE o_orderstatus WHEN 'P' THEN 'USD/ILS' WHEN 'F' THEN 'EUR/ILS'
 ELSE 'GBP/ILS' END AS pair, o_orderdate AS ts,
 arg_max(3.0::DOUBLE + o_totalprice / 500000.0::DOUBLE, o_orderkey) AS rate FROM orders GROUP BY ALL""")
cte("articles", f"""SELECT {sym('doc_id')} AS ticker, doc_id AS pos, CAST(doc_id % 3 AS INT) AS tier,
 split_part(text, chr(10), 1) AS title, 'http://' || source || '.example.com/' || doc_id AS url,
 replace(text, chr(10), ' ') AS snippet, source,
 TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 72 AS INT)) AS published_at FROM documents""")
cte("dedup", """SELECT * FROM articles WHERE title <> ''
 QUALIFY row_number() OVER (PARTITION BY ticker, title ORDER BY pos) = 1""", True)
cte("facts", f"""SELECT {sym('p_partkey')} AS ticker, p_partkey AS fact_id, p_size AS size,
 CASE WHEN p_size % 4 <> 0 THEN p_name END AS long_name,
 CASE WHEN p_size % 8 <> 0 THEN p_brand END AS short_name, p_type AS sector,
 CASE WHEN p_size % 3 <> 0 THEN p_brand END AS industry,
 (['NYQ','NYSEArca','NMS','NGM','NCM','LSE',''])[(p_size % 7) + 1] AS code,
 CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part""")
cte("typed_facts", """SELECT *, CASE WHEN size % 5 <> 0 THEN cents * 10 * size * size END AS market_cap,
 CASE WHEN size % 6 <> 0 THEN cents / 4096.0::DOUBLE END AS pe_trailing,
 CASE WHEN size % 9 <> 0 THEN cents / 8192.0::DOUBLE END AS pe_forward,
 CASE WHEN size % 11 <> 0 THEN size / 8.0::DOUBLE END AS eps_trailing,
 size / 4.0::DOUBLE AS eps_forward,
 CASE WHEN size % 2 = 0 THEN size / 1024.0::DOUBLE END AS dividend_yield,
 CASE WHEN size % 13 <> 0 THEN to_timestamp(1704067200 + size * 21600) AT TIME ZONE 'UTC' END AS reported_at,
 CASE WHEN size % 10 <> 0 THEN (size - 25) / 256.0::DOUBLE END AS revenue_growth_yoy,
 size / 64.0::DOUBLE AS gross_margin,
 size % 12 = 0 AND size % 6 = 0 AS is_empty FROM facts""")
cte("exchange_names", _values(C.EXCHANGES, "code, exchange_name"))
cte("profile", """SELECT f.ticker, fact_id, coalesce(long_name, short_name, f.ticker) AS name, sector,
 coalesce(industry, '') AS industry, market_cap, pe_trailing, pe_forward, eps_trailing, eps_forward,
 dividend_yield, CASE WHEN f.ticker LIKE '%.TA' THEN 'ILS' ELSE 'USD' END AS currency,
 cents AS employees, coalesce(exchange_name, nullif(f.code, ''), 'N/A') AS exchange
 FROM typed_facts f LEFT JOIN exchange_names USING (code) WHERE NOT is_empty""")
cte("statements", f"""SELECT ticker, line_item, quarter_end, CASE WHEN line_item = 'Diluted EPS'
 THEN floor(c / n / 1000) / 1024.0::DOUBLE ELSE c / 128.0::DOUBLE END AS value FROM (
 SELECT {sym('o_custkey')} AS ticker, CASE o_orderstatus WHEN 'F' THEN 'Total Revenue'
 WHEN 'O' THEN 'Operating Revenue' ELSE 'Diluted EPS' END AS line_item,
 date_trunc('quarter', o_orderdate) AS quarter_end,
 CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS c, count(*) AS n
 FROM orders GROUP BY ALL)""")
cte("calendar", f"""SELECT {sym('c_custkey')} AS ticker, c_custkey AS announcement_id,
 DATE '2024-01-01' + CAST(c_custkey % 30 AS INT) AS d1, DATE '2024-01-01' + CAST(c_custkey % 40 AS INT) AS d2,
 coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey / 64.0::DOUBLE END,
  CASE WHEN c_custkey % 4 <> 0 THEN c_custkey / 32.0::DOUBLE END) AS eps_estimate,
 CASE WHEN c_custkey % 6 <> 0 THEN c_custkey * 2097152.0::DOUBLE END AS stated_revenue,
 coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 1048576.0::DOUBLE END,
  CASE WHEN c_custkey % 6 <> 0 THEN c_custkey * 2097152.0::DOUBLE END) AS revenue_estimate FROM customer""")
cte("filings", f"""SELECT {sym('o_custkey')} AS ticker, o_orderkey AS filing_id,
 'Insider ' || (o_custkey % 40) AS insider_name,
 CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS insider_title,
 CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END AS transaction_date,
 CASE WHEN o_orderstatus = 'O' THEN 'BUY' ELSE 'SELL' END AS transaction_type,
 abs((o_orderkey % 1000) - 500) AS shares,
 CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS total_value,
 CASE WHEN o_orderkey % 2 = 0 THEN 'http://filings.example/' || o_orderkey END AS filing_url FROM orders""")
cte("user_alerts", f"""SELECT c_custkey AS id, 'chat-' || (c_custkey % 40) AS chat_id,
 {sym('c_custkey')} AS ticker, CASE WHEN c_custkey % 2 = 0 THEN 'PRICE_ABOVE' ELSE 'PRICE_BELOW' END
 AS alert_type, 500 + c_acctbal AS threshold, c_custkey % 7 <> 0 AS is_active FROM customer""")
cte("requests", f"""SELECT c_custkey + 10000000 AS request_id, 'chat-' || (c_custkey % 55) AS chat_id,
 {sym('c_custkey')} || CASE WHEN c_nationkey % 6 = 0 THEN '1' ELSE '' END AS ticker,
 CASE WHEN c_custkey % 8 <> 0 THEN floor(c_acctbal) / 4.0::DOUBLE END AS threshold FROM customer""")
cte("checked", r"""SELECT *, CASE WHEN NOT regexp_full_match(ticker, '[A-Z.\-]{1,10}') THEN 'invalid ticker'
 WHEN threshold IS NULL OR threshold <= 0 THEN 'invalid price' END AS reason FROM requests""")
cte("good_requests", "SELECT * FROM checked WHERE reason IS NULL")
cte("watch", _values(list(enumerate(C.REPORT_WATCHLIST)), "pos, ticker"))
cte("preview_watch", _values(list(enumerate(C.PREVIEW_WATCHLIST)), "pos, ticker"))
cte("dual", _values(C.DUAL_LISTED, "ticker_us, ticker_tase"))
cte("snapshot_symbols", _values([(i, *r[:3]) for i, r in enumerate(C.SNAPSHOT)],
                                "pos, ticker, label, market_group"))
cte("sector_symbols", _values([(i, *r) for i, r in enumerate(C.SECTORS)], "pos, ticker, name"))

# ---- series ----

cte("num", "SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS rn FROM bars", True)
cte("two", """SELECT ticker, arg_max(close, ts) AS last_close,
 max(CASE WHEN recency = 2 THEN close END) AS close_before FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS recency FROM bars)
 WHERE recency <= 2 GROUP BY ticker""", True)
for unit, tf, years in (("day", "1d", 1), ("week", "1wk", 2), ("month", "1mo", 5)):
    cte(f"bars_{tf}", f"""SELECT ticker, date_trunc('{unit}', ts)::TIMESTAMP AS pts, '{tf}' AS timeframe,
     arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close,
     CAST(sum(volume) AS BIGINT) AS volume FROM bars GROUP BY ALL""")
    cte(f"look_{tf}", f"""SELECT ticker, pts AS ts, '{tf}' AS timeframe, open, high, low, close, volume,
     row_number() OVER (PARTITION BY ticker ORDER BY pts) - 1 AS rn FROM bars_{tf}
     WHERE pts > (SELECT max(ts) FROM bars) - INTERVAL {years} YEAR""", True)

_SPANS = (12, 26, *C.MA_PERIODS)


def _decay(previous: str, value: str, alpha: float) -> str:
    return f"({previous} * {1 - alpha!r} + {value} * {alpha!r})"


def _recursion(name: str, source: str) -> None:
    spans = [(p, 2.0 / (p + 1)) for p in _SPANS]
    step = {p: _decay(f"r.e{p}", "n.close", a) for p, a in spans}
    up, down = "greatest(n.close - r.close, 0.0)", "greatest(r.close - n.close, 0.0)"
    wilder = lambda c, v: f"CASE WHEN n.rn = 1 THEN {v} ELSE {_decay('r.' + c, v, 1 / 14)} END"
    line = f"({step[12]} - {step[26]})"
    cte(f"{name}_rec", f"""(ticker, rn, close, {', '.join(f'e{p}' for p in _SPANS)}, g, l, sig)
     SELECT ticker, rn, close, {', '.join('close' for _ in _SPANS)}, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE
     FROM {source} WHERE rn = 0 UNION ALL
     SELECT n.ticker, n.rn, n.close, {', '.join(step[p] for p in _SPANS)}, {wilder('g', up)}, {wilder('l', down)},
     CASE WHEN n.rn = 25 THEN {line} WHEN n.rn > 25 THEN {_decay('r.sig', line, 0.2)} END
     FROM {name}_rec r JOIN {source} n ON n.ticker = r.ticker AND n.rn = r.rn + 1""")
    frame = "OVER (PARTITION BY s.ticker ORDER BY s.rn ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    mas = []
    for p in C.MA_PERIODS:
        over = frame.format(p - 1)
        mas.append(f"CASE WHEN s.rn >= {p - 1} THEN avg(s.close) {over} END AS sma_{p}")
        mas.append(f"CASE WHEN s.rn >= {p - 1} THEN r.e{p} END AS ema_{p}")
    line = "CASE WHEN s.rn >= 25 THEN r.e12 - r.e26 END"
    sig = "CASE WHEN s.rn >= 33 THEN r.sig END"
    cte(name, f"""SELECT *, CASE WHEN rsi <= 30 AND rsi <> 0 THEN 'OVERSOLD' WHEN rsi >= 70 THEN 'OVERBOUGHT'
     ELSE 'NEUTRAL' END AS rsi_signal, coalesce(macd_histogram > 0, false) AS macd_bullish FROM (
     SELECT s.*, {', '.join(mas)}, {line} AS macd_line, {sig} AS macd_signal, ({line}) - ({sig}) AS macd_histogram,
     CASE WHEN s.rn < 14 THEN NULL WHEN r.g = 0 THEN 0 WHEN r.l = 0 THEN 100
      ELSE 100 - 100 / (1 + r.g / r.l) END AS rsi,
     CASE WHEN s.rn >= 9 THEN s.volume >= 2 * avg(s.volume) {frame.format(9)} ELSE false END AS volume_spike,
     lag(s.close, 5) OVER w AS close_before_5, lag(s.close) OVER w AS close_before,
     max(s.close) {frame.format(C.RANGE_BARS - 1)} AS high_52w, min(s.close) {frame.format(C.RANGE_BARS - 1)} AS low_52w,
     coalesce(lag(s.close, 19) OVER w, first_value(s.close) OVER w) AS anchor,
     lead(s.rn) OVER w IS NULL AS is_last
     FROM {source} s JOIN {name}_rec r ON r.ticker = s.ticker AND r.rn = s.rn
     WINDOW w AS (PARTITION BY s.ticker ORDER BY s.rn))""", True)


_recursion("history", "num")
for tf in ("1d", "1wk", "1mo"):
    _recursion(f"ind_{tf}", f"look_{tf}")
    cte(f"sig_{tf}", f"""SELECT *, CASE WHEN close > anchor THEN 'UPTREND' ELSE 'DOWNTREND' END AS trend,
     rn + 1 AS bars_seen FROM ind_{tf} WHERE is_last""")

_LEVEL = {n: f"round(high_52w - (high_52w - low_52w) * {r}, 4)" for n, r in C.RETRACEMENTS}
_EXT = {n: f"round(low_52w + (high_52w - low_52w) * {r}, 4)" for n, r in C.EXTENSIONS}
_LEVEL_LIST = f"[{', '.join(_LEVEL.values())}]"


def _nearest(price: str) -> str:
    return f"""coalesce(list_max([v FOR v IN {_LEVEL_LIST} IF v < {price}]), low_52w) AS nearest_support,
     coalesce(list_min([v FOR v IN {_LEVEL_LIST} IF v > {price}]), high_52w) AS nearest_resistance"""


cte("ranges", f"""SELECT ticker, timeframe, max(CASE WHEN recency <= {C.RANGE_BARS} THEN close END) AS high_52w,
 min(CASE WHEN recency <= {C.RANGE_BARS} THEN close END) AS low_52w,
 max(CASE WHEN recency = 1 THEN close END) AS current_price,
 arg_max(close, recency) FILTER (recency <= {C.TREND_BARS}) AS anchor, count(*) AS bars_seen FROM (
 SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS recency FROM bars)
 WHERE recency <= {C.RANGE_BARS} GROUP BY ALL""")
cte("usable", """SELECT *, CASE WHEN current_price > anchor THEN 'UPTREND' ELSE 'DOWNTREND' END AS trend
 FROM ranges WHERE bars_seen >= 2 AND high_52w <> low_52w""")

# ---- momentum, prices, reports ----


def _pct(new: str, old: str) -> str:
    return f"coalesce(CASE WHEN {old} <> 0 THEN ({new} - {old}) / {old} * 100 END, 0.0)"


def _direction(pct: str) -> str:
    return f"CASE WHEN {pct} > 0.005 THEN 'up' WHEN {pct} < -0.005 THEN 'down' ELSE 'flat' END"


_RSI_POINTS = "CASE WHEN rsi > 70 THEN 20 WHEN rsi >= 50 THEN 15 WHEN rsi >= 40 THEN 10 ELSE 0 END"
_CHANGE = "CASE WHEN close_before_5 <> 0 THEN (price - close_before_5) / close_before_5 * 100 END"
_CHANGE_POINTS = (f"CASE WHEN {_CHANGE} > 3.0 THEN 20 WHEN {_CHANGE} > 1.0 THEN 15 "
                  f"WHEN {_CHANGE} > 0 THEN 10 ELSE 0 END")
_LABEL = (" ".join(["CASE"] + [f"WHEN momentum >= {f} THEN '{n}'" for f, n in C.MOMENTUM_LABELS])
          + f" ELSE '{C.MOMENTUM_LOWEST}' END")


def _momentum(source: str, change: str = _CHANGE_POINTS) -> str:
    return f"""SELECT *, {_LABEL} AS momentum_label FROM (SELECT *,
     rsi_points + sma200_points + macd_points + volume_points + change_points AS momentum FROM (
     SELECT *, {_RSI_POINTS} AS rsi_points, CASE WHEN price > sma_200 THEN 20 ELSE 0 END AS sma200_points,
     CASE WHEN macd_histogram > 0 THEN 20 ELSE 0 END AS macd_points,
     CASE WHEN volume_spike THEN 20 ELSE 0 END AS volume_points, {change} AS change_points FROM {source}))"""


cte("priced_close", "SELECT *, close AS price FROM sig_1d")
cte("priced_live", """SELECT s.*, coalesce(q.last_price, s.close) AS price, q.prev_close
 FROM sig_1d s LEFT JOIN latest q ON q.ticker = s.ticker""")
cte("scored_close", _momentum("priced_close"))
cte("scored_live", _momentum("priced_live"))
cte("scored_pair", _momentum("priced_live", "0"))
cte("quoted", """SELECT s.ticker, CASE WHEN q.prev_close IS NOT NULL THEN q.last_price
 WHEN t.close_before IS NOT NULL THEN t.last_close END AS price,
 CASE WHEN q.prev_close IS NOT NULL THEN q.prev_close WHEN t.close_before IS NOT NULL THEN t.close_before END
 AS previous, CASE WHEN q.prev_close IS NOT NULL THEN 'quote' WHEN t.close_before IS NOT NULL THEN 'close' END
 AS price_source FROM symbols s LEFT JOIN latest q USING (ticker) LEFT JOIN two t USING (ticker)""")
cte("snap", f"""SELECT *, CASE WHEN pct IS NOT NULL THEN {_direction('pct')} END AS direction FROM (
 SELECT y.pos, y.ticker, y.label, y.market_group, q.price,
 CASE WHEN q.price IS NOT NULL THEN {_pct('q.price', 'q.previous')} END AS pct
 FROM snapshot_symbols y LEFT JOIN quoted q USING (ticker))""")
cte("sector", f"""SELECT *, CASE WHEN pct_change > 1.5 THEN 'hot' WHEN pct_change >= 0 THEN 'up'
 WHEN pct_change >= -0.5 THEN 'soft' ELSE 'down' END AS band FROM (
 SELECT y.pos, y.ticker, y.name, round({_pct('q.price', 'q.previous')}, 2) AS pct_change,
 round(q.price, 2) AS price FROM sector_symbols y JOIN quoted q USING (ticker) WHERE q.price IS NOT NULL)""")
for watch, source in (("watch", "watched"), ("preview_watch", "previewed")):
    cte(source, f"""SELECT *, CASE WHEN pct IS NOT NULL THEN {_direction('pct')} END AS direction FROM (
     SELECT w.pos, w.ticker AS watch_ticker, s.* EXCLUDE (ticker), CASE WHEN s.close IS NOT NULL
     THEN {_pct('s.close', 's.open')} END AS pct FROM {watch} w LEFT JOIN scored_live s USING (ticker))""", True)


# ---- news ----


def _hits(words: Sequence[str], text: str) -> str:
    return " + ".join(f"CAST(contains(lower({text}), {_str(w.lower())}) AS INT)" for w in words)


_BODY = "title || ' ' || snippet"
_HOST = ("CASE WHEN len(string_split(url, '/')) >= 3 THEN string_split(url, '/')[3] ELSE url END")


def _scored(source: str) -> str:
    return f"""SELECT *, CASE WHEN positive_hits + negative_hits > 0 THEN
     CAST(positive_hits - negative_hits AS DOUBLE) / (positive_hits + negative_hits) ELSE 0.0 END AS score
     FROM (SELECT *, {_hits(WORDS.positive, _BODY)} AS positive_hits,
     {_hits(WORDS.negative, _BODY)} AS negative_hits FROM {source})"""


cte("scored", _scored("articles"))
cte("scored_dedup", _scored("dedup"))
cte("best_tier", """SELECT * FROM articles
 QUALIFY tier = min(tier) OVER (PARTITION BY ticker)""")
cte("best_dedup", """SELECT * FROM best_tier WHERE title <> ''
 QUALIFY row_number() OVER (PARTITION BY ticker, title ORDER BY pos) = 1""")
cte("scored_best", _scored("best_dedup"))
cte("sentiment", f"""SELECT *, CASE WHEN score >= 0.3 THEN 'positive' WHEN score <= -0.3 THEN 'negative'
 ELSE 'neutral' END AS band, CASE WHEN headline_count > 0 THEN ticker || ' sentiment: ' || positive_count ||
 ' positive, ' || negative_count || ' negative, ' || neutral_count || ' neutral across ' || headline_count ||
 ' articles.' ELSE 'No news found.' END AS summary FROM (
 SELECT s.ticker, coalesce(round(avg(a.score), 4), 0.0) AS score, count(a.pos) AS headline_count,
 count(*) FILTER (a.score > 0) AS positive_count, count(*) FILTER (a.score < 0) AS negative_count,
 count(a.pos) - count(*) FILTER (a.score > 0) - count(*) FILTER (a.score < 0) AS neutral_count,
 count(DISTINCT {_HOST}) AS source_count FROM symbols s LEFT JOIN scored_best a USING (ticker) GROUP BY s.ticker)""")


def _fresh(source: str) -> str:
    return f"""SELECT * FROM (SELECT *, epoch(TIMESTAMP '{NEWS_AS_OF}') - epoch(published_at) <= {C.FRESH_SECONDS}
     AS is_fresh FROM {source}) QUALIFY is_fresh OR NOT max(is_fresh) OVER (PARTITION BY ticker)"""


def _top(source: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC, pos) AS rank FROM (
     SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY ticker, source
     ORDER BY published_at DESC, pos) = 1) QUALIFY rank <= 5"""


cte("fresh", _fresh("dedup"))
cte("top5", _top("fresh"))
cte("fresh_best", _fresh("best_dedup"))
cte("top_best", _top("fresh_best"))
cte("ranked", """SELECT * REPLACE ('s' || (pos % 4) AS source),
 CASE WHEN tier = 0 THEN 0 ELSE 1 END AS feed_rank FROM articles""")
cte("merge_items", f"""SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY feed_rank, pos) AS i FROM (
 SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY ticker, feed_rank ORDER BY pos) <=
 CASE feed_rank WHEN 0 THEN {C.FIRST_FEED_ITEMS} ELSE {C.SECOND_FEED_ITEMS} END) WHERE title <> ''""", True)
cte("merge_fold", f"""(ticker, i, titles, sources, picked)
 SELECT ticker, i, [title], [source], true FROM merge_items WHERE i = 1 UNION ALL
 SELECT ticker, i, CASE WHEN ok THEN list_append(titles, title) ELSE titles END,
 CASE WHEN ok THEN list_append(sources, source) ELSE sources END, ok FROM (
 SELECT m.ticker, m.i, f.titles, f.sources, m.title, m.source, NOT list_contains(f.titles, m.title)
 AND len([s FOR s IN f.sources IF s = m.source]) < {C.MAX_PER_SOURCE} AS ok
 FROM merge_fold f JOIN merge_items m ON m.ticker = f.ticker AND m.i = f.i + 1)""")

# ---- earnings, prices for alerts ----

cte("quarters", """SELECT s.ticker, s.quarter_end, 'Q' || quarter(s.quarter_end) || ' ' || year(s.quarter_end)
 AS quarter, max(CASE WHEN line_item = 'Diluted EPS' THEN value END) AS eps_actual,
 coalesce(max(CASE WHEN line_item = 'Total Revenue' THEN value END),
 max(CASE WHEN line_item = 'Operating Revenue' THEN value END)) AS revenue_actual
 FROM statements s JOIN (SELECT ticker, max(quarter_end) AS quarter_end FROM statements GROUP BY ticker) m
 USING (ticker, quarter_end) GROUP BY s.ticker, s.quarter_end""")
cte("newest_facts", "SELECT * FROM typed_facts QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY fact_id DESC) = 1")
cte("newest_calendar", """SELECT * FROM calendar
 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY announcement_id DESC) = 1""")


def _surprise(a: str, e: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {e} <> 0 THEN round(({a} - {e}) / abs({e}) * 100, 2) END"


def _beat(a: str, e: str) -> str:
    return f"CASE WHEN {a} IS NOT NULL AND {e} <> 0 THEN {a} >= {e} END"


cte("earnings", f"""SELECT *, {_surprise('eps_actual', 'eps_estimate')} AS eps_surprise_pct,
 {_surprise('revenue_actual', 'revenue_estimate')} AS revenue_surprise_pct,
 {_beat('eps_actual', 'eps_estimate')} AS beat_eps, {_beat('revenue_actual', 'revenue_estimate')} AS beat_revenue
 FROM (SELECT q.*, round(f.eps_trailing / 4, 2) AS eps_estimate, f.revenue_growth_yoy, f.gross_margin,
 c.stated_revenue AS revenue_estimate, coalesce(strftime(f.reported_at, '%b %-d, %Y'), 'N/A') AS report_date,
 f.reported_at FROM quarters q LEFT JOIN newest_facts f USING (ticker) LEFT JOIN newest_calendar c USING (ticker))
 WHERE eps_actual IS NOT NULL OR revenue_actual IS NOT NULL""")
cte("close_price", "SELECT ticker, last_close AS price FROM two")
cte("live_price", """SELECT ticker, coalesce(q.last_price, t.last_close) AS price
 FROM two t FULL JOIN latest q USING (ticker)""")
cte("fired", """SELECT a.id, a.chat_id, a.ticker, a.alert_type, a.threshold, p.price FROM user_alerts a
 JOIN live_price p USING (ticker) WHERE is_active AND ((alert_type = 'PRICE_ABOVE' AND price >= threshold)
 OR (alert_type = 'PRICE_BELOW' AND price <= threshold))""")

# ================= queries =================

_OHLCV = "open, high, low, close, volume"
oracle("daily_bars", "SELECT * FROM bars")
oracle("bar_scan", f"""SELECT ticker, ts, timeframe, {_OHLCV} FROM bars
 WHERE ts > (SELECT max(ts) FROM bars) - INTERVAL 6 MONTH""")
oracle("last_bar", """SELECT * FROM bars
 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 1""")
oracle("last_n_bars", f"""SELECT ticker, bar_ts AS ts, timeframe, {_OHLCV},
 CAST(row_number() OVER (PARTITION BY ticker ORDER BY bar_ts DESC) AS INT) AS recency
 FROM minute_bars QUALIFY recency <= 10""")
oracle("latest_quote", "SELECT * FROM latest")
oracle("quote_or_close", "SELECT * FROM quoted")
oracle("price_query", f"""SELECT ts, {_OHLCV} FROM bars WHERE ticker = 'AAPL' AND ts >= '1997-01-01'
 AND ts <= '1999-12-31' ORDER BY ts DESC LIMIT 100""")
cte("gaps", f"""SELECT ticker_us, ticker_tase, timeframe, ts, price_us_usd, price_tase_ils, usd_ils_rate,
 round(local, 4) AS price_tase_in_usd, round(abs(gap), 4) AS gap_pct,
 CASE WHEN gap > 0 THEN 'US_PREMIUM' ELSE 'TASE_PREMIUM' END AS gap_direction, abs(gap) >= {C.MIN_GAP_PCT} AS is_opportunity
 FROM (SELECT *, (price_us_usd - local) / local * 100 AS gap FROM (
 SELECT *, price_tase_ils / usd_ils_rate AS local FROM (
 SELECT d.ticker_us, d.ticker_tase, u.timeframe, u.ts, u.close AS price_us_usd, t.close AS price_tase_ils,
 coalesce((SELECT arg_max(rate, f.ts) FROM fx f WHERE f.pair = 'USD/ILS' AND f.ts <= u.ts), {C.FALLBACK_USD_ILS}) AS usd_ils_rate
 FROM dual d JOIN bars u ON u.ticker = d.ticker_us JOIN bars t ON t.ticker = d.ticker_tase AND t.ts = u.ts)))
 WHERE price_us_usd <> 0 AND price_tase_ils <> 0""")
oracle("arbitrage_gap", "SELECT * FROM gaps")
oracle("gap_history", """SELECT ts, gap_pct, gap_direction, price_us_usd, price_tase_in_usd FROM gaps
 WHERE ticker_us = 'TEVA' AND gap_pct >= 5.0 ORDER BY ts DESC LIMIT 50""")
oracle("active_alerts", """SELECT id, ticker, alert_type, threshold, chat_id FROM user_alerts
 WHERE is_active AND chat_id = 'chat-7'""")
oracle("sentiment_history", """SELECT date_trunc('hour', published_at) AS ts, round(avg(score), 4) AS score,
 CAST(count(*) AS INT) AS headline_count FROM scored_dedup WHERE ticker = 'MSFT' GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
oracle("volume_top_decile", """SELECT ticker, ts, volume, close, round(threshold, 6) AS threshold,
 CAST(row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS INT) AS recency FROM bars
 JOIN (SELECT ticker, quantile_cont(volume::DOUBLE, 0.9) AS threshold FROM bars GROUP BY ticker) USING (ticker)
 WHERE volume >= threshold QUALIFY recency <= 20""")
oracle("table_counts", """SELECT 'bars' AS table_name, count(*) AS row_count FROM bars UNION ALL
 SELECT 'user_alerts', count(*) FROM user_alerts UNION ALL SELECT 'insider_raw', count(*) FROM filings UNION ALL
 SELECT 'articles', count(*) FROM articles""")
oracle("fresh_lookup", f"""SELECT * FROM (SELECT ticker, ts, event_id, last_price, prev_close FROM quotes
 WHERE ts <= TIMESTAMP '{QUOTE_AS_OF}' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY ts DESC, event_id DESC) = 1)
 WHERE floor(epoch(TIMESTAMP '{QUOTE_AS_OF}')) - floor(epoch(ts)) <= {C.TTL_SECONDS['fundamentals']}""")
cte("batch", f"""SELECT {sym('o_custkey')} AS ticker, 'NEW' AS exchange,
 o_orderdate + to_years(CAST(o_orderkey % 2 AS INT)) AS ts, '1d' AS timeframe, o_totalprice / 16 AS open,
 o_totalprice / 8 AS high, o_totalprice / 32 AS low, o_totalprice / 16 AS close, o_custkey AS volume FROM orders
 QUALIFY row_number() OVER (PARTITION BY o_custkey % {len(SYMBOLS)}, ts ORDER BY o_orderkey DESC) = 1""")
oracle("bar_upsert", """SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(o.exchange, n.exchange) AS exchange,
 coalesce(o.ts, n.ts) AS ts, coalesce(o.timeframe, n.timeframe) AS timeframe, coalesce(o.open, n.open) AS open,
 coalesce(o.high, n.high) AS high, coalesce(o.low, n.low) AS low, coalesce(n.close, o.close) AS close,
 coalesce(n.volume, o.volume) AS volume FROM bars o FULL JOIN batch n ON n.ticker = o.ticker AND n.ts = o.ts""")
oracle("volume_sketch", """SELECT ticker, count(*) AS bars, true AS near FROM bars WHERE volume IS NOT NULL
 GROUP BY ticker""")
ORACLE["bar_upsert_versions"] = ORACLE["bar_upsert"]

_KEY = "ticker, timeframe, ts"
oracle("sma", f"SELECT {_KEY}, close, round(sma_20, 4) AS sma_20 FROM history")
oracle("ema", f"SELECT {_KEY}, close, round(ema_20, 6) AS ema_20 FROM history")
oracle("rsi", f"SELECT {_KEY}, close, round(rsi, 6) AS rsi FROM history")
oracle("rsi_bands", f"""SELECT {_KEY}, round(rsi, 6) AS rsi, rsi_signal, coalesce(rsi >= 70, false) AS is_overbought,
 coalesce(rsi <= 30, false) AS is_oversold FROM history""")
_MACD = "macd_line", "macd_signal", "macd_histogram"
_round = lambda names, d: ", ".join(f"round({n}, {d}) AS {n}" for n in names)
_MAS = [f"{k}_{p}" for p in C.MA_PERIODS for k in ("sma", "ema")]
oracle("macd", f"SELECT {_KEY}, close, {_round(_MACD, 6)} FROM history")
oracle("volume_spike", f"SELECT {_KEY}, volume::DOUBLE AS volume, volume_spike AS is_spike FROM history")
oracle("moving_averages", f"SELECT {_KEY}, close, {_round(_MAS, 4)} FROM history")
oracle("rolling_range", f"SELECT {_KEY}, close, high_52w AS range_high, low_52w AS range_low FROM history")
_LINES = ", ".join(f"{_LEVEL[n]} AS {column_name(n)}" for n, _ in C.RETRACEMENTS[1:-1])
cte("level_lines", f"SELECT ticker, {_LINES} FROM usable")
oracle("chart_series", f"""SELECT {_KEY}, open, high, low, close, volume::DOUBLE AS volume,
 {_round(('sma_50', 'sma_200', 'ema_50', 'ema_200'), 6)}, round(rsi, 6) AS rsi, close >= open AS is_up,
 v.* EXCLUDE (ticker) FROM history LEFT JOIN level_lines v USING (ticker)""")

oracle("signal_snapshot", f"""SELECT {_KEY}, price, round(rsi, 6) AS rsi, rsi_signal, {_round(_MACD, 6)}, macd_bullish,
 volume_spike, {_round(_MAS, 6)} FROM priced_close""")
oracle("live_override", "SELECT ticker, price, round(rsi, 6) AS rsi, close, prev_close FROM priced_live")
_PARTS = "rsi_points, sma200_points, macd_points, volume_points, change_points"
oracle("momentum_score", f"SELECT ticker, momentum, momentum_label, {_PARTS} FROM scored_close")
oracle("ma_relation", " UNION ALL ".join(
    f"""SELECT ticker, price, 'sma_{p}' AS ma, round(sma_{p}, 6) AS value,
    CASE WHEN price > sma_{p} THEN 'above' ELSE 'below' END AS relation FROM priced_close WHERE sma_{p} <> 0"""
    for p in (20, 50, 150, 200)))
_WATCH_RULES = (("bounce", "rsi", "rsi < 35 AND rsi <> 0"), ("pullback", "rsi", "rsi > 70"),
                ("near_cross", "macd_histogram", "abs(macd_histogram) < 0.05 AND macd_histogram <> 0"))
oracle("watch_rules", " UNION ALL ".join(
    f"SELECT ticker, '{n}' AS rule, round({v}, 6) AS value FROM sig_1d WHERE {c}" for n, v, c in _WATCH_RULES))
oracle("multi_timeframe", " UNION ALL ".join(
    f"SELECT ticker, timeframe, round(rsi, 6) AS rsi, rsi_signal, macd_bullish FROM sig_{t}"
    for t in ("1d", "1wk", "1mo")))
oracle("resample_bars", " UNION ALL ".join(
    f"SELECT ticker, pts AS ts, timeframe, {_OHLCV} FROM bars_{t}" for t in ("1wk", "1mo")))
oracle("tick_bars", f"SELECT ticker, bar_ts AS ts, timeframe, {_OHLCV} FROM minute_bars")
oracle("bar_change", f"""SELECT {_KEY}, open, close, round(pct, 6) AS pct, {_direction('pct')} AS direction FROM (
 SELECT *, {_pct('close', 'open')} AS pct FROM bars)""")
oracle("day_change", f"""SELECT ticker, round(pct, 6) AS pct, CASE WHEN pct IS NOT NULL THEN {_direction('pct')} END
 AS direction FROM (SELECT ticker, CASE WHEN q.prev_close > 0 THEN {_pct('q.last_price', 'q.prev_close')}
 WHEN t.close_before IS NOT NULL THEN {_pct('t.last_close', 't.close_before')} END AS pct
 FROM two t FULL JOIN latest q USING (ticker))""")
oracle("key_metrics", """SELECT ticker, timeframe, last_price, round(change, 6) AS change,
 round(change / before * 100, 6) AS change_pct, period_high, period_low, avg_volume, data_points FROM (
 SELECT ticker, timeframe, arg_max(close, ts) AS last_price, max(before) AS before,
 arg_max(close, ts) - max(before) AS change, max(high) AS period_high, min(low) AS period_low,
 CAST(floor(sum(volume) / count(*)) AS BIGINT) AS avg_volume, count(*) AS data_points FROM (
 SELECT *, CASE WHEN row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) = 2 THEN close END AS before FROM look_1d)
 GROUP BY ALL)""")
oracle("listing_attrs", """SELECT ticker, CASE WHEN ticker LIKE '%.TA' THEN 'TASE' ELSE 'NYSE' END AS exchange,
 CASE WHEN ticker LIKE '%.TA' THEN 'ILS' ELSE 'USD' END AS currency,
 CASE WHEN ticker LIKE '%.TA' THEN '₪' ELSE '$' END AS currency_symbol FROM symbols""")

oracle("range_52w", "SELECT ticker, timeframe, high_52w, low_52w, current_price, bars_seen FROM ranges")
oracle("trend", """SELECT ticker, timeframe, current_price,
 CASE WHEN current_price > anchor THEN 'UPTREND' ELSE 'DOWNTREND' END AS trend FROM ranges""")
_POSITION = "(current_price - low_52w) / (high_52w - low_52w) * 100"
oracle("fibonacci_levels", f"""SELECT ticker, timeframe, high_52w, low_52w, current_price, trend,
 round({_POSITION}, 6) AS position_pct, {', '.join(f'{v} AS {column_name(n)}' for n, v in _LEVEL.items())},
 {', '.join(f"{v} AS {column_name(n, 'ext')}" for n, v in _EXT.items())} FROM usable""")
oracle("support_resistance", f"SELECT ticker, timeframe, current_price, {_nearest('current_price')} FROM usable")


def _level_rows(kind: str, levels: dict[str, str]) -> str:
    marker = ("CASE WHEN abs(level_price - current_price) / greatest(current_price, 0.001) < 0.015 THEN 'at' "
              "WHEN current_price > level_price THEN 'above' ELSE 'below' END" if kind == "retracement" else "NULL")
    return " UNION ALL ".join(
        f"""SELECT *, {marker} AS marker, CASE WHEN level_price < current_price THEN 'Support' ELSE 'Resistance' END
        AS status FROM (SELECT ticker, timeframe, current_price, '{kind}' AS kind, {i} AS level_pos, '{n}' AS level,
        {v} AS level_price FROM usable)""" for i, (n, v) in enumerate(levels.items()))


oracle("fib_markers", _level_rows("retracement", _LEVEL) + " UNION ALL " + _level_rows("extension", _EXT))

oracle("dual_listing_map", """SELECT s.ticker AS ticker_us, coalesce(d.ticker_tase, s.ticker || '.TA') AS ticker_tase
 FROM symbols s LEFT JOIN dual d ON d.ticker_us = s.ticker""")
cte("rivals", _values([(t, i, n) for t, ns in C.COMPETITORS for i, n in enumerate(ns)], "ticker, rank, competitor"))
oracle("competitors", """SELECT s.ticker, CAST(r.rank AS INT) AS rank, r.competitor
 FROM symbols s LEFT JOIN rivals r USING (ticker)""")

cte("feed_items", f"""SELECT pos // 12 AS feed_id, CAST(pos % 12 AS INT) AS pos,
 trim(regexp_replace(title, '[\\x00-\\x1f\\x7f]', ' ', 'g')) AS title, url,
 regexp_replace(snippet, '[\\x00-\\x1f\\x7f]', ' ', 'g') AS body,
 CASE WHEN pos % 3 <> 0 THEN source ELSE 'Feed' END AS source, published_at FROM articles""")
oracle("rss_articles", f"""SELECT feed_id, pos, title, url,
 substr(regexp_replace(regexp_replace(body, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g'), 1, {C.SNIPPET_CHARS}) AS snippet,
 source, strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT') AS published_raw FROM feed_items
 WHERE pos < {C.FEED_ITEMS} AND title <> ''""")
oracle("search_results", """SELECT ticker, pos AS query_id, 0 AS pos, title, url,
 CASE WHEN articles.pos % 5 <> 0 THEN snippet ELSE '' END AS snippet, source FROM articles""")
_ALLOWED = " OR ".join(f"contains(lower(host), {_str(s)})" for s in ALLOWED_SITES)
oracle("search_queries", " UNION ALL ".join(
    f"SELECT ticker, {i} AS pos, replace({_str(form)}, '{{}}', ticker) AS query FROM symbols"
    for i, form in enumerate(f for forms in C.SEARCH_QUERIES.values() for f in forms)))
oracle("page_extract", f"""SELECT page_id, url, host, ({_ALLOWED}) AS is_allowed,
 CASE WHEN {_ALLOWED} THEN substr(html, 1, {C.PAGE_CHARS}) END AS content,
 CASE WHEN NOT ({_ALLOWED}) THEN 'host not allowed: ' || host END AS error
 FROM (SELECT *, CASE WHEN len(string_split(url, '/')) >= 3 THEN string_split(url, '/')[3] ELSE '' END AS host FROM pages)""")
oracle("tier_fallback", "SELECT ticker, pos, tier FROM best_tier")
oracle("title_dedup", "SELECT ticker, title, pos, source FROM dedup")
oracle("url_dedup", f"""SELECT ticker, url, pos, CAST(row_number() OVER (PARTITION BY ticker ORDER BY pos) AS INT) AS rank
 FROM (SELECT ticker, 'http://' || source || '/' || (pos // 100) AS url, min(pos) AS pos FROM articles GROUP BY ALL)
 QUALIFY rank <= {C.SEARCH_RESULTS}""")
oracle("feed_merge", """SELECT ticker, title, source, feed_rank, pos FROM (SELECT * FROM ranked WHERE title <> ''
 QUALIFY row_number() OVER (PARTITION BY ticker, title ORDER BY feed_rank, pos) = 1)
 QUALIFY row_number() OVER (PARTITION BY ticker, source ORDER BY feed_rank, pos) <= 2""")
oracle("feed_merge_greedy", """SELECT m.ticker, CAST(row_number() OVER (PARTITION BY m.ticker ORDER BY m.i) - 1 AS INT) AS rank,
 CAST(m.feed_rank AS INT) AS feed_rank, m.pos, m.title, m.source
 FROM merge_fold f JOIN merge_items m ON m.ticker = f.ticker AND m.i = f.i WHERE f.picked""")
oracle("headline_score", "SELECT ticker, pos, positive_hits, negative_hits, round(score, 6) AS score FROM scored")
_AGE = f"(epoch(TIMESTAMP '{NEWS_AS_OF}') - epoch(published_at))"
oracle("fresh_news", f"""SELECT ticker, pos, title, published_at, is_fresh, CASE WHEN {_AGE} < 60 THEN 'just now'
 WHEN {_AGE} < 3600 THEN CAST(floor({_AGE} / 60) AS BIGINT) || 'm ago'
 WHEN {_AGE} < 86400 THEN CAST(floor({_AGE} / 3600) AS BIGINT) || 'h ago'
 ELSE CAST(floor({_AGE} / 86400) AS BIGINT) || 'd ago' END AS age FROM fresh""")
oracle("top_headlines", f"""SELECT ticker, CAST(rank AS INT) AS rank, title, substr(snippet, 1, {C.HEADLINE_SNIPPET_CHARS})
 AS snippet, url, source, published_at FROM top5""")
oracle("first_headlines", """SELECT ticker, CAST(row_number() OVER (PARTITION BY ticker ORDER BY pos) AS INT) AS rank, title
 FROM dedup QUALIFY rank <= 5""")
oracle("earnings_headlines", f"""SELECT ticker, CAST(rank AS INT) AS rank,
 CAST(row_number() OVER (PARTITION BY ticker ORDER BY rank) AS INT) AS place, title FROM top5
 WHERE {_hits(EARNINGS_WORDS, 'title')} > 0""")
oracle("high_impact_news", f"SELECT ticker, pos, title, ({_hits(IMPACT_WORDS, 'title')}) > 0 AS is_high_impact FROM articles")
oracle("sentiment_report", "SELECT * FROM sentiment")
oracle("sentiment_sources", f"SELECT ticker, {_HOST} AS host, count(*) AS articles FROM dedup GROUP BY ALL")
oracle("sentiment_bands", """SELECT ticker, score, band, repeat('▓', n) || repeat('░', 10 - n) AS bar FROM (
 SELECT *, CAST(greatest(0, least(10, round_even((score + 1) / 2 * 10, 0))) AS INT) AS n FROM sentiment)""")

oracle("company_profile", "SELECT * FROM profile")
oracle("company_rejects", "SELECT ticker, fact_id, 'no fundamentals' AS reason FROM typed_facts WHERE is_empty")
oracle("display_texts", """SELECT fact_id, CASE WHEN market_cap IS NULL THEN 'N/A'
 WHEN market_cap >= 1000000000 THEN '$' || format('{:.1f}', market_cap / 1e9) || 'B'
 WHEN market_cap >= 1000000 THEN '$' || format('{:.0f}', market_cap / 1e6) || 'M'
 ELSE '$' || format('{:,}', market_cap) END AS market_cap_text FROM profile""")
oracle("quarter_facts", "SELECT * FROM quarters")
oracle("earnings_surprise", "SELECT * EXCLUDE (reported_at) FROM earnings")
oracle("reporting_today", f"""SELECT ticker, announcement_id, eps_estimate, revenue_estimate FROM calendar
 WHERE d1 = DATE '{TODAY}' OR d2 = DATE '{TODAY}'""")
oracle("reported_today", f"""SELECT ticker, fact_id, reported_at FROM typed_facts
 WHERE CAST(reported_at AS DATE) = DATE '{TODAY}'""")
_FILING = """ticker, insider_name, insider_title, transaction_date, transaction_type, shares,
 CASE WHEN shares > 0 THEN round(total_value / shares, 4) END AS price_per_share, total_value, filing_url"""
cte("recent_filings", """SELECT *, CAST(row_number() OVER (PARTITION BY ticker
 ORDER BY transaction_date DESC NULLS LAST, filing_id) AS INT) AS rank FROM filings QUALIFY rank <= 10""")
oracle("insider_recent", f"SELECT rank, {_FILING} FROM recent_filings WHERE transaction_date IS NOT NULL")
oracle("insider_insert_new", """SELECT ticker, insider_name, transaction_date, shares, min(filing_id) AS filing_id
 FROM filings f WHERE transaction_date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM filings s
 WHERE s.transaction_date < TIMESTAMP '1998-07-01' AND s.ticker = f.ticker AND s.insider_name = f.insider_name
 AND s.transaction_date = f.transaction_date AND s.shares = f.shares) GROUP BY ALL""")

oracle("alert_validate", "SELECT request_id, chat_id, ticker, threshold, reason FROM checked")
oracle("alert_set", """SELECT id, chat_id, ticker, alert_type, threshold, is_active AND NOT EXISTS (
 SELECT 1 FROM good_requests r JOIN close_price p ON p.ticker = r.ticker
 WHERE r.chat_id = a.chat_id AND r.ticker = a.ticker) AS is_active FROM user_alerts a UNION ALL
 SELECT request_id, chat_id, ticker, CASE WHEN threshold > price THEN 'PRICE_ABOVE' ELSE 'PRICE_BELOW' END, threshold, true
 FROM good_requests r JOIN close_price p USING (ticker)
 QUALIFY row_number() OVER (PARTITION BY chat_id, ticker ORDER BY request_id DESC) = 1""")
oracle("alert_cancel", """SELECT id, chat_id, ticker, alert_type, threshold, is_active AND NOT EXISTS (
 SELECT 1 FROM good_requests r WHERE r.chat_id = a.chat_id AND r.ticker = a.ticker) AS is_active FROM user_alerts a""")
oracle("alert_cancel_missing", """SELECT DISTINCT chat_id, ticker FROM good_requests r WHERE NOT EXISTS (
 SELECT 1 FROM user_alerts a WHERE a.is_active AND a.chat_id = r.chat_id AND a.ticker = r.ticker)""")
oracle("alert_triggers", "SELECT * FROM fired")
oracle("alert_fired", f"""SELECT a.id, a.is_active AND f.id IS NULL AS is_active,
 CASE WHEN f.id IS NOT NULL THEN TIMESTAMP '{NEWS_AS_OF}' END AS triggered_at
 FROM user_alerts a LEFT JOIN fired f USING (id)""")

# Events are from January 2024: New York is UTC-5 and Jerusalem UTC+2 throughout.
cte("clock", """SELECT event_id, ts, ts - INTERVAL 5 HOUR AS ny, ts + INTERVAL 2 HOUR AS il FROM events""")
_T = lambda c: f"CAST({c} AS TIME)"
_NYSE = f"(isodow(ny) <= 5 AND {_T('ny')} >= TIME '09:30:00' AND {_T('ny')} <= TIME '16:00:00')"
_TASE = (f"(isodow(il) <= 5 AND {_T('il')} >= TIME '10:00:00' AND {_T('il')} <= "
         "CASE WHEN isodow(il) = 5 THEN TIME '15:45:00' ELSE TIME '17:25:00' END)")
_PRE = f"(isodow(il) <= 5 AND {_T('il')} >= TIME '09:45:00' AND {_T('il')} < TIME '10:00:00')"
_LABELS = " ".join(f"WHEN score >= {floor} THEN {_str(name)}" for floor, name in C.MOMENTUM_LABELS)
oracle("sql_functions", f"""SELECT event_id, ts, {_NYSE} AS is_open, CASE {_LABELS} ELSE {_str(C.MOMENTUM_LOWEST)} END AS label,
 (score - 20) / 60::DOUBLE * 100 AS position FROM (SELECT *, event_id * 7 % 101 AS score FROM clock)""")
oracle("is_nyse_open", f"SELECT event_id, ts, {_NYSE} AS is_open FROM clock")
oracle("is_tase_open", f"SELECT event_id, ts, {_TASE} AS is_open FROM clock")
oracle("market_status", f"""SELECT event_id, ts, {_NYSE} AS nyse_open, {_TASE} AS tase_open, {_PRE} AS tase_preopen,
 isodow(il) = 5 AS tase_friday, strftime(ny, '%Y-%m-%d %H:%M:%S') || ' EST' AS us_time,
 strftime(il, '%Y-%m-%d %H:%M:%S') || ' IST' AS tase_time FROM clock""")
oracle("session_label", f"""SELECT event_id, ts, CASE WHEN {_NYSE} THEN '' WHEN {_T('ny')} < TIME '09:30:00' THEN 'pre-market'
 WHEN {_T('ny')} >= TIME '16:00:00' THEN 'after-hours' ELSE '' END AS label FROM clock""")
oracle("time_to_open", f"""SELECT event_id, ts, CASE WHEN {_NYSE} THEN 'Open - closes at 4:00 PM ET'
 WHEN isodow(ny) <= 5 AND {_T('ny')} < TIME '09:30:00' THEN CASE WHEN m >= 60 THEN 'Opens in ' || (m // 60) || 'h ' ||
 (m % 60) || 'm (9:30 AM ET)' ELSE 'Opens in ' || m || 'm (9:30 AM ET)' END
 WHEN isodow(ny) >= 5 THEN 'Closed - reopens Monday 9:30 AM ET'
 ELSE 'Closed - reopens tomorrow at 9:30 AM ET' END AS countdown FROM (
 SELECT *, CAST(floor((epoch_us(date_trunc('day', ny) + INTERVAL 570 MINUTE) - epoch_us(ny)) / 60000000) AS BIGINT) AS m FROM clock)""")

oracle("market_snapshot", "SELECT pos, ticker, label, market_group, price, round(pct, 6) AS pct, direction FROM snap")
oracle("market_groups", f"""SELECT s.ticker, coalesce(g.market_group, '{C.DEFAULT_GROUP}') AS market_group
 FROM symbols s LEFT JOIN snapshot_symbols g USING (ticker)""")
oracle("sector_rotation", "SELECT * FROM sector")
oracle("sector_breadth", """SELECT count(*) FILTER (pct_change >= 0) AS advancing,
 count(*) FILTER (pct_change < 0) AS declining FROM sector""")
_VIX = "CASE WHEN vix < 15 THEN 'Low Fear' WHEN vix < 25 THEN 'Moderate' WHEN vix < 35 THEN 'Elevated' ELSE 'Extreme Fear' END"
cte("vix_last", """SELECT ticker, timeframe, ts, close AS vix FROM bars WHERE ticker = '^VIX' ORDER BY ts DESC LIMIT 1""")
oracle("vix_mood", f"SELECT *, {_VIX} AS mood FROM vix_last")
_BEST = "SELECT watch_ticker, pct FROM watched WHERE pct <> 0 ORDER BY pct DESC, pos LIMIT 1"
_WORST = "SELECT watch_ticker, pct FROM watched WHERE pct <> 0 ORDER BY pct, pos LIMIT 1"
_STRONGEST = """SELECT watch_ticker AS ticker, momentum, momentum_label FROM watched WHERE price IS NOT NULL
 ORDER BY momentum DESC, pos LIMIT 1"""
oracle("best_worst", f"""SELECT (SELECT watch_ticker FROM ({_BEST})) AS best, round((SELECT pct FROM ({_BEST})), 6) AS best_pct,
 (SELECT watch_ticker FROM ({_WORST})) AS worst, round((SELECT pct FROM ({_WORST})), 6) AS worst_pct""")
oracle("best_momentum", _STRONGEST)
_OVER, _UNDER = "count(*) FILTER (rsi > 70)", "count(*) FILTER (rsi < 30 AND rsi <> 0)"
oracle("rsi_summary", f"""SELECT {_OVER} AS overbought, {_UNDER} AS oversold, count(*) - {_OVER} - {_UNDER} AS neutral
 FROM watched""")
cte("newest_profile", """SELECT p.* FROM profile p JOIN newest_facts f USING (ticker, fact_id)""")
_COMPARED = ("price", "rsi", "macd_histogram", "momentum", "pe_trailing", "eps_trailing", "market_cap")
cte("pair_values", " UNION ALL ".join(
    f"SELECT s.ticker, {i} AS pos, '{m}' AS metric, {m}::DOUBLE AS value FROM scored_pair s "
    "LEFT JOIN newest_profile p ON p.ticker = s.ticker WHERE s.ticker IN ('AAPL', 'MSFT')"
    for i, m in enumerate(_COMPARED)))
oracle("compare_pair", """SELECT pos, metric, round(max(CASE WHEN ticker = 'AAPL' THEN value END), 6) AS first,
 round(max(CASE WHEN ticker = 'MSFT' THEN value END), 6) AS second FROM pair_values GROUP BY ALL""")

cte("earnings_due", f"""SELECT w.pos, w.ticker, e.quarter, e.eps_surprise_pct FROM watch w JOIN newest_facts f USING (ticker)
 JOIN earnings e USING (ticker) WHERE CAST(f.reported_at AS DATE) = DATE '{TODAY}'""")


def _rows(section: str, source: str, pos: str, ticker: str, label: str, value: str, where: str = "true") -> str:
    return (f"SELECT '{section}' AS section, CAST({pos} AS INT) AS pos, CAST({ticker} AS VARCHAR) AS ticker, "
            f"CAST({label} AS VARCHAR) AS label, CAST({value} AS DOUBLE) AS value FROM {source} WHERE {where}")


def _report(digits: int, *parts: str) -> str:
    return f"SELECT section, pos, ticker, label, round(value, {digits}) AS value FROM ({' UNION ALL '.join(parts)})"


_MARKET = (_rows("snapshot", "snap", "pos", "ticker", "market_group", "pct"),
           _rows("sectors", "sector", "pos", "ticker", "band", "pct_change"))
_EARNED = _rows("earnings", "earnings_due", "pos", "ticker", "quarter", "eps_surprise_pct")


def _own(source: str) -> tuple[str, str]:
    return (_rows("change", source, "pos", "watch_ticker", "direction", "pct"),
            _rows("rsi", source, "pos", "watch_ticker", "rsi_signal", "rsi"))


oracle("close_report", _report(
    4, *_own("watched"),
    *[_rows("watch", "watched", "pos", "watch_ticker", _str(n), v, c) for n, v, c in _WATCH_RULES],
    _rows("best", f"({_BEST})", "0", "watch_ticker", "'best'", "pct"),
    _rows("worst", f"({_WORST})", "0", "watch_ticker", "'worst'", "pct"),
    _rows("momentum", f"({_STRONGEST})", "0", "ticker", "momentum_label", "momentum"),
    *[_rows("rsi_summary", f"(SELECT {e} AS n FROM watched)", str(i), "NULL", _str(n), "n")
      for i, (n, e) in enumerate((("overbought", _OVER), ("oversold", _UNDER),
                                  ("neutral", f"count(*) - {_OVER} - {_UNDER}")))],
    _rows("sentiment", "(SELECT w.pos, s.* FROM watch w JOIN sentiment s USING (ticker))", "pos", "ticker", "band", "score"),
    _EARNED, *_MARKET))
oracle("open_report", _report(
    3, *_own("watched"),
    _rows("macd", "watched", "pos", "watch_ticker", "CASE WHEN macd_bullish THEN 'bullish' ELSE 'bearish' END", "macd_histogram"),
    _EARNED, *_MARKET))
cte("due", f"""SELECT w.pos, w.ticker, c.eps_estimate, c.revenue_estimate FROM preview_watch w
 JOIN newest_calendar c USING (ticker) WHERE d1 = DATE '{TODAY}' OR d2 = DATE '{TODAY}'""")
oracle("preopen_report", _report(
    4, *_own("previewed"),
    _rows("headline", "(SELECT w.pos, t.ticker, t.title, t.source FROM preview_watch w JOIN top_best t USING (ticker) WHERE t.rank = 1)",
          "pos", "ticker", "title || ' | ' || source", "NULL"),
    _rows("due", "due", "pos", "ticker", "'eps'", "eps_estimate"),
    _rows("due", "due", "pos", "ticker", "'revenue'", "revenue_estimate"),
    _rows("mood", "(SELECT * FROM previewed WHERE watch_ticker = 'SPY' AND pct IS NOT NULL)", "0", "watch_ticker", "direction", "pct"),
    _rows("mood", "vix_last", "1", "ticker", _VIX, "vix"), *_MARKET))

_RANGED = "bars_seen >= 2 AND high_52w > low_52w"
cte("levelled", f"""SELECT *, CASE WHEN {_RANGED} THEN s END AS nearest_support, CASE WHEN {_RANGED} THEN r END AS nearest_resistance
 FROM (SELECT *, coalesce(list_max([v FOR v IN {_LEVEL_LIST} IF v < close]), low_52w) AS s,
 coalesce(list_min([v FOR v IN {_LEVEL_LIST} IF v > close]), high_52w) AS r FROM scored_live)""")
cte("filing_counts", """SELECT ticker, count(*) FILTER (transaction_type = 'BUY') AS insider_buys,
 count(*) FILTER (transaction_type = 'SELL') AS insider_sells FROM recent_filings
 WHERE transaction_date IS NOT NULL GROUP BY ticker""")
oracle("analyze", f"""SELECT s.ticker, s.timeframe, s.ts, s.open, s.high, s.low, s.close, s.volume::DOUBLE AS volume, s.volume_spike,
 {_round([f's.{n}' for n in _MAS], 6).replace('AS s.', 'AS ')}, {_round([f's.{n}' for n in _MACD], 6).replace('AS s.', 'AS ')},
 round(s.rsi, 6) AS rsi, s.close_before, s.high_52w, s.low_52w, s.bars_seen, s.trend, s.rsi_signal, s.macd_bullish, s.price,
 s.prev_close, s.rsi_points, s.sma200_points, s.macd_points, s.volume_points, s.change_points, s.momentum, s.momentum_label,
 s.nearest_support, s.nearest_resistance,
 CASE WHEN s.bars_seen >= 2 AND s.high_52w > s.low_52w THEN round((s.price - s.low_52w) / (s.high_52w - s.low_52w) * 100, 6) END AS position_pct,
 round(CASE WHEN s.prev_close > 0 THEN {_pct('s.price', 's.prev_close')} WHEN s.close_before IS NOT NULL
 THEN {_pct('s.close', 's.close_before')} END, 6) AS day_pct,
 round(wk.rsi, 6) AS weekly_rsi, wk.rsi_signal AS weekly_rsi_signal, wk.macd_bullish AS weekly_macd_bullish,
 round(mo.rsi, 6) AS monthly_rsi, mo.rsi_signal AS monthly_rsi_signal, mo.macd_bullish AS monthly_macd_bullish,
 p.name, p.sector, p.exchange, p.market_cap, p.pe_trailing, e.quarter, e.eps_actual, e.eps_surprise_pct, e.beat_eps,
 e.revenue_surprise_pct, e.beat_revenue, f.insider_buys, f.insider_sells, n.score AS sentiment, n.headline_count, n.band,
 t.title AS top_headline FROM levelled s LEFT JOIN sig_1wk wk ON wk.ticker = s.ticker LEFT JOIN sig_1mo mo ON mo.ticker = s.ticker
 LEFT JOIN newest_profile p ON p.ticker = s.ticker LEFT JOIN earnings e ON e.ticker = s.ticker
 LEFT JOIN filing_counts f ON f.ticker = s.ticker LEFT JOIN sentiment n ON n.ticker = s.ticker
 LEFT JOIN (SELECT * FROM top_best WHERE rank = 1) t ON t.ticker = s.ticker""")

# A minute is final once the newest event is ten minutes past its end.
oracle("stream_bars", f"""SELECT ticker, bar_ts AS ts, timeframe, {_OHLCV} FROM minute_bars
 WHERE bar_ts + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 10 MINUTE""")
oracle("stream_fresh", f"""SELECT ticker, period_ts, arg_min(ts, (ts, event_id)) AS ts, arg_min(price, (ts, event_id)) AS price
 FROM (SELECT *, time_bucket(INTERVAL {C.TTL_SECONDS["quote"]} SECOND, ts) AS period_ts FROM ticks)
 WHERE period_ts + INTERVAL {C.TTL_SECONDS["quote"]} SECOND
 <= (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
cte("fired", f"""SELECT a.id, arg_min(price, (t.ts, price)) AS price,
 min(t.ts) AS fired_at FROM user_alerts a
 JOIN ticks t ON t.ticker = a.ticker JOIN clock c ON c.event_id = t.event_id WHERE is_active AND {_NYSE.replace('ny', 'c.ny')}
 AND ((alert_type = 'PRICE_ABOVE' AND price >= threshold) OR (alert_type = 'PRICE_BELOW' AND price <= threshold)) GROUP BY a.id""")
oracle("stream_alerts", """SELECT a.id, chat_id, ticker, alert_type, threshold, price, fired_at
 FROM user_alerts a JOIN fired f USING (id)""")
oracle("stream_alert_table", """SELECT a.id, chat_id, ticker, alert_type, threshold, is_active AND fired_at IS NULL AS is_active,
 fired_at AS triggered_at FROM user_alerts a LEFT JOIN fired f USING (id)""")
oracle("bar_rejects", f"""SELECT ticker, reason, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts FROM (
 SELECT CASE WHEN o_custkey % 50 <> 0 THEN {sym('o_custkey')} END AS ticker, o_orderdate::TIMESTAMP AS ts,
 CASE WHEN o_custkey % 50 = 0 THEN 'no key' WHEN o_orderstatus = 'P' THEN 'no close'
 WHEN o_orderpriority = '5-LOW' THEN 'incomplete' END AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY ALL""")
_number = lambda c: f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE printf('%.2f', round({c}, 2)) END"
cte("shown", f"""SELECT ticker, {_number('pe_trailing')} AS pe_text, {_number('eps_trailing')} AS eps_text,
 CASE WHEN dividend_yield IS NULL THEN 'N/A' ELSE printf('%.2f%%', round(dividend_yield * 100, 2)) END AS yield_text,
 CASE WHEN market_cap IS NULL THEN 'N/A' WHEN market_cap >= 1000000000 THEN printf('$%.1fB', round(market_cap / 1e9, 1))
 WHEN market_cap >= 1000000 THEN printf('$%.0fM', round(market_cap / 1e6, 0)) ELSE '$' || format('{{:,}}', market_cap::BIGINT) END AS cap_text,
 CASE WHEN length(name) > 8 THEN substr(name, 1, 8) || '...' ELSE name END AS short_name FROM newest_profile""")
oracle("company_texts", """SELECT *, to_json({ticker: ticker, pe_text: pe_text, eps_text: eps_text, yield_text: yield_text,
 cap_text: cap_text, short_name: short_name})::VARCHAR AS json FROM shown""")

# A day is final once the newest event is a day past its end; the stored bars end years earlier.
cte("open_ticks", f"SELECT t.* FROM ticks t JOIN clock c USING (event_id) WHERE {_NYSE} OR {_TASE}")
cte("look_stream", """SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts) - 1 AS rn FROM (
 SELECT ticker, date_trunc('day', ts)::TIMESTAMP AS ts, '1d' AS timeframe, arg_min(price, ts) AS open, max(price) AS high,
 min(price) AS low, arg_max(price, ts) AS close, CAST(sum(k) AS BIGINT) AS volume FROM open_ticks GROUP BY ALL)
 WHERE ts + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) FROM open_ticks) - INTERVAL 1 DAY""", True)
_recursion("ind_stream", "look_stream")
oracle("stream_signals", """SELECT ticker, ts, round(close, 6) AS price, round(rsi, 6) AS rsi, rsi_signal
 FROM ind_stream WHERE is_last""")
