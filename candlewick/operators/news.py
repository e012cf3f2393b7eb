"""Articles: parsing, de-duplication, scoring and the sentiment report.

Any ticker, title or source may hold a large share of all articles. Steps that
keep one row per group are aggregations, which combine before the shuffle, and
top-k steps keep k rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from candlewick import constants as C
from candlewick.functions import scores, text
from candlewick.sources.schemas import RSS, SEARCH_RESPONSE


def _first_per(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the smallest ``order`` of each group."""
    fields = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("_row")).select(
        *keys, "_row.*"
    )


def rss_articles(feeds: DataFrame, max_items: int = C.FEED_ITEMS) -> DataFrame:
    """Article rows of RSS texts: the first ``max_items`` of each feed that have a title.

    A text that is not XML gives no rows.
    """
    items = F.slice(F.from_xml("xml", RSS)["channel"]["item"], 1, max_items)
    keep = [c for c in feeds.columns if c != "xml"]
    named = text.trimmed(F.col("item.source._VALUE"))
    has_name = F.coalesce(F.length(named) > 0, F.lit(False))
    raw_title = F.coalesce("item.title", F.lit(""))
    return (
        feeds.select(*keep, F.posexplode(items).alias("pos", "item"))
        .select(
            *[c for c in keep if c != "fallback_source"], "pos",
            F.when(has_name, text.strip_publisher(raw_title, named))
            .otherwise(text.trimmed(raw_title)).alias("title"),
            text.trimmed(F.coalesce("item.link", F.lit(""))).alias("url"),
            F.substring(
                text.strip_html(F.coalesce("item.description", F.lit(""))), 1, C.SNIPPET_CHARS
            ).alias("snippet"),
            F.when(has_name, named).otherwise(F.col("fallback_source")).alias("source"),
            F.coalesce("item.pubDate", F.lit("")).alias("published_raw"),
        )
        .where(F.col("title") != "")
    )


def search_results(responses: DataFrame) -> DataFrame:
    """Article rows of search answers; missing fields become empty text."""
    keep = [c for c in responses.columns if c != "body"]
    items = F.from_json("body", SEARCH_RESPONSE)["items"]
    or_empty = lambda name: F.coalesce(F.col(f"item.{name}"), F.lit(""))
    return responses.select(*keep, F.posexplode(items).alias("pos", "item")).select(
        *keep, "pos",
        or_empty("title").alias("title"),
        or_empty("link").alias("url"),
        or_empty("snippet").alias("snippet"),
        or_empty("displayLink").alias("source"),
    )


def search_queries(
    tickers: DataFrame, language: str = "both", site: str | None = None
) -> DataFrame:
    """Search texts per ticker, two for each language, optionally limited to a site."""
    languages = ("en", "he") if language == "both" else (language,)
    prefix = f"site:{site} " if site else ""
    texts = [
        F.concat(F.lit(prefix), F.replace(F.lit(form), F.lit("{}"), F.col("ticker")))
        for code in languages for form in C.SEARCH_QUERIES[code]
    ]
    return tickers.select("ticker", F.posexplode(F.array(*texts)).alias("pos", "query"))


def page_extract(
    pages: DataFrame, sites: Sequence[str] = C.FINANCIAL_SITES, size: int = C.PAGE_CHARS
) -> DataFrame:
    """Page text of allowed hosts; other pages keep only the reason they were refused.

    The size of the extract is part of the result's contract.
    """
    site = text.page_host(F.col("url"))
    allowed = text.contains_any(F.col("host"), sites)
    return (
        pages.withColumn("host", site)
        .withColumn("is_allowed", allowed)
        .select(
            "page_id", "url", "host", "is_allowed",
            F.when(F.col("is_allowed"), F.substring("html", 1, size)).alias("content"),
            F.when(~F.col("is_allowed"), F.concat(F.lit("host not allowed: "), "host")).alias("error"),
        )
    )


def tier_fallback(articles: DataFrame) -> DataFrame:
    """Articles of the best source tier that has any, per ticker.

    The join with one row per ticker may shuffle the articles, so cut or score
    long texts first; adaptive execution splits a ticker that holds most of them.
    """
    best = articles.groupBy("ticker").agg(F.min("tier").alias("_best"))
    return articles.join(best, "ticker").where(F.col("tier") == F.col("_best")).drop("_best")


def title_dedup(articles: DataFrame) -> DataFrame:
    """First article of every title per ticker; empty titles are dropped.

    All columns travel with the title, so select (or score) first and leave
    long texts behind.
    """
    return _first_per(articles.where(F.col("title") != ""), ["ticker", "title"], F.col("pos"))


def url_dedup(results: DataFrame, keep: int = C.SEARCH_RESULTS) -> DataFrame:
    """First result of every URL, then the first ``keep`` per ticker."""
    first = _first_per(results.where(F.col("url") != ""), ["ticker", "url"], F.col("pos"))
    rank = F.row_number().over(W.partitionBy("ticker").orderBy("pos"))
    return first.withColumn("rank", rank).where(F.col("rank") <= keep)


def feed_merge(articles: DataFrame, per_source: int = C.MAX_PER_SOURCE) -> DataFrame:
    """First article of every title, then the first ``per_source`` of each source."""
    order = [c for c in ("feed_rank", "pos") if c in articles.columns]
    first = _first_per(
        articles.where(F.col("title") != ""), ["ticker", "title"], F.struct(*order)
    )
    rank = F.row_number().over(W.partitionBy("ticker", "source").orderBy(*order))
    return first.withColumn("_rank", rank).where(F.col("_rank") <= per_source).drop("_rank")


def first_items(articles: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """The first ``sizes[r]`` articles of the feed with rank ``r``, per ticker."""
    rank = F.row_number().over(W.partitionBy("ticker", "feed_rank").orderBy("pos"))
    allowed = F.lit(0)
    for i, size in enumerate(sizes):
        allowed = F.when(F.col("feed_rank") == i, size).otherwise(allowed)
    return (
        articles.withColumn("_rank", rank).where(F.col("_rank") <= max(sizes))
        .where(F.col("_rank") <= allowed).drop("_rank")
    )


def feed_merge_greedy(
    articles: DataFrame,
    sizes: Sequence[int] = (C.FIRST_FEED_ITEMS, C.SECOND_FEED_ITEMS),
    per_source: int = C.MAX_PER_SOURCE,
) -> DataFrame:
    """Order-dependent merge: a title is taken only by an accepted article.

    An article whose source is full leaves its title open for a later one from
    another source. The fold sees at most ``sum(sizes)`` articles per ticker.
    """
    items = first_items(articles, sizes).where(F.col("title") != "")
    item = F.struct("feed_rank", "pos", "title", "source")
    ordered = F.array_sort(F.collect_list(item))
    item_type = "STRUCT<feed_rank: INT, pos: BIGINT, title: STRING, source: STRING>"

    def accept(taken: Column, candidate: Column) -> Column:
        same_title = F.exists(taken, lambda t: t["title"] == candidate["title"])
        same_source = F.size(F.filter(taken, lambda t: t["source"] == candidate["source"]))
        return F.when(
            ~same_title & (same_source < per_source), F.concat(taken, F.array(candidate))
        ).otherwise(taken)

    nothing = F.array().cast(f"ARRAY<{item_type}>")
    lists = items.withColumn("feed_rank", F.col("feed_rank").cast("int")).groupBy("ticker").agg(
        ordered.cast(f"ARRAY<{item_type}>").alias("_items")
    )
    return lists.select(
        "ticker", F.posexplode(F.aggregate("_items", nothing, accept)).alias("rank", "_item")
    ).select("ticker", "rank", "_item.*")


def with_score(
    articles: DataFrame,
    positive: Sequence[str] = C.POSITIVE_WORDS,
    negative: Sequence[str] = C.NEGATIVE_WORDS,
) -> DataFrame:
    """Matched words and score in [-1, 1] over title and snippet; 0 without a match."""
    body = F.concat_ws(" ", "title", "snippet")
    good, bad = F.col("positive_hits"), F.col("negative_hits")
    return (
        articles.withColumn("positive_hits", text.match_count(body, positive))
        .withColumn("negative_hits", text.match_count(body, negative))
        .withColumn(
            "score", F.when(good + bad > 0, (good - bad) / (good + bad)).otherwise(F.lit(0.0))
        )
    )


def with_published(articles: DataFrame) -> DataFrame:
    return articles.withColumn("published_at", text.rfc_2822_time(F.col("published_raw")))


def _is_fresh(as_of: Column, seconds: int) -> Column:
    """Undated articles count as published at the epoch."""
    age = F.unix_seconds(as_of) - F.coalesce(F.unix_seconds("published_at"), F.lit(0))
    return age <= seconds


def fresh_news(
    articles: DataFrame, as_of: Column, seconds: int = C.FRESH_SECONDS
) -> DataFrame:
    """Articles at most ``seconds`` old; all articles of a ticker that has no fresh one."""
    marked = articles.withColumn("is_fresh", _is_fresh(as_of, seconds))
    any_fresh = marked.groupBy("ticker").agg(F.max("is_fresh").alias("_any_fresh"))
    return (
        marked.join(any_fresh, "ticker")
        .where(F.col("is_fresh") | ~F.col("_any_fresh")).drop("_any_fresh")
    )


def _newest_first() -> list[Column]:
    when = F.coalesce(F.unix_micros("published_at"), F.lit(0))
    return [F.desc(when), F.asc("pos")]


def top_headlines(
    articles: DataFrame, k: int = C.TOP_HEADLINES, as_of: Column | None = None
) -> DataFrame:
    """Newest ``k`` articles per ticker, at most one of each source.

    With ``as_of`` only fresh ones, unless a ticker has none. Fresh articles are
    the newest ones, so that rule gives the same rows on the at most ``k`` per ticker that
    are left, and needs no join with all articles as :func:`fresh_news` does.
    """
    when = F.coalesce(F.unix_micros("published_at"), F.lit(0))
    one = _first_per(articles, ["ticker", "source"], F.struct(-when, F.col("pos")))
    rank = F.row_number().over(W.partitionBy("ticker").orderBy(*_newest_first()))
    top = one.withColumn("rank", rank).where(F.col("rank") <= k)
    if as_of is not None:
        fresh = _is_fresh(as_of, C.FRESH_SECONDS)
        any_fresh = F.max(fresh).over(W.partitionBy("ticker"))
        top = top.withColumn("_keep", fresh | ~any_fresh).where("_keep")
    return top.select(
        "ticker", "rank", "title",
        F.substring("snippet", 1, C.HEADLINE_SNIPPET_CHARS).alias("snippet"),
        "url", "source", "published_at",
    )


def report_articles(articles: DataFrame) -> DataFrame:
    """De-duplicated articles with what headline lists show; snippets are already cut to size.

    Where articles have a ``tier``, only the best one of a ticker counts.
    """
    shown = F.substring("snippet", 1, C.HEADLINE_SNIPPET_CHARS)
    tier = [c for c in ("tier",) if c in articles.columns]
    score = [c for c in ("score",) if c in articles.columns]
    rows = articles.select(
        "ticker", "title", "pos", shown.alias("snippet"), "url", "source", "published_raw",
        *tier, *score,
    )
    rows = tier_fallback(rows).drop("tier") if tier else rows
    return with_published(title_dedup(rows))


def first_headlines(articles: DataFrame, k: int = C.TOP_HEADLINES) -> DataFrame:
    """First ``k`` titles per ticker in arrival order."""
    rank = F.row_number().over(W.partitionBy("ticker").orderBy("pos"))
    return articles.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "ticker", "rank", "title"
    )


def earnings_headlines(headlines: DataFrame, words: Sequence[str] = C.EARNINGS_WORDS) -> DataFrame:
    """Headlines that mention results, in rank order, at most five per ticker."""
    hits = headlines.where(text.contains_any(F.col("title"), words))
    place = F.row_number().over(W.partitionBy("ticker").orderBy("rank"))
    return hits.withColumn("place", place).where(F.col("place") <= C.TOP_HEADLINES)


def high_impact(articles: DataFrame, words: Sequence[str] = C.HIGH_IMPACT_WORDS) -> DataFrame:
    return articles.withColumn("is_high_impact", text.contains_any(F.col("title"), words))


def sentiment_sources(scored: DataFrame) -> DataFrame:
    """Hosts behind each ticker's articles; the long form of the report's source list."""
    site = text.host(F.col("url"))
    return scored.groupBy("ticker", site.alias("host")).agg(F.count(F.lit(1)).alias("articles"))


def sentiment_totals(scored: DataFrame) -> DataFrame:
    """Sums and counts per ticker over scored articles.

    Articles are first folded per ticker and host, then per ticker, so that
    distinct hosts need no set per group.
    """
    count_if = lambda c: F.sum(c.cast("bigint"))
    per_host = scored.groupBy("ticker", text.host(F.col("url")).alias("_host")).agg(
        F.sum("score").alias("_score"), F.count(F.lit(1)).alias("_n"),
        count_if(F.col("score") > 0).alias("_pos"), count_if(F.col("score") < 0).alias("_neg"),
    )
    return per_host.groupBy("ticker").agg(
        F.sum("_score").alias("_score"), F.sum("_n").alias("_n"), F.sum("_pos").alias("_pos"),
        F.sum("_neg").alias("_neg"), F.count("_host").alias("_hosts"),
    )


def with_sentiment(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Report columns next to one row per ticker; a ticker without articles scores 0."""
    or_zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    n, pos, neg = or_zero("_n"), or_zero("_pos"), or_zero("_neg")
    summary = F.when(
        n > 0,
        F.concat(
            "ticker", F.lit(" sentiment: "), pos.cast("string"), F.lit(" positive, "),
            neg.cast("string"), F.lit(" negative, "), (n - pos - neg).cast("string"),
            F.lit(" neutral across "), n.cast("string"), F.lit(" articles."),
        ),
    ).otherwise("No news found.")
    return (
        rows.join(totals, "ticker", "left")
        .select(
            *rows.columns,
            F.coalesce(F.round(F.col("_score") / F.col("_n"), 4), F.lit(0.0)).alias("score"),
            n.alias("headline_count"), pos.alias("positive_count"), neg.alias("negative_count"),
            (n - pos - neg).alias("neutral_count"), or_zero("_hosts").alias("source_count"),
            summary.alias("summary"),
        )
        .withColumn("band", scores.sentiment_band(F.col("score")))
    )


def sentiment_report(
    tickers: DataFrame,
    articles: DataFrame,
    positive: Sequence[str] = C.POSITIVE_WORDS,
    negative: Sequence[str] = C.NEGATIVE_WORDS,
) -> DataFrame:
    """Mean score and counts per ticker over its de-duplicated best-tier articles."""
    scored = with_score(articles, positive, negative).select(
        "ticker", "tier", "title", "pos", "url", "score"
    )
    scored = title_dedup(tier_fallback(scored).drop("tier"))
    return with_sentiment(tickers.select("ticker"), sentiment_totals(scored))


def sentiment_records(
    articles: DataFrame,
    positive: Sequence[str] = C.POSITIVE_WORDS,
    negative: Sequence[str] = C.NEGATIVE_WORDS,
) -> DataFrame:
    """One stored record per ticker and publication hour."""
    scored = title_dedup(
        with_score(articles, positive, negative)
        .select("ticker", "title", "pos", "published_at", "score")
    )
    return scored.where(F.col("published_at").isNotNull()).groupBy(
        "ticker", F.date_trunc("hour", "published_at").alias("ts")
    ).agg(
        F.round(F.avg("score"), 4).alias("score"),
        F.count(F.lit(1)).cast("int").alias("headline_count"),
    )
