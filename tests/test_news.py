"""Parsing, de-duplication, scoring and report cases for articles."""

import pytest
from pyspark.sql import functions as F

from candlewick.functions import text
from candlewick.operators import news as N

RSS = """<rss version="2.0"><channel><title>feed</title>
<item><title>A title - Pub</title><link> http://x/1 </link><description>&lt;p&gt;Some &lt;b&gt;bold&lt;/b&gt; text&lt;/p&gt;</description>
<pubDate>Mon, 15 Jan 2024 14:30:00 GMT</pubDate><source url="http://pub">Pub</source></item>
<item><title>Dash – Pub (x)</title><source url="u">Pub (x)</source></item>
<item><title>  No source - Pub </title></item>
<item><title></title></item>
<item><title>Last</title></item>
</channel></rss>"""


def feed(spark, *texts):
    return spark.createDataFrame([(i, "Feed", t) for i, t in enumerate(texts)],
                                 "feed_id INT, fallback_source STRING, xml STRING")


def test_rss(spark):
    rows = N.rss_articles(feed(spark, RSS, "not xml", "<rss><channel>")).orderBy("feed_id", "pos").collect()
    assert [(r.feed_id, r.pos, r.title, r.source) for r in rows] == [
        (0, 0, "A title", "Pub"), (0, 1, "Dash", "Pub (x)"), (0, 2, "No source - Pub", "Feed"), (0, 4, "Last", "Feed"),
    ]
    assert rows[0].url == "http://x/1" and rows[0].snippet == "Some bold text"
    assert rows[0].published_raw == "Mon, 15 Jan 2024 14:30:00 GMT" and rows[1].published_raw == ""


def test_rss_takes_the_first_items_before_dropping_empty_titles(spark):
    assert N.rss_articles(feed(spark, RSS), 4).count() == 3


def test_single_item_feed(spark):
    xml = "<rss><channel><item><title>Only</title></item></channel></rss>"
    assert [r.title for r in N.rss_articles(feed(spark, xml)).collect()] == ["Only"]


@pytest.mark.parametrize("raw, expected", [
    ("Mon, 15 Jan 2024 14:30:00 GMT", "2024-01-15 14:30:00"), ("Mon, 15 Jan 2024 14:30:00 +0000", "2024-01-15 14:30:00"),
    ("15 Jan 2024 09:30:00 -0500", "2024-01-15 14:30:00"), ("junk", None), ("", None), (None, None),
])
def test_mail_dates(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "raw STRING").select(
        F.date_format(text.rfc_2822_time(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("t"))
    assert df.first().t == expected


@pytest.mark.parametrize("ago, expected", [
    (59, "just now"), (60, "1m ago"), (3599, "59m ago"), (3600, "1h ago"), (86399, "23h ago"), (86400, "1d ago"), (-30, "just now"),
])
def test_age_text(spark, ago, expected):
    df = spark.range(1).select(text.age_text(F.timestamp_seconds(F.lit(1_000_000)), F.timestamp_seconds(F.lit(1_000_000 + ago))).alias("t"))
    assert df.first().t == expected


def articles(spark, rows):
    return spark.createDataFrame(rows, "ticker STRING, feed_rank INT, pos BIGINT, title STRING, source STRING")


def test_greedy_merge_keeps_a_title_open_when_its_source_is_full(spark):
    rows = [("T", 0, 0, "t1", "A"), ("T", 0, 1, "t2", "A"), ("T", 0, 2, "t3", "A"), ("T", 1, 3, "t3", "B"),
            ("T", 1, 4, "t1", "C"), ("T", 1, 5, "", "D"), ("U", 0, 6, "t1", "A")]
    got = N.feed_merge_greedy(articles(spark, rows)).orderBy("ticker", "rank").collect()
    assert [(r.ticker, r.title, r.source) for r in got] == [("T", "t1", "A"), ("T", "t2", "A"), ("T", "t3", "B"), ("U", "t1", "A")]
    # The set-wise form has settled on the first copy of t3 before the cap applies.
    assert {(r.title, r.source) for r in N.feed_merge(articles(spark, rows)).where("ticker = 'T'").collect()} == {("t1", "A"), ("t2", "A")}


def test_greedy_merge_equals_a_plain_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(t, rng.randint(0, 1), i, f"t{rng.randint(0, 5)}", f"s{rng.randint(0, 2)}")
            for t in "ABCDEF" for i in range(30)]
    expected = set()
    for t in "ABCDEF":
        first = [r for r in rows if r[0] == t and r[1] == 0][:10]
        second = [r for r in rows if r[0] == t and r[1] == 1][:5]
        titles, sources = set(), []
        for r in first + second:
            if r[3] not in titles and sources.count(r[4]) < 2:
                titles.add(r[3])
                sources.append(r[4])
                expected.add((t, r[2]))
    got = {(r.ticker, r.pos) for r in N.feed_merge_greedy(articles(spark, rows)).collect()}
    assert got == expected


def test_scores_count_substrings_once(spark):
    df = spark.createDataFrame([("redefined", ""), ("Beaten, beat and BEAT again", "loss"), ("nothing", None)],
                               "title STRING, snippet STRING")
    assert [r.score for r in N.with_score(df).collect()] == [-1.0, 0.0, 0.0]


def test_freshness_falls_back_when_nothing_is_fresh(spark):
    df = spark.createDataFrame([("A", 0, None), ("A", 1, None), ("B", 2, "2024-01-02 00:00:00"), ("B", 3, None), ("B", 4, "2024-01-01 23:59:59")],
                               "ticker STRING, pos INT, t STRING").withColumn("published_at", F.col("t").cast("timestamp"))
    got = N.fresh_news(df, F.lit("2024-01-04 00:00:00").cast("timestamp"))
    assert sorted(r.pos for r in got.collect()) == [0, 1, 2]


def test_top_headlines_take_one_per_source_newest_first(spark):
    rows = [("A", i, f"t{i}", "x" * 300, "u", s, t) for i, (s, t) in enumerate([
        ("s1", "2024-01-01 00:00:00"), ("s1", "2024-01-02 00:00:00"), ("s2", None), ("s3", "2024-01-02 00:00:00"),
        ("s4", "2024-01-01 05:00:00"), ("s5", "2024-01-01 04:00:00"), ("s6", "2024-01-01 03:00:00")])]
    df = spark.createDataFrame(rows, "ticker STRING, pos INT, title STRING, snippet STRING, url STRING, source STRING, t STRING").withColumn(
        "published_at", F.col("t").cast("timestamp")).drop("t")
    got = N.top_headlines(df).orderBy("rank").collect()
    assert [r.title for r in got] == ["t1", "t3", "t4", "t5", "t6"] and len(got[0].snippet) == 150


def test_report_of_a_ticker_without_news(spark):
    tickers = spark.createDataFrame([("A",), ("B",)], "ticker STRING")
    rows = [("A", 0, 2, "beat the record", "http://h/1", ""), ("A", 1, 1, "a loss", "http://h/2", ""),
            ("A", 2, 1, "a loss", "http://g/2", ""), ("A", 3, 1, "surge", "x", "")]
    df = spark.createDataFrame(rows, "ticker STRING, pos INT, tier INT, title STRING, url STRING, snippet STRING")
    got = {r.ticker: r for r in N.sentiment_report(tickers, df).collect()}
    a, b = got["A"], got["B"]
    # Tier 1 is the best tier with articles; the repeated title counts once.
    assert (a.headline_count, a.positive_count, a.negative_count, a.score, a.source_count) == (2, 1, 1, 0.0, 2)
    assert a.summary == "A sentiment: 1 positive, 1 negative, 0 neutral across 2 articles."
    assert (b.headline_count, b.score, b.band, b.summary) == (0, 0.0, "neutral", "No news found.")


@pytest.mark.parametrize("url, expected", [("http://a.b/c", "a.b"), ("a/b", "a/b"), ("", ""), ("x//y", "y")])
def test_host(spark, url, expected):
    assert spark.createDataFrame([(url,)], "u STRING").select(text.host(F.col("u")).alias("h")).first().h == expected


def test_display_texts(spark):
    df = spark.createDataFrame([(2_950_000_000_000,), (1_000_000_000,), (45_600_000,), (999_999,), (None,)], "v BIGINT")
    assert [r[0] for r in df.select(text.market_cap_text(F.col("v"))).collect()] == ["$2950.0B", "$1.0B", "$46M", "$999,999", "N/A"]
    one = spark.createDataFrame([(0.0231, 29.52, None)], "y DOUBLE, p DOUBLE, n DOUBLE").select(
        text.percent_text(F.col("y")), text.number_text(F.col("p"), "x", 1), text.number_text(F.col("n")), text.percent_text(F.col("n"))).first()
    assert list(one) == ["2.31%", "29.5x", "N/A", "N/A"]
    assert spark.range(1).select(F.length(text.shortened(F.repeat(F.lit("x"), F.lit(401))))).first()[0] == 403


def test_freshness_after_the_top_k_equals_freshness_before(spark):
    import random

    rng = random.Random(11)
    rows = [(t, i, f"t{i}", "", "u", f"s{rng.randint(0, 7)}",
             None if rng.random() < 0.2 else f"2024-01-{rng.randint(1, 6 if t != 'C' else 2):02d} {rng.randint(0, 23):02d}:00:00")
            for t in "ABC" for i in range(40)]
    df = spark.createDataFrame(rows, "ticker STRING, pos INT, title STRING, snippet STRING, url STRING, source STRING, t STRING").withColumn(
        "published_at", F.col("t").cast("timestamp")).drop("t")
    now = F.lit("2024-01-07 00:00:00").cast("timestamp")
    for k in (1, 3, 5, 8):
        after = N.top_headlines(df, k, now)
        before = N.top_headlines(N.fresh_news(df, now).drop("is_fresh"), k)
        assert sorted(map(tuple, after.collect()), key=str) == sorted(map(tuple, before.collect()), key=str)
