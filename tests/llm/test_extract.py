"""Page extraction: messages against enumeration, the reader on broken markup, pages written by hand."""

import itertools
import os

import numpy as np
import pytest

from candlewick.llm import dom, extract

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
PROSE = ("The river rose again during the night, and by morning the lower meadows were under water. "
         "Farmers moved their cattle to the hills, as their parents had done before them.")
MORE = "Nobody was hurt, but the old bridge is closed until the engineers have seen its pillars."
TALK = "I walked there yesterday and the water was far higher than the report makes you think."


def texts(html):
    return [b.text for b in dom.read(html) if not b.tag]


def test_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = 9
        parent = np.array([-1, *[-1 if i == 4 else rng.integers(0, i) for i in range(1, n)]])
        depth = np.zeros(n, dtype=int)
        for i in range(n):
            depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
        levels = [np.flatnonzero(depth == d) for d in range(depth.max() + 1)]
        unary, pair = rng.normal(size=(n, 2)), rng.normal(size=(n, 2, 2))
        own, both = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for state in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(unary[i, state[i]] for i in range(n))
                            + sum(pair[i, state[parent[i]], state[i]] for i in range(n) if parent[i] >= 0))
            for i in range(n):
                own[i, state[i]] += weight
                if parent[i] >= 0:
                    both[i, state[parent[i]], state[i]] += weight
        got_own, got_both, log_z = extract.marginals(levels, parent, unary, pair)
        assert np.allclose(got_own, own / own.sum(1, keepdims=True))
        children = parent >= 0
        assert np.allclose(got_both[children], both[children] / own.sum(1)[children, None, None])
        assert np.isclose(log_z, np.log(own[0].sum()))


@pytest.mark.parametrize("html,expected", [
    ("", []), ("   \n ", []), ("plain &amp; simple", ["plain & simple"]),
    ("<p>a<b>b</b>c<br>d</p>e", ["abc d", "e"]), ("<p>one<p>two<ul><li>x<li>y</ul>", ["one", "two", "x", "y"]),
    ("<script>var t='</p>';</script><p>x</p><!-- no --><style>p{}</style>", ["x"]),
    ("<p>1 < 2 &lt; 3</p>", ["1 < 2 < 3"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<p>cut off <a hre", ["cut off"]), ("<p>a</div></p></span>b", ["a", "b"]), ("<!-- never ends <p>x", []),
    ("<p title='a > b' =x>t</p>", ["t"]), ("<p>&#233;&nbsp;&euro;&amp</p>", ["é €&"]), ("<title>t</title><p>x", ["x"]),
])
def test_reader(html, expected):
    assert texts(html) == expected


def test_reader_takes_linear_time_on_broken_pages():
    for piece in ("<div>", "<li>", "<p>x", '<a b="', "</x>", "<", "<!--", "<ul><li>"):
        blocks = dom.read(piece * 50_000)
        assert len(blocks) <= 200_001


PAGES = {
    "semantic": (
        f"<html><body><header><h1>Valley Times</h1></header><nav><a href=/a>Home</a> <a href=/b>Sport</a></nav><main><article>"
        f"<h1>Flood in the valley</h1><p>{PROSE}</p><aside class=related><h3>Related</h3><a href=/x>Earlier floods</a></aside>"
        f"<p>{MORE}</p></article><section id=comments><h2>2 comments</h2><p>{TALK}</p></section></main>"
        f"<footer>&copy; 2024 Valley Times</footer></body></html>", f"Flood in the valley {PROSE} {MORE}"),
    "named": (
        f"<body><div id=cookie-notice><p>We use cookies on this site.</p><button>OK</button></div><div class=topmenu><ul><li><a href=1>A</a>"
        f"<li><a href=2>B</a></ul></div><div class=post-content><h2>Flood</h2><p>{PROSE}<p>{MORE}</div><div class=sidebar>"
        f"<h3>About</h3><p>We write about the valley.</p></div><div class=comment-list><div class=comment><b>Ann</b> says:<p>{TALK}</p>"
        f"</div></div><div class=footer>All rights reserved.</div>", f"Flood {PROSE} {MORE}"),
    "table": (
        f"<table><tr><td><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a></td><td><div class=story><p>{PROSE}</p>"
        f"<p>{MORE}</p></div></td></tr></table>", f"{PROSE} {MORE}"),
    "noise inside": (
        f"<article class=entry><h1>Flood</h1><p>{PROSE}</p><div class=ad-slot>Boats at half price.</div><form class=newsletter>"
        f"<label>E-mail</label><input><button>Join</button></form><p>{MORE}</p><div class=share>Share: <a href=t>T</a> <a href=f>F</a>"
        f"</div></article>", f"Flood {PROSE} {MORE}"),
    "bare": (f"<p>{PROSE}</p><p>{MORE}</p>", f"{PROSE} {MORE}"),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_written_by_hand(name):
    html, expected = PAGES[name]
    assert extract.main_texts([html], extract.trained()) == [expected]


def test_labelled_pages_of_another_draw():
    from candlewick.llm.labelled_pages import labelled_pages

    trees = [dom.read(p) for p in labelled_pages(150, seed=99)]
    right = wrong = missed = 0
    for tree, p in zip(trees, extract.trained().content(trees)):
        for block, found, label in zip(tree, p >= 0.5, extract.labels(tree)):
            if not block.tag:
                right += len(block.text) * (found and label)
                wrong += len(block.text) * (found and not label)
                missed += len(block.text) * (label and not found)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_pages_of_the_tables(spark):
    """These pages hold their text in one article element, which the model does not know for certain."""
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    whole = {r["page_id"]: r["html"] for r in pages.collect()}
    got = extract.extract(pages).collect()
    assert len(got) == len(whole)
    right = sum(r["text"] == " ".join(texts(whole[r["page_id"]].split("<article>")[1].split("</article>")[0])) for r in got)
    assert right >= 0.98 * len(got) and all(r["n_chars"] == len(r["text"]) for r in got)


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, "", "y"), (2**60, "u", f"<p>{PROSE}</p>", "z"), (2**60, "u", f"<p>{PROSE}</p>", "z"),
            (3, "u", "<article><p>" + (PROSE + " ") * 3000 + "</p></article>", "t"), (4, "u", "<div>" * 3000, "t")]
    schema = "page_id long, url string, html string, text string"
    out = extract.extract(spark.createDataFrame(rows, schema)).collect()
    got = sorted((str(r["page_id"]), r["n_chars"]) for r in out)
    assert got == sorted([("1", 0), ("None", 0), (str(2**60), len(PROSE)), (str(2**60), len(PROSE)), ("4", 0),
                          ("3", 3000 * (len(PROSE) + 1) - 1)])
    assert extract.extract(spark.createDataFrame([], schema)).collect() == []
