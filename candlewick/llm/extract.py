"""Main texts of web pages: a tree-structured graphical model over the blocks of a page."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm.dom import Block, read
from candlewick.llm.labelled_pages import labelled_pages

#: Pages of the labelled table that the model is trained on.
LABELLED = 400
#: Blocks that are decoded at once; a page is never split.
BLOCKS = 20_000

#: Kinds of blocks for the parent-child potentials.
_KIND = {tag: kind for kind, tags in enumerate((
    ("",), ("p", "blockquote", "pre", "figcaption"), ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), ("div",),
    ("article", "main"), ("section",), ("nav", "menu"), ("header", "footer"), ("aside",), ("ul", "ol", "dl"),
    ("li", "dt", "dd"), ("table", "tbody", "thead", "tfoot", "tr"), ("td", "th"),
    ("form", "fieldset", "button", "label", "legend", "option", "output", "dialog"), ("figure", "details", "summary"),
)) for tag in tags}
_OTHER = len(set(_KIND.values()))
_KINDS = _OTHER + 1

# Fixed word lists: what names of elements and short texts say about a block.
_CUES = {
    "content": "article content post entry story body text main prose news blog page paragraph lead intro headline",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager tabs toc topics links",
    "frame": "header masthead top topbar footer bottom foot copyright colophon legal logo brand site sitemap",
    "side": "sidebar side aside rail related recommended recommendations more widget popular trending teaser promo",
    "advert": "ad ads adv advert adverts advertisement advertising banner sponsor sponsored partner dfp promoted",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay disclaimer paywall announcement message",
    "form": "form login signin signup subscribe subscription newsletter search input register contact",
    "share": "share sharing social follow tools actions buttons toolbar",
    "comment": "comment comments commentlist reply replies respond response responses discussion disqus reader readers "
               "thread feedback guestbook",
    "meta": "meta byline author date tags tag category info details caption",
}
_CUE_OF = {word: name for name, words in _CUES.items() for word in words.split()}
_SPOKEN = re.compile(
    r"(?P<rights>©|\ball rights reserved\b|\bcopyright\b|\bimprint\b)|(?P<consent>\bcookies?\b|\bconsent\b|\bprivacy\b)|"
    r"(?P<join>\bsubscribe\b|\bnewsletter\b|\bsign (?:up|in)\b|\blog ?in\b|\be-?mail\b)|"
    r"(?P<sell>\badvert\w*\b|\bsponsored\b|\bbuy now\b|\bshop now\b|% off\b)|"
    r"(?P<talk>\bcomments?\b|\brepl(?:y|ies)\b|\bsays:)|(?P<also>\brelated\b|\bread (?:more|also|next)\b|\bshare\b|\bmost read\b)|"
    r"(?P<bar>[|»›·•])", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _log2(n: float, most: int = 9) -> int:
    """Size class; all sizes from ``2 ** (most - 1)`` are one, so that no text is longer than what was learnt."""
    return min(int(n).bit_length(), most)


def _share(x: float) -> int:
    return 0 if x <= 0 else 1 if x < 0.1 else 2 if x < 0.3 else 3 if x < 0.6 else 4 if x < 0.9 else 5


def _names(attributes: dict[str, str]) -> set[str]:
    found = set()
    for key in ("class", "id", "role", "itemprop", "aria-label"):
        if value := attributes.get(key):
            found.update(word.lower() for word in _PARTS.findall(value))
    return found


def features(blocks: list[Block]) -> list[list[str]]:
    """What is known of each block, as names; texts and what lies below an element are measured."""
    n = len(blocks)
    chars, linked, texts, stops, long_texts = ([0] * n for _ in range(5))
    for i in range(n - 1, -1, -1):
        b = blocks[i]
        if not b.tag:
            chars[i], linked[i], texts[i] = len(b.text), b.linked, 1
            stops[i] = b.text[-1] in ".!?:;…\"'”»)" and len(b.text) > 20
            long_texts[i] = len(b.text) >= 80
        if b.parent >= 0:
            for column in (chars, linked, texts, stops, long_texts):
                column[b.parent] += column[i]
    total, largest = max(1, chars[0]), max([1] + [len(b.text) for b in blocks if not b.tag])
    # Elements of a kind inside another of that kind mean something else, as comments inside an article.
    within = [False] * n
    for i, b in enumerate(blocks):
        if b.parent >= 0:
            within[i] = within[b.parent] or blocks[b.parent].tag == "article"
    out, seen = [], 0
    for i, b in enumerate(blocks):
        link = _share(linked[i] / max(1, chars[i]))
        parent = blocks[b.parent].tag if b.parent >= 0 else ""
        if not b.tag:
            here = [f"t:size{_log2(len(b.text))}", f"t:link{link}", f"t:stop{int(stops[i])}", f"t:in_{parent}",
                    f"t:largest{_share(len(b.text) / largest)}", f"t:place{int(6 * seen / total)}",
                    f"t:commas{_log2(b.text.count(','))}", f"t:alone{int(texts[b.parent] == 1)}",
                    f"t:size{_log2(len(b.text))}link{link > 2}"]
            if len(b.text) < 300:
                here += {f"t:says_{m.lastgroup}{int(len(b.text) < 120)}" for m in _SPOKEN.finditer(b.text)}
            seen += len(b.text)
        else:
            here = [f"e:tag_{b.tag}", f"e:tag_{b.tag}{int(within[i])}", f"e:in_{parent}", f"e:link{link}", f"e:share{_share(chars[i] / total)}",
                    f"e:texts{_log2(texts[i])}", f"e:long{_share(long_texts[i] / max(1, texts[i]))}",
                    f"e:mean{_log2(chars[i] / max(1, texts[i]))}", f"e:stops{_share(stops[i] / max(1, texts[i]))}",
                    f"e:depth{min(b.depth, 8)}"]
            if b.attributes:
                names = _names(b.attributes)
                here += [f"e:name_{w}" for w in names if w in _CUE_OF]
                here += {f"e:cue_{_CUE_OF[w]}" for w in names if w in _CUE_OF}
                style = b.attributes.get("style", "").replace(" ", "").lower()
                if "hidden" in b.attributes or b.attributes.get("aria-hidden") == "true" or "display:none" in style:
                    here.append("e:hidden")
        out.append(here)
    return out


class Forest:
    """Blocks of some pages as arrays: parents, and the blocks of each depth."""

    def __init__(self, pages: list[list[Block]], index: dict[str, int]):
        starts = np.cumsum([0] + [len(p) for p in pages])
        self.size = int(starts[-1])
        self.parent = np.array([b.parent + at if b.parent >= 0 else -1 for p, at in zip(pages, starts) for b in p], dtype=np.int64)
        depth = np.array([b.depth for p in pages for b in p], dtype=np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.searchsorted(depth[order], np.arange(1, depth.max() + 1))) if self.size else []
        self.kind = np.array([_KIND.get(b.tag, _OTHER) for p in pages for b in p], dtype=np.int64)
        pairs = [(at + i, index[f]) for p, at in zip(pages, starts) for i, names in enumerate(features(p)) for f in names if f in index]
        self.row, self.column = (np.array(c, dtype=np.int64) for c in zip(*pairs)) if pairs else (np.zeros(0, dtype=np.int64),) * 2


def marginals(levels: list[np.ndarray], parent: np.ndarray, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sum-product on a forest, all trees at once and level by level.

    ``unary`` is (blocks, 2) and ``pair`` (blocks, 2 of the parent, 2 of the block), both logarithms. Messages go from
    children to parents, then from parents to children. Returns the marginal of each
    block, that of each (parent, block), and the sum of the log partition functions.
    """
    inward = unary.copy()
    up = np.zeros_like(unary)
    for level in reversed(levels[1:]):
        reach = pair[level] + inward[level][:, None, :]
        up[level] = np.logaddexp(reach[:, :, 0], reach[:, :, 1])
        above, where = np.unique(parent[level], return_inverse=True)
        for state in (0, 1):
            inward[above, state] += np.bincount(where, up[level, state])
    total = inward.copy()
    both = np.zeros_like(pair)
    for level in levels[1:]:
        # What the parent believes without this block, for each state of both.
        rest = (total[parent[level]] - up[level])[:, :, None] + pair[level]
        total[level] = inward[level] + np.logaddexp(rest[:, 0], rest[:, 1])
        joint = rest + inward[level][:, None, :]
        both[level] = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        both[level] /= both[level].sum(axis=(1, 2), keepdims=True)
    log_z = np.logaddexp(*total[levels[0]].T).sum() if levels else 0.0
    total -= total.max(axis=1, keepdims=True)
    own = np.exp(total)
    return own / own.sum(axis=1, keepdims=True), both, float(log_z)


class TreeModel:
    """Weights of block features and of parent-child pairs by the kind of both."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.index, self.weights, self.pairs = index, weights, pairs

    def potentials(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        unary = np.zeros((forest.size, 2))
        unary[:, 1] = np.bincount(forest.row, self.weights[forest.column], minlength=forest.size)
        above = np.where(forest.parent >= 0, forest.kind[np.maximum(forest.parent, 0)], 0)
        return unary, self.pairs[above, forest.kind]

    def content(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of each block to be content."""
        forest = Forest(pages, self.index)
        own, _, _ = marginals(forest.levels, forest.parent, *self.potentials(forest))
        return np.split(own[:, 1], np.cumsum([len(p) for p in pages])[:-1])


def labels(blocks: list[Block]) -> np.ndarray:
    """1 for blocks below ``data-keep="1"``, and for elements most of whose text is."""
    keep, kept, chars = [], np.zeros(len(blocks)), np.zeros(len(blocks))
    for b in blocks:
        own = b.attributes.get("data-keep")
        keep.append(int(own) if own else keep[b.parent] if b.parent >= 0 else 0)
    for i in range(len(blocks) - 1, -1, -1):
        if not blocks[i].tag:
            chars[i], kept[i] = len(blocks[i].text), len(blocks[i].text) * keep[i]
        if blocks[i].parent >= 0:
            chars[blocks[i].parent] += chars[i]
            kept[blocks[i].parent] += kept[i]
    return np.where(chars > 0, kept > chars / 2, np.array(keep) == 1).astype(np.int64)


def train(pages: list[str], rounds: int = 100, penalty: float = 0.0005, least: int = 3) -> TreeModel:
    """Maximum likelihood over whole trees: expected features are subtracted from observed ones (Adam, quadratic penalty).

    Features of fewer than ``least`` blocks are left out.
    """
    trees = [read(page) for page in pages]
    counts: dict[str, int] = {}
    for tree in trees:
        for names in features(tree):
            for name in names:
                counts[name] = counts.get(name, 0) + 1
    index = {name: i for i, name in enumerate(sorted(n for n, c in counts.items() if c >= least))}
    forest, truth = Forest(trees, index), np.concatenate([labels(t) for t in trees])
    model = TreeModel(index, np.zeros(len(index)), np.zeros((_KINDS, _KINDS, 2, 2)))
    children = np.flatnonzero(forest.parent >= 0)
    above = forest.kind[forest.parent[children]]
    observed = np.bincount(forest.column, truth[forest.row], minlength=len(index))
    seen = np.zeros_like(model.pairs)
    np.add.at(seen, (above, forest.kind[children], truth[forest.parent[children]], truth[children]), 1)
    moments = [np.zeros_like(model.weights), np.zeros_like(model.weights), np.zeros_like(seen), np.zeros_like(seen)]
    for t in range(1, rounds + 1):
        own, both, _ = marginals(forest.levels, forest.parent, *model.potentials(forest))
        expected = np.zeros_like(seen)
        np.add.at(expected, (above, forest.kind[children]), both[children])
        steps = (observed - np.bincount(forest.column, own[forest.row, 1], minlength=len(index)), seen - expected)
        for k, (value, step) in enumerate(zip((model.weights, model.pairs), steps)):
            step = step / len(trees) - penalty * value
            first, second = moments[2 * k], moments[2 * k + 1]
            first += 0.1 * (step - first)
            second += 0.01 * (step * step - second)
            value += 0.15 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return model


@lru_cache(maxsize=1)
def trained() -> TreeModel:
    return train(labelled_pages(LABELLED))


def main_texts(pages: list[str | None], model: TreeModel) -> list[str]:
    """The content of each page: blocks more likely content than not, in order, joined by spaces."""
    out: list[str] = []
    some: list[list[Block]] = []

    def decode() -> None:
        for blocks, p in zip(some, model.content(some)):
            out.append(" ".join(b.text for b, x in zip(blocks, p) if not b.tag and x >= 0.5))
        some.clear()

    size = 0
    for page in pages:
        some.append(read(page or ""))
        size += len(some[-1])
        if size >= BLOCKS:
            decode()
            size = 0
    if some:
        decode()
    return out


def extract(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages``.

    A page becomes a tree of blocks (elements that break lines, and the texts between them). Each block is content or
    not; what is known of it by itself and a potential between it and its parent give the probability
    of every labelling, and messages up and down the tree give each block's marginal. Texts
    more likely content than not are joined by one space; white space inside a text is one space.

    The model is trained on ``LABELLED`` labelled pages (a documented bound); it is a few kilobytes and goes along with the
    task. Every page is read whole. A null or empty page gives an empty text and 0; repeated and null ids are fine;
    an empty table gives an empty table; other columns are not read.
    """
    model = model or trained()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = main_texts([None if pd.isna(h) else h for h in batch["html"]], model)
            yield pd.DataFrame({
                "page_id": batch["page_id"].array, "url": batch["url"].array, "text": text, "n_chars": [len(t) for t in text]})

    # Ids travel as text, because pandas would make floats of integers with nulls.
    return pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html").mapInPandas(
        run, "page_id string, url string, text string, n_chars long",
    ).withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))
