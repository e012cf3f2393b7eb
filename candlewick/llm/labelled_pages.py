"""The labelled pages of the extraction model: hand-written parts of web pages, composed in many layouts.

``data-keep="1"`` marks main text and ``data-keep="0"`` what inside it is none. The model never sees these marks.
Words are invented, so that it learns from structure, names of elements and the look of texts.
"""

from __future__ import annotations

import random

_SYLLABLES = ("an be co da el fi gu ha in jo ka li mo ne or pa qui ra so ti un ve wa xi yo zu é ö ñ ção sch ment tion ing "
              "der ste lla pré").split()

# Names that pages give to their parts.
_NAMES = {
    "nav": ["nav", "main-nav", "menu", "navbar", "site-navigation", "topmenu", "breadcrumbs", "pagination", "toc"],
    "header": ["header", "site-header", "masthead", "top-bar", "page-head", "branding"],
    "footer": ["footer", "site-footer", "bottom", "page-foot", "colophon", "legal"],
    "side": ["sidebar", "side", "right-rail", "widget-area", "aside", "secondary", "col-right"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-slot", "banner", "sponsored", "promo-box", "adsense"],
    "notice": ["cookie-banner", "cookie-consent", "notice", "gdpr", "alert", "popup", "modal", "disclaimer", "paywall"],
    "form": ["newsletter", "subscribe-box", "signup", "login-form", "search-box", "contact-form"],
    "share": ["share", "social-links", "sharing", "share-buttons", "follow-us", "tools"],
    "comments": ["comments", "comment-list", "responses", "discussion", "disqus_thread", "reader-comments", "replies"],
    "related": ["related", "recommended", "more-stories", "read-next", "teasers", "trending", "most-popular"],
    "content": ["content", "article", "post", "entry-content", "article-body", "story", "main-text", "post-body", "page-content"],
    "wrap": ["wrap", "container", "page", "wrapper", "row", "col", "layout", "inner", ""],
    "comment": ["comment", "reply", "comment-body", "thread-item", "response"],
    "para": ["", "text", "paragraph", ""],
}
_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "content": "article", "comments": "section",
         "related": "aside", "form": "form", "ad": "aside", "notice": "div", "share": "div", "wrap": "div", "comment": "article"}


class _Page:
    """One page: a style, and parts written in it."""

    def __init__(self, rng: random.Random):
        self.rng = rng
        #: Share of parts that use tags with a meaning, and of parts that have names.
        self.tags, self.names = rng.choice([(1, 0), (0, 1), (0.7, 0.7), (0.3, 1), (1, 0.5), (0.2, 0.6)])
        self.sloppy = rng.random() < 0.3
        self.junk = rng.random() < 0.15

    def words(self, n: int) -> str:
        rng = self.rng
        return " ".join("".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((1, 1, 2, 2, 3, 4)))) for _ in range(n))

    def sentence(self, n: int | None = None) -> str:
        text = self.words(n or self.rng.randint(4, 22)).capitalize()
        if self.rng.random() < 0.4:
            text = text.replace(" ", ", ", 1)
        if self.junk:
            text = " ".join(w + self.rng.choice(["***", "%%%", "###", "&amp;&amp;", "$$$", "!!"]) for w in text.split())
        return text + self.rng.choice(". . . . ! ? :".split())

    def prose(self, least: int = 1, most: int = 7) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(least, most)))

    def passage(self) -> str:
        """From one word to a page."""
        rng = self.rng
        form = rng.random()
        if form < 0.15:
            return self.sentence(rng.randint(1, 3))
        if form < 0.20:  # without a stop, at times one word again and again
            return self.words(rng.randint(40, 300)) if rng.random() < 0.5 else f"{self.words(1).title()} " * rng.randint(3, 300)
        return self.prose(10, 60) if form < 0.28 else self.prose()

    def rich(self) -> str:
        """Prose with elements inside the line."""
        text, rng = self.passage(), self.rng
        for tag in ("b", "em", "a", "span", "code"):
            if rng.random() < 0.2:
                attribute = ' href="/x/y"' if tag == "a" else ""
                text += f" <{tag}{attribute}>{self.words(rng.randint(1, 4))}</{tag}> {self.sentence()}"
        return text

    def box(self, role: str, inner: str, keep: int | None = None) -> str:
        rng = self.rng
        tag = _TAGS[role] if rng.random() < self.tags else rng.choice(["div", "div", "div", "section"])
        # A part with neither a tag of meaning nor a name says nothing; that is rare for what prose alone cannot tell.
        named = rng.random() < self.names or (tag in ("div", "section") and role not in ("wrap", "nav", "footer", "content"))
        name = rng.choice(_NAMES[role]) if named else ""
        mark = f' {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", " x-" + str(rng.randint(1, 99))])}"' if name else ""
        kept = "" if keep is None else f' data-keep="{keep}"'
        return f"<{tag}{mark}{kept}>{inner}</{tag}>"

    def links(self, least: int = 2, most: int = 9, words: int = 2) -> str:
        items = [f'<a href="/{i}">{self.words(self.rng.randint(1, words))}</a>' for i in range(self.rng.randint(least, most))]
        form = self.rng.random()
        if form < 0.6:
            end = "" if self.sloppy else "</li>"
            return "<ul>" + "".join(f"<li>{x}{end}" for x in items) + "</ul>"
        return self.rng.choice([" | ", " ", " · ", " &raquo; "]).join(items) if form < 0.85 else "".join(f"<div>{x}</div>" for x in items)

    def nav(self) -> str:
        return self.box("nav", self.links())

    def header(self) -> str:
        name = self.words(2).title()
        return self.box("header", self.rng.choice([f"<h1>{name}</h1>", f'<div class="logo"><a href="/">{name}</a></div>', f"<p>{name}</p>"])
                        + self.rng.choice(["", self.nav(), f"<p>{self.words(4)}</p>", self.box("form", '<input name="q"><button>Search</button>')]))

    def footer(self) -> str:
        return self.box("footer", self.rng.choice(["&copy; ", "Copyright ", "&copy; 2024 ", ""]) + self.rng.choice([
            f"{self.words(2)}.example.com &middot; {self.sentence()}", f"{self.words(2)}. All rights reserved.",
            self.links(), f"<p>{self.sentence()}</p>{self.links()}", f"<p>{self.prose(1, 3)}</p>"]))

    def ad(self) -> str:
        return self.box("ad", self.rng.choice([
            self.sentence(), f"<p>{self.prose(1, 3)}</p>", f'<a href="/buy">{self.words(5)}</a>',
            f"Advertisement<p>{self.sentence()} Buy now!</p>", f"<span>Sponsored</span><h3>{self.words(4)}</h3><p>{self.sentence()}</p>"]), 0)

    def notice(self) -> str:
        text = self.rng.choice([
            "We use cookies to improve this site.", "This website uses cookies. " + self.sentence(), self.prose(1, 3),
            "Please enable JavaScript to read this page.", "By going on you accept our privacy policy. " + self.sentence()])
        return self.box("notice", f"<p>{text}</p>" + self.rng.choice(["", "<button>Accept</button>", '<a href="/privacy">More</a>']), 0)

    def form(self) -> str:
        return self.box("form", f"<label>{self.rng.choice(['E-mail', 'Subscribe to our newsletter', self.words(2)])}</label>"
                        f"<input type=text><p>{self.sentence()}</p><button>{self.words(1)}</button>", 0)

    def share(self) -> str:
        return self.box("share", "Share: " + self.links(2, 5, 1), 0)

    def related(self) -> str:
        head = self.rng.choice(["<h3>Related</h3>", f"<h3>{self.words(2)}</h3>", "<h4>Most read</h4>", ""])
        body = self.links(3, 8, 7) if self.rng.random() < 0.6 else "".join(
            f'<div><h4><a href="/{i}">{self.words(6)}</a></h4><p>{self.sentence()}</p></div>' for i in range(self.rng.randint(2, 4)))
        return self.box("related", head + body, 0)

    def side(self) -> str:
        parts = [self.links, self.ad, self.form, self.related, lambda: f"<h3>{self.words(2)}</h3><p>{self.prose(1, 3)}</p>"]
        return self.box("side", "".join(self.rng.choice(parts)() for _ in range(self.rng.randint(1, 3))), 0)

    def comments(self) -> str:
        def one(depth: int = 0) -> str:
            who = self.rng.choice([f"<b>{self.words(1)}</b> says:", f'<a href="/u">{self.words(1)}</a>', f"<h4>{self.words(2)}</h4>"])
            inner = f"{who}<p>{self.prose(1, 4)}</p>" + self.rng.choice(["", '<a href="#r">Reply</a>'])
            if depth < 2 and self.rng.random() < 0.2:
                inner += one(depth + 1)
            return self.box("comment", inner) if self.rng.random() < 0.7 else f"<li>{inner}</li>"

        head = self.rng.choice(["<h3>Comments</h3>", f"<h2>{self.rng.randint(2, 40)} comments</h2>", "<h3>Discussion</h3>", ""])
        return self.box("comments", head + "".join(one() for _ in range(self.rng.randint(1, 5))), 0)

    def paragraph(self) -> str:
        rng, end = self.rng, "" if self.sloppy else "</p>"
        form = rng.random()
        if form < 0.62:
            return f"<p>{self.rich()}{end}"
        if form < 0.70:
            return f"<p><b>{self.passage()}<br>{end}"
        if form < 0.76:
            return f"<h2>{self.words(rng.randint(1, 7))}</h2><p>{self.rich()}{end}"
        if form < 0.82:
            items = "".join(f"<li>{self.sentence()}</li>" for _ in range(rng.randint(2, 6)))
            return f"<ul>{items}</ul>" if rng.random() < 0.6 else f"<ol>{items}</ol>"
        if form < 0.86:
            return f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>"
        if form < 0.90:
            return f'<figure><img src="x.png"><figcaption>{self.sentence()}</figcaption></figure>'
        if form < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.words(2)}</td><td>{rng.randint(1, 999)}</td></tr>" for _ in range(3)) + "</table>"
        return rng.choice([f"<div>{self.rich()}</div>", f"{self.rich()}<br><br>{self.rich()}", f"<pre>{self.words(6)}\n{self.words(4)}</pre>",
                           f"<section><h3>{self.words(3)}</h3><p>{self.rich()}{end}</section>"])

    def article(self) -> str:
        rng = self.rng
        title = f"<h1>{self.sentence(rng.randint(3, 10))[:60]}</h1>" if rng.random() < 0.85 else ""
        if title and rng.random() < 0.2:
            title = f"<header>{title}<p>{self.words(2)}, {rng.randint(1, 30)}. {rng.randint(1, 12)}. 2023</p></header>"
        paragraphs = [self.paragraph() for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 9, 14)))]
        form = rng.random()
        if form < 0.15:
            paragraphs = [f"<p>{self.sentence()}</p>"]
        elif form < 0.2:
            text = self.sentence(rng.randint(1, 4))
            title, paragraphs = f"<h1>{text}</h1>", [f"<p>{text}</p>"]
        elif form < 0.33:  # many short lines, often the same ones
            lines = [self.sentence(rng.randint(1, 4)) for _ in range(rng.randint(1, 6))]
            paragraphs += [f"<p>{rng.choice(lines)}</p>" for _ in range(rng.randint(4, 60))]
        for _ in range(rng.choice((0, 0, 0, 1, 2))):
            part = rng.choice([self.ad, self.share, self.related, self.form, self.notice])()
            paragraphs.insert(rng.randint(0, len(paragraphs)), part)
        if rng.random() < 0.12:
            paragraphs.append(self.comments())
        inner = title + "".join(paragraphs)
        if rng.random() < 0.3:
            inner = title + self.box("content", "".join(paragraphs), 1)
        return self.box("content", inner, 1)

    def whole(self) -> str:
        rng = self.rng
        if rng.random() < 0.1:
            tag = rng.choice(["div", "body", "body"])
            return f'<{tag} data-keep="1">{"".join(self.paragraph() for _ in range(rng.randint(1, 4)))}</{tag}>'
        top = [p() for p in (self.header, self.nav, self.notice, self.ad) if rng.random() < 0.55]
        middle = [self.article()] + [p() for p in (self.comments, self.related, self.share, self.ad, self.form) if rng.random() < 0.3]
        side = [self.side() for _ in range(rng.choice((0, 0, 1, 1, 2)))]
        if rng.random() < 0.15:
            body = "<table><tr>" + "".join(f"<td>{x}</td>" for x in (side[:1] + ["".join(middle)] + side[1:])) + "</tr></table>"
        else:
            main = "".join(middle)
            if rng.random() < 0.5:
                main = f"<main>{main}</main>" if rng.random() < self.tags else self.box("wrap", main)
            body = "".join(side[:1]) + main + "".join(side[1:]) if rng.random() < 0.3 else main + "".join(side)
        body = "".join(top) + body + (self.footer() if rng.random() < 0.8 else "") + (self.notice() if rng.random() < 0.2 else "")
        for _ in range(rng.choice((0, 1, 1, 2))):
            body = self.box("wrap", body)
        page = f"<html><head><title>{self.words(4)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>"
        # Some pages were cut off while they were fetched.
        return page[:rng.randint(len(page) * 2 // 3, len(page))] if rng.random() < 0.1 else page


def labelled_pages(n: int, seed: int = 2024) -> list[str]:
    rng = random.Random(seed)
    return [_Page(rng).whole() for _ in range(n)]
