"""A forgiving HTML reader that yields blocks: elements that break lines, and the texts between them."""

from __future__ import annotations

import re
from html import unescape

#: Fixed values of the HTML standard: elements inside a line, without content, and with raw content that is no text of the page.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img picture br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title template noscript iframe svg canvas select textarea xmp noframes noembed".split())
#: An element that opens closes these, up to the nearest of the second list.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_REST = re.compile(r"[\s/=]*")
_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Block:
    """An element (``tag``), or a text inside its parent (``tag`` empty)."""

    __slots__ = ("tag", "parent", "depth", "attributes", "text", "linked")

    def __init__(self, tag: str, parent: int, depth: int, attributes: dict[str, str], text: str = "", linked: int = 0):
        self.tag, self.parent, self.depth, self.attributes = tag, parent, depth, attributes
        self.text, self.linked = text, linked


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a tag and where its ``>`` is, or -1 if the page ends first."""
    found: dict[str, str] = {}
    while True:
        match = _ATTRIBUTE.match(html, at)
        if not match:
            at = _REST.match(html, at).end()
            if at >= len(html) or html[at] == ">":
                return found, at if at < len(html) else -1
            continue
        name, *values = match.groups()
        value = next((v for v in values if v is not None), "")
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
        at = match.end()


def read(html: str) -> list[Block]:
    """Blocks in page order, parents before children; the first one is the page itself.

    Each position is read once: comments, tags and raw elements that never end reach to the end
    of the page. White space of a text is turned into single spaces, and texts of white space alone are left out.
    """
    out = [Block("page", -1, 0, {})]
    stack, open_tags = [0], {"page": 1}
    pieces: list[str] = []
    linked, link_at = 0, -1

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block("", stack[-1], len(stack), {}, text, min(linked, len(text))))
            pieces.clear()
            linked = 0

    def close(tag: str) -> None:
        nonlocal link_at
        while True:
            top = out[stack.pop()].tag
            open_tags[top] -= 1
            if len(stack) < link_at:
                link_at = -1
            if top == tag:
                return

    def say(text: str) -> None:
        nonlocal linked
        if text:
            text = unescape(text) if "&" in text else text
            pieces.append(text)
            if link_at >= 0:
                linked += len(text.strip())

    at, end = 0, len(html)
    while at < end:
        tag_at = html.find("<", at)
        if tag_at < 0:
            say(html[at:])
            break
        nxt = html[tag_at + 1:tag_at + 2]
        if nxt.isascii() and nxt.isalpha():
            say(html[at:tag_at])
            name = _NAME.match(html, tag_at + 1)
            tag = name.group().lower()
            attributes, close_at = _attributes(html, name.end())
            if close_at < 0:
                break
            at = close_at + 1
            if tag in RAW:
                if tag != "title":
                    pieces.append("" if tag in ("script", "style", "template") else " ")
                if html[close_at - 1] == "/" and tag == "svg":
                    continue
                match = _END[tag].search(html, at)
                if not match:
                    break
                at = html.find(">", match.end()) + 1 or end
            elif tag in INLINE:
                if tag == "br":
                    pieces.append(" ")
                elif tag == "a":
                    link_at = len(stack) if "href" in attributes else -1
            else:
                flush()
                if open_tags.get("p") and out[stack[-1]].tag == "p":
                    close("p")
                if tag in CLOSES:
                    ends, stops = CLOSES[tag]
                    if any(open_tags.get(t) for t in ends):
                        for i in reversed(stack):
                            if out[i].tag in stops or i == 0:
                                break
                            if out[i].tag in ends:
                                close(out[i].tag)
                                break
                if tag in ("html", "body"):
                    out[0].attributes.update({k: v for k, v in attributes.items() if k == "data-keep"})
                    continue
                if tag in VOID or tag == "head":
                    continue
                out.append(Block(tag, stack[-1], len(stack), attributes))
                stack.append(len(out) - 1)
                open_tags[tag] = open_tags.get(tag, 0) + 1
        elif nxt == "/":
            say(html[at:tag_at])
            close_at = html.find(">", tag_at)
            name = _NAME.match(html, tag_at + 2)
            at = close_at + 1 or end
            if name and close_at >= 0:
                tag = name.group().lower()
                if tag == "a":
                    link_at = -1
                elif tag not in INLINE:
                    flush()
                    if open_tags.get(tag) and tag != "page":
                        close(tag)
        elif nxt == "!" or nxt == "?":
            say(html[at:tag_at])
            if html.startswith("<!--", tag_at):
                close_at = html.find("-->", tag_at + 2)
                at = close_at + 3 if close_at >= 0 else end
            else:
                at = html.find(">", tag_at) + 1 or end
        else:
            say(html[at:tag_at + 1])
            at = tag_at + 1
    flush()
    return out
