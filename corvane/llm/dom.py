"""A forgiving HTML reader: block elements as a tree, inline text as runs that belong to blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

BLOCKS = frozenset(
    "html body head title main article section aside nav header footer form fieldset div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary dialog hgroup center noscript iframe template button select option textarea menu".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no text of the page; it is skipped up to the end tag.
RAW = frozenset("script style textarea title iframe template svg".split())
#: A start tag of the key ends an open element of the value, up to the nearest scope.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = frozenset("html body table ul ol dl select div article section main aside nav header footer form menu".split())
#: Start tags that end an open paragraph.
ENDS_P = BLOCKS - frozenset("html body head title button select option textarea noscript iframe template td th tr caption thead tbody tfoot".split())

_TOKEN = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z))", re.S)
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Page:
    """Blocks in page order: parent (-1: none), depth, tag, marks (class, id and role, lower case).

    runs: (block, text, letters of it inside links), in page order; texts are decoded
    with white space as it was. flagged: whether the start tag holds a given string.
    """

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    marks: list[str] = field(default_factory=list)
    runs: list[tuple[int, str, int]] = field(default_factory=list)
    flagged: list[bool] = field(default_factory=list)


def parse(html: str, flag: str = "") -> Page:
    """Read any text as HTML; nothing makes it fail.

    Unclosed and crossed tags are closed by the block that cannot contain them or
    by the end of an element around them; end tags without a start are ignored. An
    empty text has one block without runs. A `<` that starts no tag is text. Text
    in math and object is inline text, that of noscript is in a block of its own;
    an svg that closes itself or is never closed hides nothing.
    """
    page = Page([-1], [0], ["html"], [""], flagged=[True])
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements; block number or -1
    block, links, linked = 0, 0, 0
    text: list[str] = []

    def flush() -> None:
        nonlocal linked
        if text:
            joined = "".join(text)
            if joined.strip():
                page.runs.append((block, unescape(joined), linked))
            text.clear()
            linked = 0

    def close(k: int) -> None:
        """Close the element at place k of the stack and all in it."""
        nonlocal block, links
        gone = stack[k:]
        del stack[k:]
        links -= sum(t == "a" for t, _ in gone)
        if any(b >= 0 for _, b in gone):
            block = next(b for _, b in reversed(stack) if b >= 0)

    def last(names: tuple[str, ...], scopes: frozenset[str]) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in scopes:
                break
        return 0

    at, n = 0, len(html)
    open_count: dict[str, int] = {}
    while at < n:
        m = _TOKEN.search(html, at)
        piece = html[at : m.start() if m else n]
        if piece:
            text.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if tag == "html" or tag == "body" or not open_count.get(tag):
                continue
            k = last((tag,), frozenset())
            if k:
                for t, _ in stack[k:]:
                    open_count[t] -= 1
                close(k)
            continue
        if tag == "br":
            text.append("\n")
            continue
        if tag in RAW:
            if tag in BLOCKS:
                flush()
            if tag == "svg" and m[3].endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else at if tag == "svg" else n
            continue
        if tag == "html":
            continue
        is_block = tag in BLOCKS
        if is_block:
            flush()
            for names, on in ((ENDS.get(tag, ()), True), (("p",), tag in ENDS_P)):
                while names and on and (k := last(names, SCOPES)):
                    for t, _ in stack[k:]:
                        open_count[t] -= 1
                    close(k)
        if tag in VOID or m[3].endswith("/") and not is_block:
            continue
        if is_block:
            page.parent.append(block)
            page.depth.append(page.depth[block] + 1)
            page.tag.append(tag)
            page.marks.append(" ".join(a or b or c for a, b, c in _MARKS.findall(m[3])).lower() if "=" in m[3] else "")
            page.flagged.append(bool(flag) and flag in m[3])
            block = len(page.tag) - 1
            stack.append((tag, block))
        else:
            stack.append((tag, -1))
            links += tag == "a"
        open_count[tag] = open_count.get(tag, 0) + 1
    flush()
    return page
