"""A small forgiving reading of HTML into a tree of nodes and text, for one page at a time.

It knows void elements, elements whose content is no markup, and the end tags that may be
left out; whatever else is wrong in a page is taken as it stands. The reader is a loop over
the matches of one pattern, so its time grows with the page and nothing recurses.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "option", "optgroup", "legend", "summary"}
# An element on the left is ended by the start of one on the right, up to a scope.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
SPACES = re.compile(r"\s+")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
# Possessive throughout: no part of a page is read twice for one tag.
MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*+(?:>|\Z)|</(?![a-zA-Z])[^>]*+(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    attrs: str = ""
    children: list[int] = field(default_factory=list)


@dataclass(slots=True)
class Page:
    """Nodes in page order; texts as (node, text) in page order."""

    nodes: list[Node]
    texts: list[tuple[int, str]]


def read_page(source: str) -> Page:
    nodes = [Node("#root", -1, 0)]
    texts: list[tuple[int, str]] = []
    stack = [0]
    at, end = 0, len(source)

    def put_text(start: int, stop: int) -> None:
        if stop > start:
            piece = source[start:stop]
            if "&" in piece:
                piece = html.unescape(piece)
            texts.append((stack[-1], piece))

    def close_to(depth: int) -> None:
        del stack[depth:]

    while at < end:
        m = MARKUP.search(source, at)
        if m is None:
            put_text(at, end)
            break
        put_text(at, m.start())
        at = m.end()
        slash, name, attrs = (m.group(1), m.group(2), m.group(3)) if m.group(2) else (m.group(4), m.group(5), m.group(6))
        if name is None:
            continue
        tag = name.lower()
        if slash:
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == tag:
                    close_to(depth)
                    break
            continue
        if tag in CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[depth]].tag
                if open_tag == "p":
                    close_to(depth)
                    break
                if open_tag in BLOCKS:
                    break
        elif tag in ENDED_BY:
            ended, scope = ENDED_BY[tag]
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = nodes[stack[depth]].tag
                if open_tag in scope:
                    break
                if open_tag in ended:
                    close_to(depth)
                    break
        here = len(nodes)
        nodes.append(Node(tag, stack[-1], len(stack), attrs))
        nodes[stack[-1]].children.append(here)
        if tag == "br":
            # A line break parts words as white space does.
            texts.append((stack[-1], " "))
        if tag in VOID or attrs.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = close.end() if close else end
            continue
        stack.append(here)
    return Page(nodes, texts)


def attribute_words(attrs: str) -> str:
    """Class, id, role and the like of one start tag, lower-cased, as one string."""
    if not attrs:
        return ""
    found = []
    for name, value in ATTRIBUTE.findall(attrs):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label", "hidden"):
            found.append(value.strip("\"'") or name)
    return " ".join(found).lower()
