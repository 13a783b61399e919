"""Main text of web pages by boosted trees over DOM nodes and a consistent choice in the tree.

The tree of a page is reduced to its block elements that hold text; text that stands beside
block elements becomes a leaf of its own. Trees score each node for "all of its text is
main text" from its tag, attribute words, depth, subtree density, links, and what stands
around it. Decoding picks the likeliest set of kept nodes under one rule: below a kept
node everything is kept. So no node is dropped inside a kept one, and none of a kept
node's text is lost; a node that is not kept leaves the choice to its children.

The trees learn from at most ``TRAIN_PAGES`` pages. Their own markup says where the text
is (article, main; else paragraphs outside menus and the like), and the same texts are set
again in other, generated layouts, in which the places of text, menus, notices, adverts,
forms, side columns and comments are known.

Null pages are empty and give empty text. Pages of any length are read whole; repeated
rows give equal rows; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wanderloop.llm.boosting import BoostParams, Trees, fit_trees
from wanderloop.llm.dom import BLOCKS, SPACES, attribute_words, read_page
from wanderloop.llm.shared import hashed_share, row_schema, unpacked

TRAIN_PAGES = 300
LAYOUTS = 3

TAG_GROUPS = {
    "paragraph": {"p", "blockquote", "pre"}, "heading": {"h1", "h2", "h3", "h4", "h5", "h6"},
    "list": {"ul", "ol", "dl", "menu", "dir"}, "item": {"li", "dt", "dd", "option"},
    "plain": {"div", "section", "center"}, "article": {"article", "main"}, "nav": {"nav"}, "aside": {"aside"},
    "header": {"header"}, "footer": {"footer"}, "form": {"form", "fieldset", "select", "legend", "search"},
    "table": {"table", "tbody", "thead", "tfoot", "tr", "td", "th"}, "page": {"html", "body", "#root"},
    "leaf": {"#text"},
}
# Beginnings of attribute words that name a part of a page (fixed values).
PARTS = {
    "text": ("article", "content", "main", "post", "entry", "story", "body", "text"),
    "menu": ("nav", "menu", "breadcrumb", "pager", "paginat", "toolbar"),
    "top": ("header", "masthead", "logo", "topbar"),
    "bottom": ("footer", "copyright", "legal", "colophon"),
    "side": ("sidebar", "aside", "widget", "rail", "column"),
    "advert": ("ad", "ads", "advert", "promo", "sponsor", "banner"),
    "notice": ("cookie", "notice", "alert", "consent", "popup", "modal", "gdpr", "warning"),
    "form": ("form", "search", "login", "subscri", "newsletter", "signup"),
    "comment": ("comment", "disqus", "repl", "discuss", "respond", "reaction"),
    "social": ("share", "social", "related", "recommend", "tags", "popular", "follow"),
}
_TOKEN = re.compile(r"[a-z]+")


def part_flags(words: str) -> tuple[int, ...]:
    if not words:
        return (0,) * len(PARTS)
    tokens = _TOKEN.findall(words)
    return tuple(
        int(any(t == b or b not in ("ad", "ads") and t.startswith(b) for t in tokens for b in begins)) for begins in PARTS.values()
    )


GROUP_OF = {tag: i for i, tags in enumerate(TAG_GROUPS.values()) for tag in tags}
OTHER_GROUP = GROUP_OF["div"]


class Blocks:
    """The block tree of one page: parallel lists over nodes in page order."""

    def __init__(self, source: str):
        page = read_page(source)
        nodes = page.nodes
        owner = [0] * len(nodes)
        in_link = [False] * len(nodes)
        for i, n in enumerate(nodes):
            up = n.parent
            owner[i] = i if up < 0 or n.tag in BLOCKS else owner[up]
            in_link[i] = n.tag == "a" or up >= 0 and in_link[up]
        # Block elements right under each block, in page order.
        parted: dict[int, list[int]] = {}
        for i, n in enumerate(nodes):
            if n.parent >= 0 and n.tag in BLOCKS:
                parted.setdefault(n.parent, []).append(i)
        # Runs of text with one block above them and no block edge between.
        runs: list[tuple[int, list[str], int, int]] = []
        for at, text in page.texts:
            block = owner[at]
            edge = bisect_left(parted.get(block, ()), at)
            if runs and runs[-1][0] == block and runs[-1][3] == edge:
                runs[-1][1].append(text)
            else:
                runs.append([block, [text], 0, edge])
            if in_link[at]:
                runs[-1][2] += len(text)
        leaves = []
        for block, parts, linked, _ in runs:
            text = SPACES.sub(" ", "".join(parts)).strip()
            if text:
                leaves.append((block, text, min(linked, len(text))))
        count: dict[int, int] = {}
        for block, _, _ in leaves:
            count[block] = count.get(block, 0) + 1
        # Block elements above any text, in page order.
        needed: set[int] = set()
        block_children: dict[int, int] = {}
        for block in count:
            at = block
            while at >= 0 and at not in needed:
                needed.add(at)
                up = nodes[at].parent
                at = owner[up] if up >= 0 else -1
        order = sorted(needed)
        self.index = {b: i for i, b in enumerate(order)}
        self.parent = [self.index[owner[nodes[b].parent]] if nodes[b].parent >= 0 else -1 for b in order]
        for p in self.parent:
            if p >= 0:
                block_children[p] = block_children.get(p, 0) + 1
        self.tags = [nodes[b].tag for b in order]
        self.attrs = [nodes[b].attrs for b in order]
        self.depth = [nodes[b].depth for b in order]
        self.texts: list[tuple[int, str, int]] = []
        for block, text, linked in leaves:
            at = self.index[block]
            if count[block] > 1 or block_children.get(at):
                self.parent.append(at)
                self.tags.append("#text")
                self.attrs.append("")
                self.depth.append(self.depth[at] + 1)
                at = len(self.tags) - 1
            self.texts.append((at, text, linked))
        controls = ("input", "button", "textarea", "select")
        self.controls = [0] * len(self.tags)
        self.elements = [0] * len(self.tags)
        for i, n in enumerate(nodes):
            at = owner[i]
            if at in self.index:
                self.elements[self.index[at]] += 1
                self.controls[self.index[at]] += n.tag in controls

    def features(self) -> np.ndarray:
        n = len(self.tags)
        chars, words, linked, marks, digits, blocks = (np.zeros(n) for _ in range(6))
        first = np.full(n, np.inf)
        ends = np.zeros(n)
        so_far = 0.0
        for at, text, links in self.texts:
            chars[at], linked[at] = len(text), links
            words[at] = text.count(" ") + 1
            marks[at] = text.count(",") + text.count(".")
            digits[at] = "©" in text or "@" in text
            ends[at] = text[-1] in ".!?…"
            blocks[at] = 1
            first[at] = so_far
            so_far += len(text)
        own = chars.copy()
        elements, controls = np.array(self.elements, float), np.array(self.controls, float)
        order = sorted(range(n), key=lambda i: -self.depth[i])
        kids = np.zeros(n)
        longest = words.copy()
        for i in order:
            p = self.parent[i]
            if p >= 0:
                for a in (chars, words, linked, marks, digits, blocks, elements, controls, ends):
                    a[p] += a[i]
                first[p] = min(first[p], first[i])
                longest[p] = max(longest[p], longest[i])
                kids[p] += 1
        flags = np.array([part_flags(attribute_words(a)) for a in self.attrs], float).reshape(n, -1)
        groups = np.array([GROUP_OF.get(t, OTHER_GROUP) for t in self.tags])
        hot = np.zeros((n, len(TAG_GROUPS)))
        hot[np.arange(n), groups] = 1
        above_flags, above_tags, below_flags = np.zeros_like(flags), np.zeros_like(hot), flags.copy()
        for i in order[::-1]:
            p = self.parent[i]
            if p >= 0:
                above_flags[i] = np.maximum(above_flags[p], flags[p])
                above_tags[i] = np.maximum(above_tags[p], hot[p])
        for i in order:
            p = self.parent[i]
            if p >= 0:
                below_flags[p] = np.maximum(below_flags[p], below_flags[i])
        parent = np.array([max(p, 0) for p in self.parent])
        total = max(chars[0] if n else 0, 1)
        c = np.maximum(chars, 1)
        siblings = kids[parent]
        same = np.zeros(n)
        tally: dict[tuple[int, str], int] = {}
        for p, t in zip(self.parent, self.tags):
            tally[p, t] = tally.get((p, t), 0) + 1
        for i, (p, t) in enumerate(zip(self.parent, self.tags)):
            same[i] = tally[p, t]
        stats = np.column_stack([
            np.array(self.depth), np.log1p(words), np.log1p(longest), linked / c, marks / np.maximum(words, 1), digits,
            np.log1p(blocks), elements / c * 100, controls, ends / np.maximum(blocks, 1), c / np.maximum(blocks, 1),
            np.where(np.isfinite(first), first, 0) / total, chars / total, chars / np.maximum(chars[parent], 1),
            np.log1p(siblings), same / np.maximum(siblings, 1), kids, own / c, linked[parent] / np.maximum(chars[parent], 1),
        ])
        return np.concatenate([stats, flags, above_flags, below_flags, hot, above_tags], axis=1)


def choose(parent: list[int], depth: list[int], p: np.ndarray) -> np.ndarray:
    """Kept nodes: the likeliest choice in which everything below a kept node is kept."""
    n = len(parent)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    keep, leave = np.log(p), np.log(1 - p)
    order = sorted(range(n), key=lambda i: -depth[i])
    all_kept, best_left = keep.copy(), leave.copy()
    for i in order:
        if parent[i] >= 0:
            all_kept[parent[i]] += all_kept[i]
            best_left[parent[i]] += max(all_kept[i], best_left[i])
    kept = np.zeros(n, bool)
    for i in order[::-1]:
        kept[i] = parent[i] >= 0 and kept[parent[i]] or all_kept[i] > best_left[i]
    return kept


def main_text(source: str, trees: Trees) -> str:
    blocks = Blocks(source)
    if not blocks.texts:
        return ""
    kept = choose(blocks.parent, blocks.depth, trees.score(blocks.features()))
    return "\n".join(text for at, text, _ in blocks.texts if kept[at])


# What a page's own markup says, for the pages to learn from.
_OUTSIDE = {"nav", "aside", "footer", "header", "form", "select", "search"}
_OUTSIDE_PARTS = [i for i, name in enumerate(PARTS) if name != "text"]


def own_labels(blocks: Blocks) -> list[bool]:
    """Whether each text block is main text by the page's semantic elements."""
    inside, outside = [False] * len(blocks.tags), [False] * len(blocks.tags)
    for i in sorted(range(len(blocks.tags)), key=lambda i: blocks.depth[i]):
        p, tag = blocks.parent[i], blocks.tags[i]
        flags = part_flags(attribute_words(blocks.attrs[i]))
        bad = tag in _OUTSIDE or any(flags[k] for k in _OUTSIDE_PARTS) and not flags[0]
        inside[i] = tag in ("article", "main") or p >= 0 and inside[p]
        outside[i] = bad or p >= 0 and outside[p]
    if any(inside):
        return [inside[at] and not outside[at] for at, _, _ in blocks.texts]
    return [
        not outside[at] and blocks.tags[at] in ("p", "blockquote", "pre", "li", "#text") and text.count(" ") >= 8 and 3 * linked < len(text)
        for at, text, linked in blocks.texts
    ]


def node_labels(blocks: Blocks, wanted: list[bool]) -> np.ndarray:
    """1 where all text of a node is wanted."""
    out = np.ones(len(blocks.tags))
    for (at, _, _), good in zip(blocks.texts, wanted):
        if not good:
            while at >= 0 and out[at]:
                out[at] = 0
                at = blocks.parent[at]
    return out


def layout(body: list[str], spare: list[str], rng: np.random.Generator) -> str:
    """A page in a generated layout; main text stands in elements marked data-k."""
    say = html.escape

    def pick(*options):
        return options[int(rng.integers(len(options)))]

    def some(lo: int, hi: int) -> list[str]:
        return [say(spare[int(rng.integers(len(spare)))]) for _ in range(int(rng.integers(lo, hi + 1)))]

    def short() -> str:
        words = spare[int(rng.integers(len(spare)))].split()
        return say(" ".join(words[:int(rng.integers(1, 6))]))

    def links(n: int) -> str:
        return "".join(f'<li><a href="/x">{short()}</a></li>' for _ in range(n))

    menu = lambda: pick("<nav><ul>{}</ul></nav>", '<div class="menu"><ul>{}</ul></div>', '<ul id="navigation">{}</ul>', '<div class="breadcrumbs"><ul>{}</ul></div>', "<div><ul>{}</ul></div>").format(links(int(rng.integers(3, 9))))
    top = lambda: pick("<header><h1>{0}</h1><p>{1}</p></header>", '<div id="header"><a href="/">{0}</a><p>{1}</p></div>', '<div class="masthead">{0} <span>{1}</span></div>').format(short(), short())
    advert = lambda: pick('<div class="ad">{}</div>', '<div class="advert"><p>{}</p></div>', '<div class="promo">{}</div>', '<div class="sponsored"><p>{}</p></div>', '<div id="banner-ad"><a href="/a">{}</a></div>').format(pick(*some(1, 2)))
    notice = lambda: pick('<div class="cookie-notice"><p>{}</p><button>OK</button></div>', '<div class="notice">{}</div>', '<div role="alert">{}</div>', '<div class="alert"><p>{}</p></div>', '<div id="consent">{} <a href="/p">{}</a></div>').format(pick(*some(1, 1)), short())
    form = lambda: pick("<form><label>{0}</label><input name=q><button>{1}</button></form>", '<form class="newsletter"><p>{0}</p><input type=email><input type=submit></form>', '<div class="login"><form><p>{1}</p><input><input></form></div>').format(short(), short())
    side = lambda: pick("<aside><h3>{0}</h3><ul>{1}</ul><p>{2}</p></aside>", '<div class="sidebar"><h3>{0}</h3><p>{2}</p><ul>{1}</ul></div>', '<div id="right-rail"><div class="widget"><h4>{0}</h4><p>{2}</p></div></div>').format(short(), links(3), pick(*some(1, 1)))
    remarks = lambda: pick('<section id="comments"><h2>{0}</h2>{1}</section>', '<div class="comments">{1}</div>', '<ol class="commentlist">{1}</ol>', '<div id="disqus_thread"><h3>{0}</h3>{1}</div>').format(short(), "".join(pick('<div class="comment"><b>{0}</b><p>{1}</p></div>', '<li class="comment"><p>{1}</p></li>', "<article><h4>{0}</h4><p>{1}</p></article>", "<p>{1}</p>").format(short(), x) for x in some(1, 5)))
    share = lambda: pick('<div class="share"><a href="/s">{0}</a> <a href="/t">{1}</a></div>', '<div class="related"><h3>{0}</h3><ul>{2}</ul></div>', '<ul class="social">{2}</ul>').format(short(), short(), links(3))
    bottom = lambda: pick("<footer>&copy; {0}. {1}</footer>", '<div id="footer"><p>{1}</p><ul>{2}</ul></div>', '<div class="copyright">&copy; {0}</div>', "<footer><p>{1}</p><p>&copy; {0}</p></footer>").format(short(), pick(*some(1, 1)), links(3))

    tag, attrs = pick(("article", ""), ("article", ""), ("main", ""), ("div", 'class="content"'), ("div", 'id="main"'), ("div", 'class="post-body"'), ("div", 'class="entry-content"'), ("section", 'class="story"'), ("div", 'class="article-text"'), ("div", ""), ("div", 'id="page-text"'))
    inner = [f'<{pick("h1", "h2")} data-k>{say(" ".join(body[0].split()[:9]))}</h1>'.replace("</h1>", pick("</h1>", "</h2>"))] if rng.random() < 0.8 else []
    if inner and "<h2" in inner[0]:
        inner[0] = inner[0].replace("</h1>", "</h2>")
    elif inner:
        inner[0] = inner[0].replace("</h2>", "</h1>")
    for text in body:
        inner.append(pick("<p data-k>{}</p>", "<p data-k>{}</p>", "<p data-k>{}", "<p data-k><b>{}</b></p>", "<div data-k>{}</div>", "<blockquote data-k>{}</blockquote>", "<ul data-k><li data-k>{}</li></ul>").format(say(text)))
        if rng.random() < 0.08:
            inner.append(pick(advert, share, form, notice)())
    content = f"<{tag} {attrs}>{''.join(inner)}</{tag}>"
    before = [f() for f in (menu, top, notice, advert, form, side) if rng.random() < 0.4]
    after = [f() for f in (side, share, remarks, form, advert, menu, bottom) if rng.random() < 0.45]
    rng.shuffle(before)
    return f"<html><head><title>{short()}</title></head><body>{''.join(before)}{content}{''.join(after)}</body></html>"


def lessons(source: str, spare: list[str], seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, labels) of a page and of its texts in generated layouts."""
    blocks = Blocks(source)
    wanted = own_labels(blocks)
    if not any(wanted):
        return []
    out = [(blocks.features(), node_labels(blocks, wanted))]
    rng = np.random.default_rng(seed)
    body = [text for (at, text, _), good in zip(blocks.texts, wanted) if good and blocks.tags[at] not in TAG_GROUPS["heading"]]
    for _ in range(LAYOUTS if body and spare else 0):
        start = int(rng.integers(len(body)))
        made = Blocks(layout(body[start:start + int(rng.integers(1, 9))], spare, rng))
        marked = [False] * len(made.tags)
        for i, (a, p) in enumerate(zip(made.attrs, made.parent)):
            marked[i] = "data-k" in a or made.tags[i] == "#text" and p >= 0 and marked[p]
        out.append((made.features(), node_labels(made, [marked[at] for at, _, _ in made.texts])))
    return out


def fit_extractor(pages: DataFrame, page: str = "html", key: str = "page_id", rows: int = TRAIN_PAGES) -> Trees:
    """Trees learnt from at most ``rows`` pages, one for each id, in order of a hash of the id."""
    known = pages.select(F.col(page).alias("html"), F.col(key).cast("string").alias("key")).dropna()
    ids = hashed_share(known.select("key").distinct(), F.col("key"), rows).orderBy(F.xxhash64("key"), "key").take(rows)
    small = pages.sparkSession.createDataFrame([(r["key"],) for r in ids], "key string")
    picked = known.join(F.broadcast(small), "key").groupBy("key").agg(F.min("html").alias("html")).toArrow()
    sources = picked.sort_by("key")["html"].to_pylist()
    texts = [[t for _, t, _ in Blocks(s).texts] for s in sources]
    x, y = [], []
    for i, source in enumerate(sources):
        spare = [t for k in range(1, 4) for t in texts[(i + k) % len(texts)]]
        for a, b in lessons(source, spare, i):
            x.append(a)
            y.append(b)
    if not x:
        return fit_trees(np.zeros((0, 1)), np.zeros(0))
    return fit_trees(np.concatenate(x), np.concatenate(y), BoostParams(trees=40, depth=4, rate=0.3, bins=32))


def extract(pages: DataFrame, trees: Trees, page: str = "html", text: str = "text") -> DataFrame:
    """The rows without the page but with its main text; a column of that name is replaced."""
    def run(batches):
        for batch in batches:
            found = [main_text(s or "", trees) for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.string())], names=["_row", "_out"])

    slim = pages.select(*[pages[f"`{c}`"] for c in pages.columns if c != page])
    rows = packed_beside(pages, slim, page).mapInArrow(run, row_schema(slim, "_out string"))
    return unpacked(rows, slim.columns, F.col("_out").alias(text), names=(text,))


def packed_beside(pages: DataFrame, slim: DataFrame, page: str) -> DataFrame:
    """The page, and the other columns of its row as one struct."""
    return pages.select(F.col(page).alias("_page"), F.struct(*[pages[f"`{c}`"] for c in slim.columns]).alias("_row"))
