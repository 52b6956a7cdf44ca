"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from math import e, log

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without content, elements whose content is no markup, and elements that start a block.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
BLOCKS = frozenset((
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li",
    "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
))
# An open element of the first kind ends where one of the second starts, unless a third lies between.
ENDED_BY = {
    "p": (BLOCKS - {"body", "caption", "html", "tbody", "td", "tfoot", "th", "thead", "tr"}, ("td", "th", "button", "caption", "object")),
    "li": (frozenset(("li",)), ("ul", "ol")),
    "dt": (frozenset(("dt", "dd")), ("dl",)),
    "dd": (frozenset(("dt", "dd")), ("dl",)),
    "td": (frozenset(("td", "th", "tr", "tbody", "tfoot", "thead")), ("table",)),
    "th": (frozenset(("td", "th", "tr", "tbody", "tfoot", "thead")), ("table",)),
    "tr": (frozenset(("tr", "tbody", "tfoot", "thead")), ("table",)),
    "option": (frozenset(("option", "optgroup")), ("select",)),
}
# Elements and names of page furniture.
FURNITURE_TAGS = frozenset((
    "aside", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "iframe", "input", "menu", "nav", "noembed", "noframes",
    "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title",
))
FURNITURE_NAMES = frozenset((
    "ad", "ads", "adsense", "advert", "advertisement", "advertising", "adverts", "alert", "aside", "banner", "breadcrumb", "breadcrumbs",
    "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "discussion", "disqus", "disclaimer",
    "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "pager", "pagination", "popup", "promo", "promoted", "promotion", "related", "replies", "respond", "search", "share", "sharing",
    "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget",
))
REPLY_NAMES = frozenset(("comment", "comments", "discussion", "disqus", "replies", "respond"))
# Words that go along with those in names, so that related-posts is furniture and related-work or search-algorithms is not.
BESIDE_NAMES = frozenset((
    "area", "bar", "block", "bottom", "box", "btn", "button", "buttons", "container", "content", "customer", "form", "group", "header", "inner", "js", "left", "link",
    "links", "list", "main", "media", "message", "more", "post", "posts", "primary", "reader", "right", "secondary", "section", "site", "stories", "top", "user", "wrap", "wrapper",
))
# Names of what readers wrote below the text, of its whole name only.
READER_NAMES = frozenset(("feedback", "opinions", "reviews"))
# Names of elements that hold the whole main text, elements that are text beside it, and elements nobody reads.
CONTENT_NAMES = frozenset(("article", "content", "entry", "main", "post", "story"))
TEXT_ELEMENTS = frozenset(("blockquote", "dl", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "ol", "p", "pre", "table", "ul"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
UNREAD = RAW | frozenset(("head", "noscript", "select", "svg", "template"))

_MARK = re.compile(
    r"""<(?:!--(?:.*?-->|.*)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>))""", re.DOTALL)
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)|\b(hidden)\b(?!\s*=\s*"?false)|aria-hidden\s*=\s*"?(true)""", re.I)
_ENDS = {
    tag: [(ended, stops) for ended, (starts, stops) in ENDED_BY.items() if tag in starts]
    for tag in set().union(*(starts for starts, _ in ENDED_BY.values()))
}
_PARTS = re.compile(r"[a-z0-9]+").findall


class Tree:
    """Nodes in page order. Node 0 is the page; a node lies before its children."""

    def __init__(self):
        self.tag, self.parent, self.names, self.text = ["#page"], [-1], [frozenset()], []

    def add(self, tag: str, parent: int, names: frozenset) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.names.append(names)
        return len(self.tag) - 1


def _names_of(attributes: str) -> frozenset:
    if "=" not in attributes and "hidden" not in attributes:
        return frozenset()
    found = set()
    for kind, value, hidden, aria in _NAMES.findall(attributes):
        low = value.lower()
        found.update(_PARTS(low))
        for name in low.strip("\"'").split():
            parts = set(_PARTS(name))
            if parts & (FURNITURE_NAMES | READER_NAMES) and parts <= FURNITURE_NAMES | READER_NAMES | BESIDE_NAMES:
                found.add("#id-furniture" if kind.lower() == "id" else "#furniture")
                if kind.lower() == "id" and parts & REPLY_NAMES - {"discussion"}:
                    found.add("#furniture")
        if hidden or aria:
            found.add("#hidden")
    return frozenset(found)


def parse(page: str) -> Tree:
    """Tree of any page, well formed or not. ``text`` holds (node, text) with references decoded, and (node, None) for breaks."""
    tree, open_, at = Tree(), [0], 0
    tags, end = tree.tag, len(page)
    # where the open elements of each tag lie in the stack, so that it is not searched for what is not open
    places: dict[str, list[int]] = {}

    def opened(node: int) -> None:
        places.setdefault(tags[node], []).append(len(open_))
        open_.append(node)

    def shut(depth: int) -> None:
        for node in open_[depth:]:
            places[tags[node]].pop()
        del open_[depth:]

    while at < end:
        mark = _MARK.search(page, at)
        stop = mark.start() if mark else end
        if stop > at:
            tree.text.append((open_[-1], html.unescape(page[at:stop])))
        if not mark:
            break
        at = mark.end()
        if mark[2] is None:
            continue
        tag = mark[2].lower()
        if mark[1]:
            if places.get(tag):
                shut(places[tag][-1])
            continue
        for ended, stops in _ENDS.get(tag, ()):
            if not places.get(ended) or max((places[s][-1] for s in stops if places.get(s)), default=0) > places[ended][-1]:
                continue
            for depth in range(len(open_) - 1, 0, -1):
                inside = tags[open_[depth]]
                if inside == ended:
                    shut(depth)
                if inside == ended or inside in stops:
                    break
        node = tree.add(tag, open_[-1], _names_of(mark[3]))
        if tag in VOID:
            tree.text.append((node, None))
        elif tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            at = close.start() if close else end
            opened(node)
            if not close:
                break
        elif not mark[3].endswith("/>"):
            opened(node)
    return tree


def _most_text(tree: Tree) -> list[bool]:
    """Nodes that hold more than half of the page's text outside links."""
    n = len(tree.tag)
    unread = [False] * n
    for i in range(1, n):
        unread[i] = unread[tree.parent[i]] or tree.tag[i] == "a" or tree.tag[i] in UNREAD
    held = [0] * n
    for node, text in tree.text:
        if text and not unread[node]:
            held[node] += len(" ".join(text.split()))
    for i in range(n - 1, 0, -1):
        held[tree.parent[i]] += held[i]
    return [2 * h > held[0] for h in held]


def _linked(tree: Tree) -> list[bool]:
    """Nodes most of whose text is links."""
    n = len(tree.tag)
    in_link, held, links = [False] * n, [0] * n, [0] * n
    for i in range(1, n):
        in_link[i] = in_link[tree.parent[i]] or tree.tag[i] == "a"
    for node, text in tree.text:
        if text:
            size = len(" ".join(text.split()))
            held[node] += size
            links[node] += size * in_link[node]
    for i in range(n - 1, 0, -1):
        held[tree.parent[i]] += held[i]
        links[tree.parent[i]] += links[i]
    return [2 * l > h for l, h in zip(links, held)]


def _furniture(tree: Tree) -> list[bool]:
    """Nodes that are furniture by element or name, or lie inside one.

    A form or a named wrapper that holds the head of the text or most of the page's text is the page, not furniture. Replies may
    well be longer than what they reply to: they are spared only where nothing else heads the page. Inside an article a name has to be
    one of furniture as a whole; an id alone, as headings and sections have it to be linked to, counts only for what mostly consists of
    links, and never for headings, paragraphs, tables and their like.
    """
    n = len(tree.tag)
    holds_head = [t in ("h1", "main") or t == "article" and not names & FURNITURE_NAMES for t, names in zip(tree.tag, tree.names)]
    for i in range(n - 1, 0, -1):
        if holds_head[i]:
            holds_head[tree.parent[i]] = True
    most, linked = _most_text(tree), _linked(tree)
    inside_article, out = [False] * n, [False] * n
    for i in range(1, n):
        tag, up, names = tree.tag[i], tree.parent[i], tree.names[i]
        inside_article[i] = inside_article[up] or tag in ("article", "main")
        spared = holds_head[i] or most[i] and not (names & REPLY_NAMES and holds_head[0])
        if inside_article[up]:
            by_id = "#id-furniture" in names and tag not in TEXT_ELEMENTS and linked[i]
            named = "#furniture" in names and not (tag in HEADINGS) or by_id
        else:
            named = bool(names & FURNITURE_NAMES) or "#furniture" in names
        named = named and tag not in ("html", "body", "main") and not spared
        header = (tag == "header" or "header" in names) and not inside_article[i] and not spared
        element = tag in FURNITURE_TAGS and not (tag == "form" and spared)
        out[i] = out[up] or element or named or header or "#hidden" in names and not holds_head[i]
    return out


def densities(tree: Tree, out: list[bool]) -> tuple[list[float], list[float], list[bool]]:
    """Composite density of every node, the sum over its children, and whether most of its text is links. Furniture has none.

    Only blocks are added up: a word in bold is no part that a text consists of, though its mark counts.
    """
    n = len(tree.tag)
    chars, link_chars, marks, links = [0] * n, [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = in_link[tree.parent[i]] or tree.tag[i] == "a"
    page_chars = page_links = 0
    for node, text in tree.text:
        if text:
            size = len(" ".join(text.split()))
            if tree.tag[node] not in RAW:
                page_chars += size
                page_links += size * in_link[node]
            if not out[node]:
                chars[node] += size
                link_chars[node] += size * in_link[node]
    for i in range(n - 1, 0, -1):
        if not out[i]:
            up = tree.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            marks[up] += marks[i] + 1
            links[up] += links[i] + (tree.tag[i] == "a")
    share = page_links / max(1, page_chars)
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if out[i] or not chars[i]:
            continue
        c, lc = chars[i], link_chars[i]
        base = log(c / max(1, c - lc) * lc + share * c + e)
        ratio = c / max(1, lc) * max(1, marks[i]) / max(1, links[i])
        density[i] = max(0.0, c / max(1, marks[i]) * log(max(1.0, ratio)) / log(max(e, base)))
        if i and tree.tag[i] in BLOCKS:
            total[tree.parent[i]] += density[i]
    return density, total, [2 * lc > c for c, lc in zip(chars, link_chars)]


def main_nodes(tree: Tree, out: list[bool]) -> list[bool]:
    """The main text: dense subtrees from the body down, and what belongs to them.

    The smallest density on the path from the subtree with the greatest sum of child densities up to the body is the threshold. From
    the body down, as long as nodes reach it, each gives the subtree with the greatest sum inside it. The first one is
    taken with the whole article, main or content element it lies in, and text elements beside any of them (headings, short
    paragraphs) belong to it unless most of their text is links.
    """
    density, total, linked = densities(tree, out)
    n = len(tree.tag)
    # What is best inside each node: the greatest sum, then the greatest density, then the first.
    inside = list(range(n))
    for i in range(n - 1, 0, -1):
        up = tree.parent[i]
        if not out[i] and (total[inside[i]], density[inside[i]], -inside[i]) > (total[inside[up]], density[inside[up]], -inside[up]):
            inside[up] = inside[i]
    best = inside[0]
    if not total[best] and not density[best]:
        best = 0
    up, threshold, top = best, density[best], best
    while up > 0 and tree.tag[up] != "body":
        if tree.tag[up] in ("article", "main") or tree.names[up] & CONTENT_NAMES:
            top = up
        up = tree.parent[up]
        threshold = min(threshold, density[up])
    reached, heads = [False] * n, {top}
    for i in range(up, n):
        reached[i] = not out[i] and density[i] >= threshold and (i == up or reached[tree.parent[i]])
        if reached[i] and (i == up or tree.tag[i] in BLOCKS):
            heads.add(inside[i])
    beside = {tree.parent[i] for i in heads if i != up}
    chosen = [False] * n
    for i in range(n):
        part = i in heads or tree.parent[i] in beside and tree.tag[i] in TEXT_ELEMENTS and not linked[i]
        chosen[i] = not out[i] and (part or i > 0 and chosen[tree.parent[i]])
    return chosen


def main_text(page: str | None) -> str:
    """Blocks of the main text, white space inside one a single space, joined by an empty line."""
    if not page:
        return ""
    tree = parse(page)
    out = _furniture(tree)
    chosen = main_nodes(tree, out)
    block_of = list(range(len(tree.tag)))
    for i in range(1, len(block_of)):
        if tree.tag[i] not in BLOCKS:
            block_of[i] = block_of[tree.parent[i]]
    # A block goes on after an inner block as a new one: what was shown last tells whether the text continues.
    blocks, current, last = [], [], None
    for node, text in tree.text:
        block = block_of[node]
        if block != last:
            blocks.append("".join(current))
            current, last = [], block
        if chosen[node]:
            current.append(" " if text is None else text)
    blocks.append("".join(current))
    return "\n\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def text_of(page: Column) -> Column:
    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(p if isinstance(p, str) else None) for p in part], dtype=object)

    return extract(page)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row; no shuffle.

    A NULL or empty page and one without text give an empty text. Any markup is read, whatever is open or missing. Repeated
    rows are answered each; other columns are not read.
    """
    found = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_of(F.col(page)).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))
