"""Main text of web pages by scoring the tree of elements."""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML by their part here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An open element of the left kind ends where one of the right kinds begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
#: Elements that are never main text.
OUT = frozenset("head nav footer aside form script style noscript template iframe button select textarea input svg math object canvas dialog menu search title video audio".split())
#: Words in class, id or role that mark what is not main text; a header is one only outside an article.
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs combx comment comments commentlist complementary contentinfo cookie "
    "cookies consent disqus footer footnav gdpr hidden legal login masthead menu menubar modal nav navbar navigation newsletter notice notices notification "
    "pager pagination popup promo promotion related remark replies search share sharing shoutbox sidebar sidenav signup skyscraper social sponsor sponsored "
    "subscribe tags toolbar tracking widget".split())
MAIN_WORDS = frozenset("article body content entry main page post story text".split())
#: Words of a container that holds a whole article, and of one that does if no other is marked.
WHOLE_WORDS, PART_WORDS = frozenset("article entry post story".split()), frozenset("content main".split())
FENCES = ("ul", "ol", "dl", "table", "menu")
PARAGRAPHS = frozenset("p pre blockquote li dd dt td th figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl div section table".split())
#: Points of a text for its length (one per CHARS, at most MOST), for being no scrap, and what siblings need.
CHARS, MOST, SCRAP, SIBLING, LINKED = 100, 3.0, 25, 0.2, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^<>]*(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class _Tree:
    """Elements in page order with their parents, and the texts of blocks."""

    def __init__(self) -> None:
        self.tag, self.parent, self.out, self.weight, self.block = ["html"], [-1], [False], [0], [0]
        self.inside = [False]  # in an article or main element
        self.whole = [0]  # 2: named as a whole article, 1: named as a part of the page that may hold one
        self.pieces: list[tuple[int, int, str, bool]] = []  # block number, block element, text, within a link

    def add(self, tag: str, parent: int, attributes: dict[str, str]) -> int:
        words = {w.lower() for k in ("class", "id", "role") for w in _WORD.findall(attributes.get(k, ""))}
        out = self.out[parent] or tag in OUT or bool(words & OUT_WORDS) or "hidden" in attributes or attributes.get("aria-hidden") == "true"
        out = out or "display:none" in attributes.get("style", "").replace(" ", "").lower() or ((tag == "header" or "header" in words) and not self.inside[parent])
        if tag in ("body", "html", "article", "main"):  # these hold the page whatever they are called
            out = self.out[parent]
        self.tag.append(tag)
        self.parent.append(parent)
        self.out.append(out)
        self.weight.append(25 if tag in ("article", "main") else 10 if words & MAIN_WORDS else 0)
        self.whole.append(2 if words & WHOLE_WORDS else 1 if words & PART_WORDS else 0)
        self.inside.append(self.inside[parent] or tag in ("article", "main"))
        self.block.append(len(self.tag) - 1 if tag in BLOCKS else self.block[parent])
        return len(self.tag) - 1


class _Open:
    """Open elements from the outermost in, and at which depths each kind stands."""

    def __init__(self, tree: _Tree) -> None:
        self.tree, self.stack, self.depths, self.blocks = tree, [0], defaultdict(list), []

    def push(self, node: int) -> None:
        tag = self.tree.tag[node]
        self.depths[tag].append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def close(self, depth: int) -> bool:
        """Close all from a depth on; whether a block was among them."""
        before = len(self.blocks)
        while len(self.stack) > depth:
            tag = self.tree.tag[self.stack.pop()]
            self.depths[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
        return len(self.blocks) < before

    def last(self, tag: str) -> int:
        return self.depths[tag][-1] if self.depths[tag] else 0

    def first_after(self, tag: str, depth: int) -> int | None:
        """The outermost open element of a kind below a depth."""
        found = self.depths[tag]
        k = bisect_right(found, depth)
        return found[k] if k < len(found) else None


def parse(page: str) -> _Tree:
    """Tree of a page as browsers read it in the main: implied ends of paragraphs and items, stray ends, raw elements."""
    tree, number, at = _Tree(), 0, 0
    opened, length = _Open(tree), len(page)

    def say(text: str) -> None:
        if text:
            tree.pieces.append((number, opened.stack[-1], html.unescape(text) if "&" in text else text, bool(opened.depths["a"])))

    while at < length:
        token = _TOKEN.search(page, at)
        say(page[at : token.start() if token else length])
        if token is None:
            break
        at, source = token.end(), token.group(0)
        named = _NAME.match(source)
        if named is None:
            if source.startswith("<![CDATA["):
                say(source[9:].removesuffix("]]>"))
            continue
        tag = named.group(1).lower()
        if source[1] == "/":
            depth = opened.last(tag)
            if tag == "p" and not depth:
                number += 1
            elif depth and (tag in BLOCKS or not opened.blocks or opened.blocks[-1] <= depth):  # an inline end does not close blocks
                number += opened.close(depth)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in BLOCKS or tag in ENDS:
            number += 1
            # an item ends only within its own list, a cell within its own table
            fence = max(map(opened.last, FENCES))
            kinds = [k for k, enders in ENDS.items() if tag in enders] + ["p"] * (tag in CLOSES_P)
            ends = [d for k in kinds if (d := opened.first_after(k, fence)) is not None]
            if ends:
                opened.close(min(ends))
        if tag in VOID:
            continue
        attributes = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in _ATTRIBUTE.findall(source, named.end(), len(source) - 1)} if len(source) > named.end() + 1 else {}
        if tag == "html":
            continue
        node = tree.add(tag, opened.stack[-1], attributes)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
            at = close.end() if close else length
            number += tag in BLOCKS
        elif not source.endswith("/>") or tag in BLOCKS or tag == "a":
            opened.push(node)
    return tree


def _whole(tree: _Tree, best: int) -> int:
    """The container of the whole article around the best one: the nearest article, else main, else the outermost element
    named as an article, else the nearest one named as content; else the best one itself."""
    up = []
    while best >= 0:
        up.append(best)
        best = tree.parent[best]
    for found in ([k for k in up if tree.tag[k] == "article"][:1], [k for k in up if tree.tag[k] == "main"][:1], [k for k in up if tree.whole[k] == 2 and tree.tag[k] != "body"][-1:], [k for k in up if tree.whole[k] == 1 and tree.tag[k] != "body"][:1]):
        if found:
            return found[0]
    return up[0]


def main_text(page: str | None) -> str:
    """The main text of a page: blocks of the article around the best container and of its kept siblings, one line each.

    Paragraphs pass points for length and commas to their parent, half to the next, a third over the level beyond; a
    container's points are discounted by the share of its text in links. Within an article or main element lists of links
    are kept as text (references); elsewhere a list, table or container of links inside the best one is dropped.
    """
    tree = parse(page or "")
    n = len(tree.tag)
    texts: dict[tuple[int, int], list] = {}
    for number, node, text, linked in tree.pieces:
        if not tree.out[node]:
            block = texts.setdefault((number, tree.block[node]), [[], 0])
            block[0].append(text)
            block[1] += len(text.strip()) * linked
    blocks = [(k, node, " ".join("".join(parts).split()), linked) for (k, node), (parts, linked) in sorted(texts.items(), key=lambda x: x[0][0])]
    blocks = [b for b in blocks if b[2]]
    score, size, linked_size = [0.0] * n, [0] * n, [0] * n
    for _, node, text, linked in blocks:
        size[node] += len(text)
        linked_size[node] += min(linked, len(text))
        if tree.tag[node] in HEADINGS:
            continue
        points = (min(MOST, len(text) / CHARS) + text.count(",") + (len(text) >= SCRAP)) * (1 - min(1.0, linked / len(text)))
        to = tree.parent[node] if tree.tag[node] in PARAGRAPHS and node else node
        for level in range(6):
            if to < 0:
                break
            score[to] += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            to = tree.parent[to]
    for k in range(n - 1, 0, -1):
        size[tree.parent[k]] += size[k]
        linked_size[tree.parent[k]] += linked_size[k]
    density = [linked_size[k] / size[k] if size[k] else 0.0 for k in range(n)]
    final = [(score[k] + tree.weight[k] * (score[k] > 0)) * (1 - density[k]) for k in range(n)]
    best = max(range(n), key=lambda k: (final[k], -k))
    keep = [False] * n
    if final[best] <= 0:
        keep[0] = True
    else:
        root = _whole(tree, best)
        keep[root] = True
        own = [k for k in range(n) if tree.parent[k] == tree.parent[root] and k != root and not tree.out[k]] if root else []
        for k in own:
            text_like = tree.tag[k] in PARAGRAPHS and (size[k] > 80 and density[k] < 0.25 or 0 < size[k] <= 80 and linked_size[k] == 0)
            title = tree.tag[k] in HEADINGS and k < root and linked_size[k] == 0 and tree.tag[root] not in ("article", "main")
            keep[k] = final[k] >= max(10.0, SIBLING * final[best]) or text_like or title
    roots = list(keep)
    for k in range(1, n):
        linky = tree.tag[k] in LISTS and size[k] and density[k] > LINKED and not roots[k] and not tree.inside[k]
        keep[k] = (keep[k] or keep[tree.parent[k]]) and not linky
    return "\n".join(text for _, node, text, _ in blocks if keep[node])


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[["page_id", "url"]].assign(text=[main_text(h) for h in pdf.html])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row (page_id, url, html); other columns are not looked at.

    The whole html is read; null and empty html have an empty text. Rows that share a page_id are rows of their own.
    """
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
