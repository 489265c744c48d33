"""Main-text extraction from web pages by tag-path ratios.

A page is read once, in time linear in its length, into a tree of elements and into blocks: the text between
block-level tags, each with its root-to-leaf tag path. A path's steps are tags with the words of their class, id and
role, so unlike parts of a page have unlike paths; paths are nodes of a trie, so nothing is kept twice for deep pages.
For each path, the text length, the punctuation and the text in links of its blocks are summed. Length and punctuation
are divided by the number of nodes on that path, smoothed along the page and fused into one ratio, which the share of
text that is no link discounts. Paths whose ratio is below ``KEEP`` of the page's mean are dropped. The threshold is
fitted on pages whose parts carry no telling tag or word at all. Short blocks (headings, list items) that stand in the
same container as the kept ones are kept as well.

What the ratios are given besides:

* Elements that are never main text by their tag (scripts, menus, footers, asides, controls) are left out with all below
  them; so is a ``header`` right under body, and ``form`` unless the page's article lies within it.
* A class, id or role with a word of ``MARKS`` (adverts, comments, notices and the like) leaves an element out, unless
  it holds most of the page's text (and stands in the page's article or main, if there is one with text outside such
  elements). If nothing is left, no mark counts.
* Paths under a word of ``DOUBTFUL`` count ``DOUBT`` of their ratio, those under a word of ``WEAK`` as well, but half of
  it within an article or main element; where article and main elements hold most of the text, paths outside them count
  ``OUTSIDE`` of theirs. The page's mean is taken of the ratios that result, so a word that stands on all of a page's
  text changes nothing. Blocks of doubtful paths are not kept for the sake of their container.

Defined cases: null and empty pages, and pages without main text, give an empty text; hidden elements are text as any
other; broken markup is read as far as it goes (an unclosed element ends with its parent, an unclosed quote is no quote,
an unclosed comment or script takes the rest, and head ends at the first text or tag that cannot stand in it); repeated
rows give the same text each; an empty table gives an empty result; further columns of any name are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

from qanat.llm.words import slices
from qanat.session import text_batches

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea iframe svg noembed noframes annotation annotation-xml title".split())
#: Elements whose content is never main text.
NEVER = frozenset("head nav footer aside menu button select option label dialog".split())
#: Elements that name the main text.
WHOLE = frozenset(("article", "main"))
#: What can stand in head; any other start tag ends an open head.
IN_HEAD = frozenset("head base basefont bgsound link meta title noscript noframes style script template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "math semantics mi mn mo ms mtext mrow mfrac msqrt mroot msup msub msubsup munder mover munderover mtable mtr mtd mstyle mpadded mphantom menclose mspace".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the key ends an open element of the value, up to the nearest of its bounds.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), **dict.fromkeys(HEADINGS, tuple(HEADINGS))}
BOUNDS = frozenset("ul ol dl table body html article section div main".split())
#: Words of a class, id or role that mark what is not main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice notices newsletter "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager masthead footer sidebar comment comments disqus contentinfo complementary".split()
)
#: Words that seldom, and words that may as well, stand on main text.
DOUBTFUL = frozenset(
    "promo promotion popup modal overlay subscribe subscription signup login toc related recommended sharing social "
    "reply replies respond response responses feedback discussion cookiebar topnav subnav sitenav topbar".split()
)
WEAK = frozenset("banner header foot widget share search skip copyright".split())
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What ends a tag, or opens a quoted value.
STOP = re.compile(r""">|=\s*(["'])""")
MARKED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
PUNCTUATION = re.compile(r"[.,;:!?…、。，；：！？¿¡،؛؟]")
#: Share of the mean ratio, weighted by text, that a path must reach; weight of a block's neighbours in smoothing.
KEEP, NEIGHBOUR = 0.6, 0.25
#: What doubtful paths' ratios count, what a weak word's path within an article does, and paths outside the page's article.
DOUBT, WITHIN, OUTSIDE = 0.1, 0.5, 0.1

_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.IGNORECASE) for t in RAW}


ROLE = re.compile(r"""role\s*=\s*["']?banner""", re.IGNORECASE)


def words_of(attributes: str) -> set[str]:
    return {w for m in MARKED.finditer(attributes) for w in re.split(r"[^a-z]+", next(filter(None, m.groups()), "").lower())}


class Page:
    """A page's elements, numbered in page order, and its blocks.

    An element has the numbers of its parent and path, its tag, whether it lies in an article or main, whether it is
    left out or marked, and what its path's ratio counts for doubtful words. A block is its element's number and (text,
    element's number, whether it is a link's) pieces.
    """

    def __init__(self, page: str):
        self.page = page
        self.parent, self.tag, self.path, self.whole = [-1], [""], [0], [False]
        self.never, self.marked, self.counts = [False], [False], [1.0]
        self.paths: dict[tuple[int, str, tuple[str, ...]], int] = {}
        self.blocks: list[tuple[int, list[tuple[str, int, bool]]]] = []
        self.link = 0  # the place on the stack that an open link ends with
        self.stack = [0]
        self.nested = [0]  # of a marked inline element on the stack: start tags of its kind in it
        self.open_at: dict[str, list[int]] = {}  # by tag: places on the stack
        self.bounds = [0]
        self.text: list[tuple[str, int, bool]] = []
        self.unclosed: set[str] = set()  # quotes and tags that nothing closes from here on
        self.read()

    def push(self, tag: str, attributes: str) -> None:
        up, words = self.stack[-1], words_of(attributes) if "=" in attributes else set()
        holder = tag in ("html", "body") or tag in WHOLE
        step = (self.path[up], tag, tuple(sorted(words - {""})))
        weak = WITHIN if self.whole[up] else DOUBT
        counts = 1.0 if holder else DOUBT if words & DOUBTFUL else weak if words & WEAK else 1.0
        self.parent.append(up)
        self.tag.append(tag)
        self.path.append(self.path[up] if tag in INLINE else self.paths.setdefault(step, len(self.paths) + 1))
        self.whole.append(self.whole[up] or tag in WHOLE)
        self.never.append(self.never[up] or tag in NEVER or tag == "header" and self.tag[up] in ("", "html", "body"))
        self.marked.append(not holder and (not words.isdisjoint(MARKS) or bool(ROLE.search(attributes))))
        self.counts.append(min(counts, self.counts[up]))
        self.open_at.setdefault(tag, []).append(len(self.stack))
        if tag in BOUNDS:
            self.bounds.append(len(self.stack))
        self.stack.append(len(self.tag) - 1)
        self.nested.append(0)

    def flush(self) -> None:
        """The text so far is a block of the innermost element."""
        if any(t and not t.isspace() for t, _, _ in self.text):
            at = len(self.stack) - 1
            while self.tag[self.stack[at]] in INLINE:
                at -= 1
            self.blocks.append((self.stack[at], self.text))
        self.text = []

    def shut(self, depth: int) -> None:
        """Ends the elements from a place on the stack on, and the link that was opened in one of them."""
        self.link = self.link if depth >= self.link else 0
        if any(self.tag[n] not in INLINE for n in self.stack[depth:]):
            self.flush()
        while len(self.stack) > depth:
            tag = self.tag[self.stack.pop()]
            self.nested.pop()
            self.open_at[tag].pop()
            if tag in BOUNDS:
                self.bounds.pop()

    def end_head(self) -> None:
        if self.open_at.get("head"):
            self.shut(self.open_at["head"][0])

    def tag_end(self, at: int) -> int:
        """Where the tag ends that is open at a place; -1 if it does not."""
        while m := STOP.search(self.page, at):
            if not (quote := m[1]):
                return m.end()
            at = m.end()
            if quote not in self.unclosed:
                close = self.page.find(quote, at)
                if close < 0:
                    self.unclosed.add(quote)
                else:
                    at = close + 1
        return -1

    def read(self) -> None:
        page, at, last = self.page, 0, self.page.rfind(">")
        while at < len(page):
            lt = page.find("<", at)
            while 0 <= lt < last and not (page[lt + 1] in "!?" or page[lt + 1].isalpha() or page[lt + 1] == "/" and page[lt + 2].isalpha()):
                lt = page.find("<", lt + 1)  # a sign, no tag
            if page.startswith("<!--", lt if lt >= 0 else len(page)):
                end = page.find("-->", lt + 4)
                end = end + 3 if end >= 0 else len(page)
            elif not 0 <= lt < last:
                lt = end = len(page)
            elif page[lt + 1] in "!?":
                end = page.find("]]>", lt) + 3 if page.startswith("<![CDATA[", lt) else page.find(">", lt) + 1
                end = end if end > lt else page.find(">", lt) + 1
            elif (end := self.tag_end(lt)) < 0:
                end = page.find(">", lt) + 1
            self.add_text(page[at:lt])
            at = self.add_tag(lt, end) if lt < len(page) and page[lt + 1] not in "!?" else end
        self.shut(1)
        self.flush()

    def add_text(self, text: str) -> None:
        if not text:
            return
        if self.tag[self.stack[-1]] == "head" and not text.isspace():
            self.end_head()
        if not self.never[self.stack[-1]]:
            self.text.append((html.unescape(text), self.stack[-1], self.link > 0))

    def add_tag(self, lt: int, end: int) -> int:
        """Takes the tag in; where to read on."""
        ends = self.page[lt + 1] == "/"
        name = NAME.match(self.page, lt + 1 + ends)
        tag, attributes = name[0].lower(), self.page[name.end() : end - 1]
        if tag in INLINE:
            self.add_inline(tag, attributes, ends)
            self.link = self.link if tag != "a" else 0 if ends else len(self.stack)
            return end
        if ends:
            if places := self.open_at.get(tag):
                self.shut(places[-1])
            return end
        if tag not in IN_HEAD:
            self.end_head()
        if tag == "br":
            self.add_text(" ")
        elif tag == "hr":
            self.flush()
        if tag in VOID:
            return end
        if tag in RAW:
            if attributes.endswith("/") and tag == "svg":
                return end
            close = None if tag in self.unclosed else _CLOSE[tag].search(self.page, end)
            if close:
                return close.end()
            self.unclosed.add(tag)
            return end if tag == "title" else len(self.page)
        closes = [self.open_at[t][-1] for t in ("p", *ENDS.get(tag, ())) if self.open_at.get(t)]
        if closes and max(closes) > self.bounds[-1]:
            self.shut(min(c for c in closes if c > self.bounds[-1]))
        self.flush()
        self.push(tag, attributes)
        return end

    def add_inline(self, tag: str, attributes: str, ends: bool) -> None:
        """Inline elements are elements of their own only where they are marked."""
        top = self.stack[-1]
        if self.tag[top] == tag:
            if not ends:
                self.nested[-1] += 1
            elif self.nested[-1]:
                self.nested[-1] -= 1
            else:
                self.shut(len(self.stack) - 1)
        elif not ends:
            self.end_head()
            if "=" in attributes and not words_of(attributes).isdisjoint(MARKS):
                self.push(tag, attributes)

    def left_out(self) -> list[bool]:
        """Of each element, whether it is left out by a mark on it or above, or as a form; see the top of this file."""
        n = len(self.tag)
        size, named = [0] * n, [t in WHOLE or t in HEADINGS for t in self.tag]
        for _, pieces in self.blocks:
            for text, node, _ in pieces:
                size[node] += sum(map(len, text.split()))
        bare = [False] * n  # under a mark
        for i in range(1, n):
            bare[i] = bare[self.parent[i]] or self.marked[i]
        main = any(size[i] and self.whole[i] and not bare[i] for i in range(n))
        for i in range(n - 1, 0, -1):
            size[self.parent[i]] += size[i]
            named[self.parent[i]] = named[self.parent[i]] or named[i]
        out = [False] * n
        for i in range(1, n):
            most = 2 * size[i] > size[0]
            own = self.marked[i] and not (most and (self.whole[i] or not main)) or self.tag[i] == "form" and not (most and named[i])
            out[i] = out[self.parent[i]] or own
        return out

    def texts(self) -> list[tuple[str, int, float]]:
        """(text, element, share of it in links) of the blocks that hold text outside elements that are left out."""

        def joined(out: list[bool]) -> list[tuple[str, int, float]]:
            found = []
            for node, pieces in self.blocks:
                own = [(t, linked) for t, n, linked in pieces if not out[n]]
                if text := " ".join("".join(t for t, _ in own).split()):
                    size = [sum(map(len, t.split())) for t, _ in own]
                    found.append((text, node, sum(n for n, (_, linked) in zip(size, own, strict=True) if linked) / max(1, sum(size))))
            return found

        out = self.left_out()
        if found := joined(out):
            return found
        form = [False] * len(self.tag)
        for i in range(1, len(self.tag)):
            form[i] = form[self.parent[i]] or self.tag[i] == "form"
        return joined(form)


def smoothed(x: list[float]) -> list[float]:
    """Each value with its neighbours' in part, along the page."""
    return [(v + NEIGHBOUR * (x[max(i - 1, 0)] + x[min(i + 1, len(x) - 1)])) / (1 + 2 * NEIGHBOUR) for i, v in enumerate(x)]


def ratios(found: list[tuple[str, int, float]]) -> dict[int, float]:
    """(text, path, share in links) of each block -> each path's fused ratio."""
    nodes: dict[int, int] = {}
    lengths: dict[int, int] = {}
    points: dict[int, int] = {}
    links: dict[int, float] = {}
    for text, path, linked in found:
        nodes[path] = nodes.get(path, 0) + 1
        lengths[path] = lengths.get(path, 0) + len(text)
        points[path] = points.get(path, 0) + len(PUNCTUATION.findall(text))
        links[path] = links.get(path, 0.0) + linked * len(text)
    by_length = smoothed([lengths[p] / nodes[p] for _, p, _ in found])
    by_points = smoothed([points[p] / nodes[p] for _, p, _ in found])
    out = dict.fromkeys(nodes, 0.0)
    for (_, p, _), a, b in zip(found, by_length, by_points, strict=True):
        out[p] += a * (1 + b) ** 0.5 / nodes[p] * (1 - links[p] / lengths[p])
    return out


def main_text(page: str | None) -> str:
    """The page's main text, its blocks joined by line feeds."""
    tree = Page(page or "")
    found = tree.texts()
    if not found:
        return ""
    n = len(tree.tag)
    ratio = ratios([(t, tree.path[i], linked) for t, i, linked in found])
    total = sum(len(t) for t, _, _ in found)
    named = 2 * sum(len(t) for t, i, _ in found if tree.whole[i]) >= total
    own = [ratio[tree.path[i]] * tree.counts[i] * (OUTSIDE if named and not tree.whole[i] else 1.0) for _, i, _ in found]
    cut = KEEP * sum(r * len(t) for r, (t, _, _) in zip(own, found, strict=True)) / total
    kept = [r >= cut for r in own]
    if not any(kept):
        return ""
    end = list(range(n))  # the last element within each
    for i in range(n - 1, 0, -1):
        end[tree.parent[i]] = max(end[tree.parent[i]], end[i])
    tops = [i for (_, i, _), k in zip(found, kept, strict=True) if k]
    low, high = min(tops), max(tops)
    container = tree.parent[low] if low == high else low  # the innermost element that holds all kept ones
    while end[container] < high:
        container = tree.parent[container]
    inside = [container < i <= end[container] or i == container for _, i, _ in found]
    if tree.tag[container] not in ("", "html", "body"):
        kept = [k or a and tree.counts[i] >= tree.counts[container] for k, a, (_, i, _) in zip(kept, inside, found, strict=True)]
    else:  # no container of its own: what leads to a kept block as its heading
        for i, j in reversed(list(pairwise(range(len(found))))):
            if kept[j] and tree.tag[found[i][1]] in HEADINGS:
                kept[i] = True
    return "\n".join(text for (text, _, _), k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each row of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([main_text(p) for p in batch.column("html").to_pylist()], pa.string())], ["page_id", "url", "text"])

    return text_batches(pages).select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")
