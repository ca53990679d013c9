"""Main text of web pages by tree scoring.

A tolerant one-pass parser builds the element tree and the page's blocks (text between block-level tags, inline markup
left out).  Elements that are never part of an article, by their tag or role, are set aside with all they hold.  So are those
named as such by the words of their class and id, unless what is left makes no article while one of them does: then names do
not count (but those of comments).  Every other block gives points for itself, its commas and its length to its container, half
of them to the one above, and less to each further one; a container's points are discounted by its share of link text.
The container with the most points wins (the article or main element around it, if there is one); siblings with enough
points and substantial paragraphs beside it are kept too.  Tables of links are left out as menus, and so are the linked items of
lists of which half is links.

A null, empty or textless page gives an empty text.  Pages without any scoring container fall back to all blocks that
were not set aside.  Unclosed and truncated markup is read as browsers do: an open tag at the end is dropped, an open
script or comment runs to the end.  End tags that match nothing cost nothing, however deep the tree is.  Repeated rows give
repeated results.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.common import extend, query, table

_MARKUP = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|[!?][^>]*(?:>|\Z)|/(?P<close>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
                     r"""|(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z)))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: HTML's element classes, and words by which pages name what is not their article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select "
                  "summary table tbody td tfoot th thead tr ul".split())
ASIDE = frozenset("script style noscript template iframe svg math canvas object embed applet audio video map head title textarea nav header "
                  "footer aside form button select input dialog menu label fieldset datalist".split())
LEAF = frozenset("p pre blockquote li td th dd dt h1 h2 h3 h4 h5 h6 figcaption caption address summary".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar tablist "
                  "presentation-ad advertisement".split())
UNWANTED = frozenset("ad ads adv advert advertisement advertising adsense adbox adslot banner breadcrumb breadcrumbs comment comments commentlist "
                     "consent cookie cookies copyright disclaimer discussion disqus footer gdpr header hidden login masthead menu menus modal "
                     "nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination paywall popup "
                     "promo promos promotion recommended recommendations register related replies reply respond share sharing shoutbox "
                     "sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription taboola toolbar topbar "
                     "widget widgets".split())
COMMENTS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
WANTED = frozenset("article content main post entry story body text".split())
LIKELY = {"article": 25.0, "main": 25.0, "section": 5.0, "div": 5.0, "blockquote": 3.0, "td": 3.0, "pre": 3.0}
#: An opening tag closes open elements of the given names, up to the given boundary.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
          "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
_CLOSES_P = BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "html", "head", "body"}


#: An element is part of the page, only named as something else, named as comments, or set aside for good.
PART, NAMED, COMMENTED, APART = range(4)
#: Code points of an article below which a named element may be the article, and how many times as many that one has to have.
SHORT, TIMES = 150, 3


def set_aside(tag: str, attrs: str) -> int:
    """Whether an element is no part of an article, by itself."""
    if tag in ASIDE:
        return APART
    if not attrs or attrs in (">", "/>"):
        return PART
    words: list[str] = []
    for name, value in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name in ("class", "id"):
            words += [w.lower() for w in _NAME_WORD.findall(value)]
        elif name == "role" and value.strip().lower() in ROLES:
            return APART
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return APART
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return APART
    if tag in ("html", "body", "main", "article") and not COMMENTS & set(words):
        return PART
    found = UNWANTED & set(words)
    if not found:
        return PART
    if words[0] in ("has", "with", "no", "without") or (WANTED & set(words) and not found & COMMENTS and not found & {"ad", "ads", "related"}):
        return PART
    return COMMENTED if found & COMMENTS else NAMED


class Page:
    """Elements (parent, tag, how far set aside) in page order, and the blocks of text that lie in them."""

    def __init__(self, source: str):
        self.parent, self.tag, self.aside = [-1], ["#root"], [PART]
        self._open: Counter[str] = Counter()  # open elements by tag
        self._holders = [0]  # open block elements, and per one that ends the reach of inline end tags what is open in it
        self._within: list[Counter[str]] = [Counter()]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters inside links
        self._parts: list[str] = []
        self._linked, self._owner = 0, 0
        self._read(source)

    def _read(self, source: str) -> None:
        stack, links, at = [0], 0, 0
        match = _MARKUP.search(source, at)
        while True:
            piece = source[at:match.start()] if match else source[at:]
            if piece and self.aside[stack[-1]] != APART:
                self._parts.append(piece)
                if links:
                    self._linked += len(piece.strip())
            if not match:
                break
            at = match.end()
            name = match["open"]
            if name:
                tag, attrs = name.lower(), match["attrs"]
                if attrs.endswith(">"):
                    if tag in BLOCK:
                        self._end_block()
                        links -= self._close_implied(tag, stack)
                    if tag == "br":
                        self._parts.append(" ")
                    if tag not in VOID:
                        self.parent.append(stack[-1])
                        self.tag.append(tag)
                        self.aside.append(max(self.aside[stack[-1]], set_aside(tag, attrs)))
                        here = len(self.tag) - 1
                        if tag in RAW:
                            end = re.compile(f"</{tag}", re.I | re.A).search(source, at)
                            close = source.find(">", end.start()) if end else -1
                            at = len(source) if close < 0 else close + 1
                        elif not (attrs.endswith("/>") and tag not in BLOCK and tag not in ("a", "b", "i", "span", "em", "strong")):
                            self._push(here, stack)
                            links += tag == "a"
                            if tag in BLOCK:
                                self._owner = here
            elif match["close"]:
                tag = match["close"].lower()
                if tag in BLOCK:
                    self._end_block()
                if tag != "br" and tag not in VOID:
                    links -= self._close(tag, stack)
                    self._owner = self._holders[-1]
            match = _MARKUP.search(source, at)
        self._end_block()

    def _push(self, element: int, stack: list[int]) -> None:
        tag = self.tag[element]
        stack.append(element)
        self._open[tag] += 1
        if tag in BLOCK:
            self._holders.append(element)
        if tag in BLOCK and tag != "p":
            self._within.append(Counter())
        else:
            self._within[-1][tag] += 1

    def _pop(self, depth: int, stack: list[int]) -> int:
        """Closes everything from ``depth`` on; how many links that ends."""
        ended = 0
        while len(stack) > depth:
            tag = self.tag[stack.pop()]
            self._open[tag] -= 1
            ended += tag == "a"
            if tag in BLOCK:
                self._holders.pop()
            if tag in BLOCK and tag != "p":
                self._within.pop()
            else:
                self._within[-1][tag] -= 1
        return ended

    def _close(self, tag: str, stack: list[int]) -> int:
        """Closes the innermost open element of that name, if there is one; how many links that ends.  An inline end tag does
        not reach out of its container."""
        if not (self._open if tag in BLOCK else self._within[-1])[tag]:
            return 0
        depth = len(stack) - 1
        while self.tag[stack[depth]] != tag:
            depth -= 1
        return self._pop(depth, stack)

    def _close_implied(self, tag: str, stack: list[int]) -> int:
        names, bounds = CLOSES.get(tag, ((), ()))
        if tag in _CLOSES_P:
            names, bounds = {"p"} | ({"h1", "h2", "h3", "h4", "h5", "h6"} if re.fullmatch("h[1-6]", tag) else set()), \
                BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
        ended = 0
        if any(self._open[n] for n in names):
            for depth in range(len(stack) - 1, 0, -1):
                open_tag = self.tag[stack[depth]]
                if open_tag in names:
                    ended = self._pop(depth, stack)
                    break
                if open_tag in bounds:
                    break
        self._owner = self._holders[-1]
        return ended

    def _end_block(self) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            if text:
                self.blocks.append((self._owner, text, min(self._linked, len(text))))
            self._parts = []
        self._linked = 0


def main_blocks(page: Page) -> list[str]:
    """The article's blocks in page order: without named elements if that makes an article, else with them."""
    strict = _article(page, NAMED)
    size = sum(map(len, strict))
    if size < SHORT and any(page.aside[node] == NAMED for node, _, _ in page.blocks):
        named = _article(page, COMMENTED)
        if sum(map(len, named)) > SHORT + TIMES * size and max(map(len, named)) > SHORT / 2:
            return named
    return strict


def _article(page: Page, left_out: int) -> list[str]:
    """The best container's blocks, among those set aside less than ``left_out``."""
    n = len(page.tag)
    blocks = [b for b in page.blocks if page.aside[b[0]] < left_out]
    points, size, linked = [0.0] * n, [0] * n, [0] * n
    scored: set[int] = set()
    for node, text, inside in blocks:
        size[node] += len(text)
        linked[node] += inside
        worth = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - inside / len(text))
        if len(text) < 25:
            worth *= len(text) / 100
        holder = page.parent[node] if page.tag[node] in LEAF else node
        for level in range(6):
            if holder < 0:
                break
            points[holder] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            scored.add(holder)
            holder = page.parent[holder]
    for node in range(n - 1, 0, -1):  # children come after their parents
        size[page.parent[node]] += size[node]
        linked[page.parent[node]] += linked[node]
    value = {k: (points[k] + LIKELY.get(page.tag[k], 0.0)) * (1 - linked[k] / max(size[k], 1))
             for k in scored if page.tag[k] not in ("#root", "html") and page.aside[k] < left_out}
    # Menus: tables of links, whole, and in lists of which half is links, the items that are.
    menus = [False] * n
    for node in range(1, n):
        tag, above = page.tag[node], menus[page.parent[node]]
        if tag == "table":
            menus[node] = linked[node] * 10 > size[node] * 9
        elif tag in ("ul", "ol", "dl"):
            menus[node] = linked[node] * 2 >= size[node] > 0
        elif tag in ("li", "dd", "dt"):
            menus[node] = above and linked[node] * 2 > size[node]
        elif tag in ("tr", "tbody", "thead", "tfoot", "td", "th", "p", "div"):
            menus[node] = above

    if not value:
        return [t for node, t, inside in blocks if inside * 2 <= len(t)]
    best = max(value, key=lambda k: (value[k], -k))
    above = best
    while above > 0:
        if page.tag[above] in ("article", "main") and page.aside[above] < left_out:
            best = above
            break
        above = page.parent[above]
    kept = {best}
    floor = max(10.0, 0.2 * value.get(best, 0.0))
    for node in range(1, n):
        if page.parent[node] == page.parent[best] and page.aside[node] < left_out and node != best and page.tag[best] != "body":
            if value.get(node, 0.0) - LIKELY.get(page.tag[node], 0.0) >= floor:
                kept.add(node)
            elif page.tag[node] == "p" and size[node] > 80 and linked[node] * 4 < size[node]:
                kept.add(node)
    inside_kept = [False] * n
    for node in range(1, n):
        inside_kept[node] = node in kept or inside_kept[page.parent[node]]
    return [text for node, text, _ in blocks if inside_kept[node] and not menus[node]]


def main_text(source: str | None) -> str:
    return "\n".join(main_blocks(Page(source))) if source else ""


def extract(df: DataFrame, source: str = "html") -> DataFrame:
    """``df`` without ``source``, plus text and n_chars (code points)."""
    def compute(values):
        texts = [main_text(v) for v in values]
        return [texts, [len(t) for t in texts]]

    return extend(df, source, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], compute)


@query("op2_html")
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html")))
