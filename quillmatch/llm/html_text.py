"""Main text of web pages by composite text density (operator 3).

A page becomes a tree.  For every node, with C characters, T tags, LC link
characters and LT link tags below it, the composite density is the characters
per tag adjusted for links:

    C / T * log_b( (C / LC) * (T / LT) ),   b = ln( C / (C - LC) * LC + LCbody / Cbody * C + e )

The content is the block whose children's densities have the greatest sum.
The least density on its path to the body is a threshold: blocks beside that
path which reach it belong to the content too, and so do headings beside the
path in front of it.  An article or main element around the block settles how
far up the content reaches, if what it adds is not mostly links.

Menus, page headers, footers, sidebars and form controls drop out by their
elements and roles.  A header inside an article that holds a heading is the
article's own, and a form that holds most of the page is no form.  Words of a
class or id only vote: a block that names itself a notice, an advert or the
like drops out unless it wraps the article, or holds most of the text of a page
that has its article in it or none and is not mostly links; words behind "with", "has", "no" and so on tell of
another block and do not count; headings, sections and paragraphs are not
dropped for words that a text's own parts are named by (``AMBIGUOUS``).  Reader
comments, adverts and consent notices (``NEVER_TEXT``) drop out whatever their
size.

Defined cases: a null or blank page gives an empty text; unclosed and
wrongly nested elements are closed as browsers close them; a page without tags
is its own text; if names alone would remove everything, they are ignored; any
nesting depth and page length is handled whole.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that hold running text, not other blocks.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 pre dt li td th tr caption figcaption summary legend option address hr".split())
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr option optgroup legend".split())
SCOPES = frozenset("html table td th caption button object template".split())
DROPPED = frozenset("head script style title nav header footer aside form noscript template iframe svg canvas object embed applet audio video button select textarea input label fieldset dialog menu xmp noembed noframes datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager footer foot header masthead topbar toolbar sidebar sidebars aside rail widget widgets cookie cookies consent gdpr notice notices alert popup modal overlay paywall newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond discussion reactions share sharing social related recommended recommendations trending skip".split()
)
#: Names that a text's own headings, sections and paragraphs have too.
AMBIGUOUS = frozenset("alert discussion foot login notice notices promotion reactions related recommendations recommended replies reply respond share sharing signup skip social subscription trending".split())
OWN_PARTS = frozenset("h1 h2 h3 h4 h5 h6 section p".split())
KEPT_WHOLE = frozenset("html body main article".split())
#: Names of what is no part of the text, however long it is.
NEVER_TEXT = frozenset("ad ads adv advert adverts advertisement advertising adsense adslot comment comments commentlist disqus reply replies respond cookie cookies consent gdpr".split())
#: Words that say a name is about another block.
ABOUT_OTHERS = frozenset("with without has have no not is if hide show".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of link characters beyond which a block is a list of links.
LINK_SHARE = 0.5

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLANK = re.compile(r"\S")


class Page:
    """The tree of one page: parallel lists, parents before children."""

    def __init__(self, html: str):
        #: ``named``: 0 for no telling name, 1 for one, 2 for one of ``NEVER_TEXT`` or for a hidden block.
        self.tag, self.parent, self.named = ["html"], [-1], [0]
        self.events: list[tuple] = [(0, None)]  # (node, text), (node, None) opens, (~node, None) closes
        self._stack = [0]
        self._open: Counter[str] = Counter(["html"])
        self._parse(html)
        while self._stack:
            self._close_top()

    def _parse(self, html: str) -> None:
        at, n, low, quotes = 0, len(html), None, True
        while at < n:
            start = html.find("<", at)
            if start < 0:
                self._text(html[at:])
                return
            found = _TAG.match(html, start)
            if found is None:
                if html.startswith(("<!", "<?", "</"), start):
                    self._text(html[at:start])
                    if html.startswith("<!--", start):
                        end = html.find("-->", start + 4)
                        at = n if end < 0 else end + 3
                    else:
                        end = html.find(">", start)
                        at = n if end < 0 else end + 1
                else:
                    self._text(html[at : start + 1])
                    at = start + 1
                continue
            self._text(html[at:start])
            end = html.find(">", found.end())
            if end < 0:
                return  # an unfinished tag at the end
            inside = html[found.end() : end]
            if quotes and ('"' in inside or "'" in inside):
                whole = _QUOTED.match(html, found.end())
                if whole:
                    end = whole.end() - 1
                    inside = html[found.end() : end]
                else:
                    quotes = False  # a quote without end: tags end at the next >
            at = end + 1
            name = found[2].lower()
            if found[1]:
                self._end(name)
                continue
            self._start(name, inside)
            if name in RAW:
                low = low if low is not None else html.lower() if html.isascii() else re.sub("[A-Z]+", lambda m: m[0].lower(), html)
                end = low.find(f"</{name}", at)
                self._close_top()
                if end < 0:
                    return
                close = html.find(">", end)
                at = n if close < 0 else close + 1
            elif name in VOID or inside.endswith("/") and name not in BLOCKS:
                self._close_top()

    def _text(self, text: str) -> None:
        if text:
            self.events.append((self._stack[-1], unescape(text) if "&" in text else text))

    def _close_top(self) -> None:
        node = self._stack.pop()
        self._open[self.tag[node]] -= 1
        self.events.append((~node, None))

    def _close_if_open(self, names: frozenset | tuple, until: frozenset) -> None:
        if not any(self._open[name] for name in names):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in names:
                while len(self._stack) > depth:
                    self._close_top()
                return
            if tag in until:
                return

    def _start(self, name: str, inside: str) -> None:
        if name in ("html", "body") and self._open[name]:
            return
        if name == "body":
            self._close_if_open(("head",), SCOPES)
        if name in CLOSES_P:
            self._close_if_open(("p",), SCOPES)
        if name == "li":
            self._close_if_open(("li",), frozenset(("ul", "ol", "menu", "dir")) | SCOPES)
        elif name in ("dd", "dt"):
            self._close_if_open(("dd", "dt"), frozenset(("dl",)) | SCOPES)
        elif name in ("td", "th"):
            self._close_if_open(("td", "th"), frozenset(("tr", "table")))
        elif name == "tr":
            self._close_if_open(("tr",), frozenset(("table",)))
        elif name in ("option", "optgroup"):
            self._close_if_open(("option",), frozenset(("select",)))
        self.tag.append(name)
        self.parent.append(self._stack[-1])
        self.named.append(self._says_other(name, inside) if inside.strip() else 0)
        self._stack.append(len(self.tag) - 1)
        self._open[name] += 1
        self.events.append((self._stack[-1], None))

    def _end(self, name: str) -> None:
        walls = frozenset() if name in BLOCKS else BLOCKS
        if name == "html" or name == "body":
            return
        self._close_if_open((name,), walls)

    @staticmethod
    def _words(inside: str) -> tuple[set[str], str, bool]:
        words: set[str] = set()
        role, hidden = "", False
        for m in _ATTRIBUTE.finditer(inside):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                for name in value.split():
                    parts = [x.lower() for x in _PARTS.findall(name)]
                    if parts and parts[0] not in ABOUT_OTHERS:
                        words.update(parts)
            elif key == "role":
                role = value.strip().lower()
            elif key == "hidden" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                hidden = True
        return words, role, hidden

    def _says_other(self, name: str, inside: str) -> int:
        words, role, hidden = self._words(inside)
        if hidden and name not in ("html", "body"):
            return 2
        if name in KEPT_WHOLE:
            return 2 * (name == "article" and not words.isdisjoint(NEVER_TEXT))
        telling = words & (NAMES - AMBIGUOUS if name in OWN_PARTS else NAMES)
        return 2 if telling & NEVER_TEXT else int(bool(telling) or role in ROLES)


def _density(c: int, t: int, lc: int, lt: int, body: float) -> float:
    if not c:
        return 0.0
    t, lc1, lt = max(t, 1), max(lc, 1), max(lt, 1)
    base = log(c / max(c - lc, 1) * lc + body * c + e)
    return c / t * log(max(c / lc1 * t / lt, 1.0 + 1e-9)) / log(max(base, 1.0 + 1e-9)) if base > 1 + 1e-9 else float(c) / t


class Measures:
    """Characters, tags, link characters and link tags below every node, and the densities they give."""

    def __init__(self, page: Page, skip: list[bool]):
        tag, parent = page.tag, page.parent
        n = len(tag)
        self.c, self.t, self.lc, self.lt = [0] * n, [0] * n, [0] * n, [0] * n
        c, t, lc, lt = self.c, self.t, self.lc, self.lt
        in_link = [False] * n
        for i in range(1, n):
            in_link[i] = in_link[parent[i]] or tag[i] == "a"
        for node, text in page.events:
            if text is not None and not skip[node]:
                size = len("".join(text.split()))
                c[node] += size
                if in_link[node]:
                    lc[node] += size
        for i in range(n - 1, 0, -1):
            if not skip[i]:
                p = parent[i]
                c[p] += c[i]
                lc[p] += lc[i]
                t[p] += t[i] + 1
                lt[p] += lt[i] + (tag[i] == "a")
        self.body = next((i for i in range(n) if tag[i] == "body" and not skip[i]), 0)
        share = lc[self.body] / max(c[self.body], 1)
        self.density = [0.0 if skip[i] else _density(c[i], t[i], lc[i], lt[i], share) for i in range(n)]
        self.total = [0.0] * n
        for i in range(1, n):
            self.total[parent[i]] += self.density[i]


def _chosen(page: Page, skip: list[bool]) -> set[int]:
    """Nodes whose subtrees are the content."""
    tag, parent = page.tag, page.parent
    m = Measures(page, skip)
    blocks = [i for i in range(len(tag)) if not skip[i] and tag[i] in BLOCKS and tag[i] not in LEAVES and m.c[i]]
    if not blocks:
        return {m.body}
    best = max(blocks, key=lambda i: (m.total[i], -i))
    path = [best, *_ancestors(parent, best)]
    around = [i for i in path if tag[i] == "article"] or [i for i in path if tag[i] == "main"]
    if around and m.lc[around[-1]] - m.lc[best] <= LINK_SHARE * max(m.c[around[-1]] - m.c[best], 1):
        best = around[-1]
        path = path[path.index(best) :]
    path = path[: path.index(m.body) + 1] if m.body in path else path
    threshold = min(m.density[i] for i in path)
    on_path, chosen = set(path), {best}
    for i in range(1, len(tag)):
        if parent[i] in on_path and i not in on_path and parent[i] != best and not skip[i] and tag[i] in BLOCKS and m.c[i]:
            heads = tag[i] in HEADINGS and i < best and m.lc[i] <= LINK_SHARE * m.c[i]
            if heads or m.density[i] >= threshold > 0:
                chosen.add(i)
    return chosen


def _ancestors(parent: list[int], i: int) -> list[int]:
    out = []
    while (i := parent[i]) >= 0:
        out.append(i)
    return out


def _render(page: Page, skip: list[bool], chosen: set[int]) -> str:
    n = len(page.tag)
    shown = [False] * n
    for i in range(n):
        shown[i] = not skip[i] and (i in chosen or i > 0 and shown[page.parent[i]])
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        line = " ".join("".join(held).split())
        held.clear()
        if line:
            out.append(line)

    for node, text in page.events:
        i = node if node >= 0 else ~node
        if text is None:
            if page.tag[i] in BLOCKS:
                flush()
            elif page.tag[i] == "br":
                held.append(" ")
        elif shown[i]:
            held.append(text)
    flush()
    return "\n".join(out)


def main_text(html: str | None) -> str:
    """The article of one page; see the module for what that is."""
    if not html or not _BLANK.search(html):
        return ""
    page = Page(html)
    for by_name in (True, False):
        skip = _skipped(page, by_name)
        text = _render(page, skip, _chosen(page, skip))
        if text:
            return text
    return ""


def _skipped(page: Page, by_name: bool) -> list[bool]:
    """Which nodes are no part of any text: by element, and by name as far as names may vote."""
    tag, parent, named = page.tag, page.parent, page.named
    n = len(tag)
    inside = [False] * n  # below an article or main
    headed, wraps = [False] * n, [False] * n  # holds a heading; an article or main
    for i in range(1, n):
        inside[i] = inside[parent[i]] or tag[parent[i]] in ("article", "main")
    for i in range(n - 1, 0, -1):
        p = parent[i]
        headed[p] = headed[p] or headed[i] or tag[i] in HEADINGS
        if named[i] < 2 and tag[i] not in DROPPED or tag[i] == "form":
            wraps[p] = wraps[p] or wraps[i] or tag[i] in ("article", "main")
    dropped = [False] * n
    for i in range(1, n):
        own_header = tag[i] == "header" and inside[i] and headed[i]
        dropped[i] = dropped[parent[i]] or tag[i] in DROPPED and tag[i] != "form" and not own_header or named[i] == 2
    m = Measures(page, dropped)
    apart = any(tag[i] in ("article", "main") and not named[i] and not dropped[i] and m.c[i] for i in range(n))

    def most(i: int) -> bool:
        return 2 * m.c[i] > m.c[0] and m.lc[i] <= LINK_SHARE * m.c[i] and (inside[i] or wraps[i] or not apart)

    skip = [False] * n
    for i in range(1, n):
        own_header = tag[i] == "header" and inside[i] and headed[i]
        out = tag[i] in DROPPED and not own_header and not (tag[i] == "form" and most(i))
        if by_name and named[i] and not out:
            out = not (wraps[i] or named[i] == 1 and most(i)) or named[i] == 2
        skip[i] = skip[parent[i]] or out
    return skip


def _texts(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(p) for p in pages], dtype="object")


def extract(html: Column) -> Column:
    """The main text of a column of whole pages."""
    return F.pandas_udf(_texts, "string")(html)
