"""HTML extraction by composite text density.

A page is parsed into nodes by a forgiving scanner that reads it once. Elements
whose tag, role or hiding attribute says what they are (menus, page headers,
footers, asides, scripts, styles, form fields) are cut out. Every other node gets
a density: characters per tag, adjusted for the share of characters and tags in
links. A node's density sum is that of its children. The container with the
greatest weighted sum is the core, and the least density on its path to the body
is the threshold: the core grows to an ancestor while what that adds is as dense,
and what stands beside its path and is about as dense as the core joins it.

Tags and names only weigh: an article or main element, or one named as content,
counts for more, a form or an element named as boilerplate for less. A name tells
boilerplate if all its words do or are words of position (``ad-box``, but not
``notice-period``). What weighs less is left out of the core's text unless it
holds nearly all of it. Where the core is the body, its children that are
nothing but several links go too.

Text: character references are decoded, white space in a block becomes one
space, blocks follow each other by line feeds; line breaks are white space.

Defined cases: null and empty pages, and pages without text, give the empty
string; an element or comment that is never closed ends with the page, a tag
without its ``>`` swallows the rest, as in browsers; equal pages give equal
texts; other columns pass through ``extract`` unless they are called like its
results.
"""

from __future__ import annotations

import html
import math
import re
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from guildward.llm import arrow
from guildward.llm.common import texts, unlike

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
#: An opening tag of the key ends an open element of the values, up to a bound.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_PARAGRAPH = ({"p"}, {"td", "th", "table", "button", "article", "section", "main", "body"})
CUT_TAGS = frozenset(
    "script style noscript template head title nav footer aside button select textarea input iframe svg math object canvas "
    "audio video dialog menu datalist".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words that name boilerplate; those of lists of links tell only where links hold half the text.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot adbanner adunit sponsor sponsored sponsors promo promos "
    "promotion banner cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter "
    "subscribe subscription signup sidebar sidebars sidecol siderail menu menus nav navbar navigation topnav subnav mainnav breadcrumb "
    "breadcrumbs masthead header footer topbar comment comments commentlist respond disqus reply replies toolbar widget widgets login search".split()
)
LINK_LISTS = frozenset("share sharing social related recommended recommendations pagination pager tags popular trending".split())
#: Words that say nothing beside those.
POSITION = frozenset(
    "container wrapper wrap box list area section block item items bar site page main top bottom left right inner outer link links "
    "button buttons form panel column col row group unit slot space text title body author meta thread user reader region zone pane holder "
    "fixed sticky first last primary secondary global desktop mobile bottombar posts".split()
)
CONTENT = frozenset("article post entry story content main text".split())
#: Weights of what may hold the article, and of what tells boilerplate.
ARTICLE, MAIN, NAMED, LESS = 8.0, 4.0, 1.5, 0.125
HOLDERS = frozenset(("html", "body", "article", "main"))
HEADINGS = {f"h{k}": k for k in range(1, 7)}
#: Blocks of text or lists of them: parts of a container, never the core.
PARTS = frozenset("p ul ol li dl dt dd pre blockquote figure figcaption table thead tbody tfoot tr caption address hr".split()) | HEADINGS.keys()
_NAME = re.compile(r"[^\s/>]*")
_STOP = re.compile(r">|=\s*[\"']")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|\Z)""", re.I)
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Page:
    """Nodes in page order; node 0 is the root. A text is a node of its own without a tag.

    cut: left out whatever its density; soft: weighs LESS (1), or does so if links
    hold half its text (2); weight: of a tag or name that may hold the article.
    The scanner goes forward only, and open elements are found by their name, so
    time is linear in the page however its markup is broken.
    """

    def __init__(self, source: str):
        self.tag, self.parent, self.cut, self.text, self.soft, self.weight = ["#root"], [-1], [False], [None], [0], [1.0]
        self.open, self.at = [0], {}
        self._scan(source)

    def _scan(self, source: str) -> None:
        at, size, closes = 0, len(source), {'"': True, "'": True}
        while at < size:
            begin = source.find("<", at)
            if begin < 0:
                self._text(source[at:])
                return
            head = source[begin + 1 : begin + 2]
            closing = head == "/"
            if head in ("!", "?") or closing and not source[begin + 2 : begin + 3].isalpha():
                if begin > at:
                    self._text(source[at:begin])
                at = self._past_comment(source, begin)
                continue
            if not closing and not (head.isascii() and head.isalpha()):
                stop = begin + 1
                self._text(source[at:stop])
                at = stop
                continue
            if begin > at:
                self._text(source[at:begin])
            name = _NAME.match(source, begin + 1 + closing)
            at = name.end()
            while True:
                m = _STOP.search(source, at)
                if not m:
                    return
                at = m.end()
                if m[0] == ">":
                    break
                quote = m[0][-1]
                if closes[quote]:
                    end = source.find(quote, at)
                    closes[quote] = end >= 0
                    at = end + 1 if end >= 0 else at
            word = name[0].lower()
            if closing:
                self._close(word)
                continue
            self._start(word, source[name.end() : at - 1])
            if word in RAW:
                end = _raw_end(word).search(source, at)
                at = end.end() if end else size
                self._pop()

    def _past_comment(self, source: str, begin: int) -> int:
        if source.startswith("<!--", begin):
            if source.startswith((">", "->"), begin + 4):
                return source.index(">", begin + 4) + 1
            end = _COMMENT_END.search(source, begin + 4)
            return end.end() if end else len(source)
        end = source.find(">", begin)
        return end + 1 if end >= 0 else len(source)

    def _add(self, tag: str | None, text: str | None, cut: bool, soft: int = 0, weight: float = 1.0) -> int:
        self.tag.append(tag)
        self.parent.append(self.open[-1])
        self.cut.append(cut)
        self.text.append(text)
        self.soft.append(soft)
        self.weight.append(weight)
        return len(self.tag) - 1

    def _text(self, text: str) -> None:
        if not self.cut[self.open[-1]]:
            self._add(None, text, False)

    def _pop(self) -> None:
        self.at[self.tag[self.open.pop()]].pop()

    def _last(self, names: set[str]) -> int:
        """Depth of the innermost open element of these names, 0 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def _end(self, names: set[str], stop: set[str]) -> None:
        depth = self._last(names)
        if depth and depth > self._last(stop):
            self._close_to(depth)

    def _close_to(self, depth: int) -> None:
        while len(self.open) > depth:
            self._pop()

    def _close(self, name: str) -> None:
        if self.at.get(name):
            self._close_to(self.at[name][-1])

    def _start(self, name: str, attributes: str) -> None:
        if name in ENDS:
            self._end(*ENDS[name])
        elif name not in INLINE and name not in RAW:
            self._end(*_PARAGRAPH)
        hidden, soft, weight = _signs(name, attributes) if attributes and not attributes.isspace() else (False, 0, 1.0)
        cut = self.cut[self.open[-1]] or hidden or name in CUT_TAGS or name == "header" and not self._last({"article", "main"})
        if name == "form":
            soft = 1
        if name in ("article", "main"):
            weight = ARTICLE if name == "article" else MAIN
        node = self._add(name, None, cut, soft, weight)
        if name not in VOID:
            self.at.setdefault(name, []).append(len(self.open))
            self.open.append(node)


@lru_cache(256)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I)


@lru_cache(65_536)
def _named(value: str) -> tuple[int, float]:
    """(soft, weight) of a class or id value."""
    soft, weight = 0, 1.0
    for one in value.split():
        words = set(_WORD.findall(_HUMP.sub("-", one).lower()))
        if words & CONTENT and words <= CONTENT | POSITION:
            weight = NAMED
        if words & (BOILERPLATE | LINK_LISTS) and words <= BOILERPLATE | LINK_LISTS | POSITION:
            now = 1 if words & BOILERPLATE else 2
            soft = now if not soft else min(soft, now)
    return soft, 1.0 if soft else weight


def _signs(name: str, attributes: str) -> tuple[bool, int, float]:
    """(hidden or of a role that is cut, soft, weight) by an element's attributes."""
    soft, weight = 0, 1.0
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("class", "id"):
            if name in HEADINGS or name in ("html", "body", "main"):
                continue
            s, w = _named(value) if len(value) < 1000 else _named.__wrapped__(value)
            soft, weight = s or soft, max(w, weight)
        elif name not in HOLDERS:
            value = value.lower()
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value) or key == "role" and value in CUT_ROLES:
                return True, 0, 1.0
    return False, soft, 1.0 if soft else weight


def density(c: float, t: float, lc: float, lt: float, ratio: float) -> float:
    """Composite density of c characters under t tags, of which lc and lt belong to links; ratio is the body's share of link characters."""
    if c <= 0:
        return 0.0
    t, lt_, lc_ = max(t, 1), max(lt, 1), max(lc, 1)
    base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
    return c / t * max(math.log(c / lc_ * t / lt_), 0.0) / math.log(max(base, 1.001))


class Measures(NamedTuple):
    """Of every node: characters and tags below it, those in links, density, density sum of the children; and the body."""

    chars: list[int]
    tags: list[int]
    link_chars: list[int]
    link_tags: list[int]
    density: list[float]
    total: list[float]
    less: list[bool]
    body: int

    def free(self, i: int) -> int:
        """Characters of a node outside links."""
        return self.chars[i] - self.link_chars[i]


def measure(page: Page) -> Measures:
    tag, parent, cut, n = page.tag, page.parent, page.cut, len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[parent[i]] or tag[i] == "a"
    for i in range(n - 1, 0, -1):
        if cut[i]:
            continue
        up = parent[i]
        if tag[i] is None:
            size = len(page.text[i]) - sum(map(page.text[i].count, " \n\t\r\f\v"))
            chars[i], link_chars[i] = size, size if linked[i] else 0
        else:
            tags[up] += 1
            link_tags[up] += tag[i] == "a"
        chars[up] += chars[i]
        link_chars[up] += link_chars[i]
        tags[up] += tags[i]
        link_tags[up] += link_tags[i]
    body = next((i for i in range(n) if tag[i] == "body" and chars[i]), 0)
    ratio = link_chars[body] / max(chars[body], 1)
    less = [False] * n
    for i in range(1, n):
        less[i] = less[parent[i]] or page.soft[i] == 1 or page.soft[i] == 2 and 2 * link_chars[i] >= chars[i]
    dense = [0.0 if cut[i] else density(chars[i], tags[i], link_chars[i], link_tags[i], ratio) for i in range(n)]
    total = [0.0] * n
    for i in range(1, n):
        total[parent[i]] += dense[i] * (LESS if less[i] else 1.0)
    return Measures(chars, tags, link_chars, link_tags, dense, total, less, body)


def core_of(page: Page, m: Measures) -> int:
    """The container below the body, or the body, with the greatest weighted density sum; the first of equal ones."""
    below = [False] * len(page.tag)
    below[m.body] = True
    best, core = m.total[m.body], m.body
    for i in range(m.body + 1, len(page.tag)):
        below[i] = below[page.parent[i]] and not page.cut[i]
        name = page.tag[i]
        if below[i] and name is not None and name not in INLINE and name not in PARTS and m.total[i] * page.weight[i] > best:
            best, core = m.total[i] * page.weight[i], i
    return core


def _grown(page: Page, m: Measures, path: list[int]) -> int:
    """Place in path (from the core to the body) of the ancestor that the core grows to, the body left out."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    plain, plain_links, blocks, links = [0] * n, [0] * n, [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        if page.cut[i] or m.less[i] and not m.less[path[0]] or tag[i] in HEADINGS:
            continue
        up = parent[i]
        if tag[i] is None:
            plain[i], plain_links[i] = m.chars[i], m.link_chars[i]
        else:
            blocks[up] += 1
            links[up] += tag[i] == "a"
        for sums in (plain, plain_links, blocks, links):
            sums[up] += sums[i]
    ratio = m.link_chars[m.body] / max(m.chars[m.body], 1)
    threshold, at = min(m.density[i] for i in path), 0
    for k in range(1, len(path) - 1):
        i, core = path[k], path[at]
        more = plain[i] - plain[core]
        added = density(more, blocks[i] - blocks[core], plain_links[i] - plain_links[core], links[i] - links[core], ratio)
        if more and added < threshold * page.weight[core] / page.weight[i]:
            break
        at = k
    return at


def _chosen(page: Page, m: Measures) -> set[int]:
    """Roots of the subtrees that hold the main text."""
    tag, parent, n = page.tag, page.parent, len(page.tag)
    path = [core_of(page, m)]
    while path[-1] != m.body:
        path.append(parent[path[-1]])
    at = _grown(page, m, path) if len(path) > 2 else 0
    core, above, on_path = path[at], set(path[at + 1 :]), set(path)
    chosen = {core}
    if not above:
        return chosen
    inside, own = [False] * n, 0
    inside[core] = True
    for i in range(core + 1, n):
        inside[i] = inside[parent[i]]
        if inside[i] and tag[i] in HEADINGS:
            own = min(own or 9, HEADINGS[tag[i]])
    per_tag = m.chars[core] / max(m.tags[core], 1) * page.weight[core]
    for i in range(m.body + 1, n):
        if parent[i] not in above or i in on_path or page.cut[i] or tag[i] is None or tag[i] in INLINE or m.less[i] and not m.less[core]:
            continue
        if tag[i] in HEADINGS:
            joins = i < core and parent[i] == parent[core] and (not own or HEADINGS[tag[i]] < own)
        else:
            joins = 2 * m.chars[i] / max(m.tags[i], 1) * page.weight[i] >= per_tag and m.link_chars[i] <= 0.3 * m.chars[i]
        if joins and m.chars[i]:
            chosen.add(i)
    return chosen


def main_text(source: bytes | str | None) -> str:
    """The main text of a page."""
    if not source:
        return ""
    page = Page(source.decode("utf-8", "replace") if isinstance(source, bytes) else source)
    m = measure(page)
    if not m.chars[0]:
        return ""
    chosen = _chosen(page, m)
    keep, root = [False] * len(page.tag), [0] * len(page.tag)
    for i in range(m.body, len(page.tag)):
        up = page.parent[i]
        if i in chosen:
            keep[i], root[i] = True, i
        elif i > m.body and keep[up] and not page.cut[i]:
            root[i] = r = root[up]
            # what weighs less goes, unless it holds nearly all of the text; so does a menu that stands in the body itself
            keep[i] = not (m.less[i] and not m.less[up]) or LESS * m.free(i) > m.free(r) - m.free(i)
            if up == r == m.body and m.link_tags[i] > 1 and m.chars[i] and not m.free(i):
                keep[i] = False
    return _blocks(page, keep)


def _blocks(page: Page, keep: list[bool]) -> str:
    """Texts of the kept nodes, cut where the block that holds them changes or another block stood between."""
    tag, parent = page.tag, page.parent
    block = [0] * len(tag)
    out, run, last = [], [], None
    fresh = False
    for i in range(1, len(tag)):
        up = parent[i]
        if tag[i] is None:
            block[i] = block[up]
            if keep[i]:
                if (fresh or block[i] != last) and run:
                    out.append(run)
                    run = []
                fresh, last = False, block[i]
                run.append(page.text[i])
        elif tag[i] in INLINE:
            block[i] = block[up]
            if tag[i] == "br" and keep[i]:
                run.append(" ")
        else:
            block[i] = i
            fresh = True
    out.append(run)
    lines = (" ".join((html.unescape(t) if "&" in t else t).split()) for t in map("".join, out))
    return "\n".join(line for line in lines if line)


def extract(pages: DataFrame, source: str = "html", keep: list[str] | None = None) -> DataFrame:
    """pages (or the columns of ``keep``) with text and n_chars."""

    def make(batches):
        for b in batches:
            out = [main_text(x) for x in texts(b.column(b.schema.get_field_index(source)))]
            yield [out, list(map(len, out))]

    keep = unlike(pages.columns if keep is None else keep, ("text", "n_chars"))
    return arrow.append_columns(pages, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make, keep)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, keep=["page_id", "url"])
