"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lines of a sliding window, and the characters a window must hold to count as text.
LINES = 3
DENSE = 60

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
#: Where one of these may begin, and what decides where a tag ends.
_MAY_BEGIN = re.compile(r"<(?:[!?]|/?[a-zA-Z])")
_SIGNS = re.compile(r"[>\"']")
_MARKS = re.compile(r"(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_SPACE = re.compile(r"\s+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Elements whose content is never text of the page.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas"}
#: Those of them that swallow the rest of a page where they are never closed.
_UNPARSED = {"script", "style", "textarea", "title", "iframe"}
#: Elements that hold menus, forms and the like.
_ASIDE = {"head", "nav", "footer", "aside", "form", "header", "menu", "dialog", "button", "select", "fieldset"}
#: Words in class, id or role attributes that say the same.
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo",
    "cookie", "cookies", "disqus", "footer", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination",
    "popup", "promo", "related", "replies", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar",
    "widget",
}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_NEVER = {"html", "body", "article", "main"}


#: What a start tag ends, and what may stand between: end tags of list items, definitions, cells and paragraphs are optional.
_CELLS, _ROWS, _BODIES = {"td", "th"}, {"tr"}, {"tbody", "thead", "tfoot"}
_ENDS = (
    {"li": ({"li"}, None), "option": ({"option"}, None)} | dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, None)) | dict.fromkeys(_CELLS, (_CELLS, {"table"}))
    | {"tr": (_CELLS | _ROWS, {"table"})} | dict.fromkeys(_BODIES, (_CELLS | _ROWS | _BODIES, {"table"}))
)
_OPTIONAL = {"p", *_ENDS}
_BETWEEN = {"div", "p", "address"} | _INLINE
_TABLE = {"table", "caption"} | _CELLS | _ROWS | _BODIES
_BLOCKS = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
}


class _Tags:
    """Finds a page's tags and comments. A "<" that begins none is text; after the first such one, the ends of all tags are worked
    out once, from the back, so that a page of unclosed tags is not read again for each."""

    def __init__(self, page: str) -> None:
        self.page, self.signs, self.closed, self.last = page, [], [], -2

    def after(self, at: int) -> re.Match[str] | None:
        """The first tag or comment from ``at`` on."""
        while m := _MAY_BEGIN.search(self.page, at):
            at = m.start()
            found = _TOKEN.match(self.page, at) if self._may_end(at) else None
            if found:
                return found
            if self.last == -2:
                self._ends()
            at += 1
        return None

    def _ends(self) -> None:
        """Whether a tag is ever closed by a > outside quotes, by the next sign that it meets."""
        self.signs, self.last = [m.start() for m in _SIGNS.finditer(self.page)], self.page.rfind(">")
        self.closed, nearest = [False] * (len(self.signs) + 1), {}
        for i in range(len(self.signs) - 1, -1, -1):
            sign = self.page[self.signs[i]]
            self.closed[i] = sign == ">" or (sign in nearest and self.closed[nearest[sign] + 1])
            nearest[sign] = i

    def _may_end(self, at: int) -> bool:
        if self.last == -2 or self.page.startswith(("<!--", "<![CDATA["), at):
            return True
        if self.page[at + 1] in "!?":  # any > ends these
            return at < self.last
        return self.closed[bisect_left(self.signs, at)]


def _aside(tag: str, attributes: str, inside: int) -> int:
    """Whether an element holds menus and the like: 3 by its tag, 2 by a whole word of its attributes, 1 by a part of a word."""
    if tag in _VOID or tag in _NEVER and not (tag == "article" and inside):
        return 0
    if tag in _ASIDE and not (tag == "header" and inside):
        return 3
    words = [w for m in _MARKS.finditer(attributes) for w in m[1].strip("\"'").lower().split()]
    if not _NAMES.isdisjoint(words):
        return 2
    return int(any(not _NAMES.isdisjoint(re.split(r"[-_]+", w)) for w in words))


class _Open:
    """The open elements, and where the last of each kind stands, so that no question about them walks over all."""

    def __init__(self) -> None:
        self.stack: list[str] = []
        self.at: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []  # places of elements that are not inline
        self.apart: list[int] = []  # places of elements that may not stand between a list item and its end

    def push(self, tag: str) -> None:
        n = len(self.stack)
        self.stack.append(tag)
        self.at[tag].append(n)
        if tag not in _INLINE:
            self.blocks.append(n)
        if tag not in _BETWEEN:
            self.apart.append(n)

    def cut(self, left: int) -> None:
        while len(self.stack) > left:
            n, tag = len(self.stack) - 1, self.stack.pop()
            self.at[tag].pop()
            for places in (self.blocks, self.apart):
                if places and places[-1] == n:
                    places.pop()

    def last(self, *tags: str) -> int:
        """The place of the innermost of these; -1 if none is open."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)


def _left_by_start(tag: str, open_: _Open) -> int:
    """How many of the open elements stay open when ``tag`` starts."""
    stack, n = open_.stack, len(open_.stack)
    if tag in _ENDS:
        ended, barrier = _ENDS[tag]
        i = open_.last(*ended)
        wall = open_.last(*barrier) if barrier else open_.apart[-1] if open_.apart else -1
        if i >= 0 and i >= wall:
            while i and stack[i - 1] in ended:
                i -= 1
            return i
    if tag in _BLOCKS and open_.at["p"]:
        i = open_.blocks[-1]
        if stack[i] == "p":
            return i
    return n


def _left_by_end(tag: str, open_: _Open) -> int:
    """How many of the open elements stay open after the end tag of ``tag``; a surplus one ends nothing."""
    i = open_.last(tag)
    if tag in _INLINE:
        wall = open_.blocks[-1] if open_.blocks else -1
    else:
        wall = -1 if tag in _TABLE or tag in _NEVER else open_.last(*_TABLE)
    return i if i >= 0 and i >= wall else len(open_.stack)


#: Elements inside each other, each told to be aside by a class word, that may hold a page's only heading.
DEEP = 4

Line = tuple[str, int, bool]


def text_lines(page: str) -> list[Line]:
    """The page without markup: a line for every block, as (text, its characters outside links and white space, in the article).

    Blocks of menus, forms, adverts and the like leave one empty line, as many as stand in a row. A block that only a part of
    a class word tells to be one ("has-sidebar") stays if it holds the page's main element or its first article; without an
    article its first h1, and without that more than half of its text. One that a whole class word tells ("search") stays if no
    main element, article or h1 is outside such blocks, and it holds one and more than half of the page's text. Where the main
    element holds at least half of what articles and main elements say, articles outside it are cards of other pages.
    """
    spared: set[int] = set()
    for _ in range(DEEP):
        lines, hidden, heads = _read(page, spared)
        total = sum(n for _, n, _ in hidden) + sum(plain for _, plain, _ in lines)
        more = {at for at, n, head in hidden if head and 2 * n > total}
        if heads or not more:
            break
        spared |= more
    else:
        lines, _, _ = _read(page, spared)
    return [x for x, before in zip(lines, [("x", 0, False), *lines]) if x[0] or before[0]]


def _read(page: str, spared: set[int]) -> tuple[list[Line], list[tuple[int, int, bool]], bool]:
    """(lines, what class words hide as (place, characters, with a main element, article or h1), whether one of these is outside); the
    elements at the places ``spared`` are not hidden."""
    lines: list[tuple[str, int, bool, int, int, bool]] = []  # and the group it is in, the group whose place it holds, in the main element
    hidden: list[list] = []
    main, by_name = 0, False  # by_name: the skipped element is one by a class word
    parts: list[str] = []
    plain, link, article, skip, at = 0, 0, 0, -1, 0  # skip: the open elements outside the skipped one
    folded, last = page.lower(), {}  # the last end tag of each kind
    if len(folded) != len(page):  # lower-casing may lengthen a letter; tags are ASCII
        folded = page.translate(_LOWER)
    open_ = _Open()
    stack = open_.stack
    groups: list[tuple[int, int, int]] = []  # the open ones: number, open elements and articles outside
    n_groups, held = 0, {}  # the groups around the first main, article and h1

    def close() -> None:
        nonlocal plain
        line = _SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if line:
            lines.append((line, plain, article > 0, groups[-1][0] if groups else 0, 0, main > 0))
        plain = 0

    def said(raw: str) -> None:
        nonlocal plain
        if raw and skip < 0:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            plain += 0 if link else len(_SPACE.sub("", text))
        elif raw and by_name:
            hidden[-1][1] += len(_SPACE.sub("", raw))

    def last_end(tag: str) -> int:
        if tag not in last:
            last[tag] = folded.rfind(f"</{tag}")
        return last[tag]

    def leave(left: int) -> None:
        nonlocal article
        open_.cut(left)
        while groups and len(stack) <= groups[-1][1]:
            close()
            article = min(article, groups.pop()[2])

    n, tags = len(page), _Tags(page)
    while at < n:
        m = tags.after(at)
        if not m:
            said(page[at:])
            break
        said(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing, single = bool(m[1]), m[3].endswith("/")
        if not closing and tag in _RAW:
            if tag not in _INLINE:
                close()
            if not (single and tag in ("svg", "math")):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at) if last_end(tag) >= at else None
                if not end:
                    last[tag] = -1  # nor is there one further on
                if end or tag in _UNPARSED:
                    at = end.end() if end else n
            continue
        if closing:
            left = _left_by_end(tag, open_)
        else:
            left = _left_by_start(tag, open_)
        own = left == skip and closing and stack[left] == tag
        if left < len(stack):
            leave(left)
        if skip >= 0:
            if left <= skip:
                skip = -1
            if own:
                continue
        opens = not closing and not single and tag not in _VOID
        if skip >= 0:
            if opens:
                open_.push(tag)
                if by_name and tag in ("main", "article", "h1"):
                    hidden[-1][2] = True
            continue
        kind = _aside(tag, m[3], article) if opens and m.start() not in spared else 0
        if kind and (tag in _OPTIONAL or last_end(tag) >= at):
            close()
            if kind >= 2 or tag in _INLINE:
                by_name = kind == 2
                if by_name:
                    hidden.append([m.start(), 0, tag in ("main", "article", "h1")])
                lines.append(("", 0, article > 0, groups[-1][0] if groups else 0, 0, main > 0))
                skip = len(stack)
                open_.push(tag)
                continue
            n_groups += 1
            lines.append(("", 0, article > 0, groups[-1][0] if groups else 0, n_groups, main > 0))
            groups.append((n_groups, len(stack), article))
        elif kind:  # never closed: only its tag is left out
            close()
            continue
        if opens:
            open_.push(tag)
            if tag in ("main", "article", "h1"):
                held.setdefault(tag, [g for g, _, _ in groups])
        if tag == "a":
            link = 0 if closing else 1
        if tag == "br":
            parts.append(" ")
        elif tag not in _INLINE:
            close()
            if tag in ("article", "main"):
                article = max(0, article + (-1 if closing else 1))
                if tag == "main":
                    main = max(0, main + (-1 if closing else 1))
    close()
    said_in = [sum(x[1] for x in lines if x[2] and x[5] == inside) for inside in (False, True)]
    if 0 < said_in[1] >= said_in[0]:
        lines = [(*x[:2], x[2] and x[5], *x[3:]) for x in lines]
    marked = bool(held)
    if not n_groups:
        return [x[:3] for x in lines], hidden, marked
    keep = {0, *held.get("main", ()), *held.get("article", held.get("h1", ()))}
    if "article" not in held and "h1" not in held:
        inside, parent = [0] * (n_groups + 1), {x[4]: x[3] for x in lines if x[4]}
        for _, k, _, g, _, _ in lines:
            inside[g] += k
        for g in range(n_groups, 0, -1):
            inside[parent[g]] += inside[g]
        keep |= {g for g in parent if 2 * inside[g] > inside[0]}
    return [x[:3] for x in lines if x[3] in keep and (not x[4] or x[4] not in keep)], hidden, marked


def main_text(page: str | None, lines: int = LINES, dense: int = DENSE) -> str:
    """Text between the surge and the dive of the line-block distribution.

    The weight of a line is its characters outside links and white space, and the weights of ``lines`` lines in a row are summed
    at every line. A window of at least ``dense`` characters is dense (where none is, the heaviest are). More than ``lines``
    lines in a row without weight part the page; dense windows with less between them are one stretch. The text is the
    heaviest stretch, and at both ends lines without weight are left out. Where the page marks an article, only its lines count,
    the text goes from the first part with a dense window to the end of the last, and what is between them stays. An article of
    links alone weighs what the links say.
    """
    found = text_lines(page or "")
    if any(inside and text for text, _, inside in found):
        marked, found = True, [x for x in found if x[2]]
    else:
        marked = False
    weight = np.array([plain for _, plain, _ in found], np.int64)
    if marked and not weight.any():
        weight = np.array([len(_SPACE.sub("", text)) for text, _, _ in found], np.int64)
    heavy = np.flatnonzero(weight)
    if not len(heavy):
        return ""
    sums = np.convolve(weight, np.ones(lines, np.int64))[lines - 1 :] if len(weight) >= lines else np.cumsum(weight[::-1])[::-1]
    on = np.flatnonzero(sums >= min(dense, int(sums.max())))
    parted = np.flatnonzero(np.diff(heavy) > lines + 1)
    spans = []
    for first, final in zip(heavy[[0, *(parted + 1)]], heavy[[*parted, -1]], strict=True):
        within = on[(on > first - lines) & (on <= final)]
        if len(within):
            spans.append((first, final + 1) if marked else (max(first, within[0]), min(final + 1, within[-1] + lines)))
    if marked:
        a = 0 if spans[0][0] == heavy[0] and heavy[0] <= lines else spans[0][0]
        b = len(found) if spans[-1][1] == heavy[-1] + 1 and len(found) - heavy[-1] - 1 <= lines else spans[-1][1]
    else:
        a, b = max(spans, key=lambda s: (int(weight[s[0] : s[1]].sum()), -s[0]))
        used = a + np.flatnonzero(weight[a:b])
        a, b = used[0], used[-1] + 1
    return "\n".join(text for text, _, _ in found[a:b] if text)


def extract_text(pages: DataFrame, source: str = "html", lines: int = LINES, dense: int = DENSE) -> DataFrame:
    """``pages`` with ``text`` (empty if there is none) and ``n_chars`` (its code points) in place of columns so named.

    Null and empty pages give an empty text. Blocks are joined in page order by line feeds, character references are
    decoded and white space inside a block becomes one blank.
    """
    base = pages.drop("text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py(), lines, dense) for x in batch.column(batch.schema.get_field_index(source))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "text"])

    out = base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("text", T.StringType())]))
    return out.withColumn("n_chars", F.length("text").cast("long"))
