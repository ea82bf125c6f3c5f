"""Main text of web pages: parser events, text-to-tag ratios, smoothing, threshold clusters.

The standard library's parser streams its events once over a page. They make lines (blocks), each
with its text, the tags and link characters in it, the containers around it and whether one of them
is boilerplate by its element, role or class. What a word, a form or a menu marks is settled at the
end of the page: a wrapper around the article or around most of the page's text is no boilerplate.
Ratios of text to tags are smoothed along the page by a Gaussian and split into two clusters. The
articles that reach the upper cluster are the content; where none does, the containers that reach it
are. A region is taken whole, short lines included. Containers and marks are kept as links to what is
around them, so that memory and time are linear in the page however deep it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed lists of HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr img").split())
DROPPED = frozenset((
    "head script style noscript template footer aside button select option textarea "
    "input iframe object embed svg math canvas audio video dialog fieldset legend "
    "title").split())
#: Elements that are left out unless they turn out to hold the article.
HOLDERS = frozenset("form nav menu".split())
REGIONS = frozenset("article main".split())
CONTAINERS = frozenset(
    "body div section td th table center blockquote ul ol dl figure details".split())
CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
                  "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Words of class, id and role values that mark what is not the article.
BOILERPLATE = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense banner promo promotion sponsor "
    "sponsored cookie cookies consent gdpr notice notification alert popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead toolbar "
    "topbar comment comments disqus discussion reply replies respond share sharing social related "
    "recommended newsletter subscribe subscription signup login search searchbox form pagination "
    "pager widget copyright complementary contentinfo paywall").split())
#: Words that on an article element itself tell of the page's layout, not of what it holds.
LAYOUT = frozenset("header footer sidebar nav navbar navigation menu toolbar topbar search".split())
#: Words that inside an article mark its own heading.
HEADING = frozenset("header masthead".split())
#: Words before and after others of one class or id that make them tell of layout: has-sidebar,
#: comments-open.
BEFORE = frozenset("has no with without".split())
AFTER = frozenset("open opened closed".split())
#: Readers' words stay boilerplate under a heading of that name.
READERS = frozenset("comment comments disqus reply replies respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks whose inline elements are words of a sentence or of code, whatever their class.
SENTENCES = HEADINGS | frozenset("p pre dd blockquote td figcaption".split())
#: Words that drop an inline element inside a sentence.
ADVERTS = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense promo promotion sponsor "
    "sponsored").split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_MARKS = ("class", "id", "role")


@dataclass(frozen=True)
class Extraction:
    """Parameters of the smoothing and of the split into clusters."""

    sigma: float = 1.0
    radius: int = 2
    apart: float = 2.0  # the clusters' centres differ at least by this factor, else all is one
    least: int = 200  # unlinked characters of a marked wrapper without article that is main text
    times: int = 4  # how much more text it holds than the page shows, beyond layout words


class _Lines(HTMLParser):
    """Lines of a page in order: [text, tags, link characters, region, container, mark]. Containers
    and marks are numbers; 0 is the page, and what is around one has a smaller number."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # tag, dropped, region, container, innermost mark, innermost block, inside code
        self.stack: list[tuple] = [("", False, 0, 0, 0, "", False)]
        self.open: Counter = Counter()
        self.around = [0]  # of each container the one around it
        # the mark around, words, inside an article the id that bears them alone, and whether only
        # an article inside lifts it
        self.marks: list[tuple] = [(0, frozenset(), "", False)]
        self.regions: dict[int, tuple] = {}  # mark around it, and whether it is the main one
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.in_link = self.serial = 0

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, _, region, held, mark, _, _ = self.stack[-1]
                self.lines.append([text, self.tags, self.linked, region, held, mark])
            self.parts = []
            self.tags = self.linked = 0

    def close_from(self, k: int) -> None:
        for x in self.stack[k:]:
            self.open[x[0]] -= 1
        del self.stack[k:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        stack = self.stack
        if tag not in INLINE and len(stack) > 1:
            closes = CLOSED_BY_SAME.get(tag)
            if closes and not any(self.open[x] for x in closes):
                pass
            elif closes:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in closes:
                        self.close_from(k)
                        break
                    if stack[k][0] in ("ul", "ol", "dl", "table", "select", "body", "article"):
                        break
            elif self.open["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == "p":
                        self.close_from(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
        if tag in VOID:
            return
        _, dropped, region, held, mark, block, code = stack[-1]
        if not dropped:
            around = mark
            dropped = tag in DROPPED or (tag == "header" and not region)
            if not dropped and tag in HOLDERS:
                mark = self.add_mark(mark, frozenset(), "", tag != "form")
            if not dropped and attrs:
                allowed = LAYOUT if tag in REGIONS else HEADING if region else frozenset()
                dropped, words, named = self.marked(tag, attrs, allowed)
                if words and tag in INLINE:
                    # a sentence, or a line that has begun, keeps its words
                    spoken = block in SENTENCES or any(not x.isspace() for x in self.parts)
                    dropped = not code and (not spoken or not words.isdisjoint(ADVERTS))
                elif words:
                    mark = self.add_mark(mark, words, named if region else "", False)
            if not region and (tag in REGIONS or ("role", "main") in attrs):
                self.serial += 1
                region = self.serial
                self.regions[region] = (around, tag != "article")
            if tag in CONTAINERS or tag in REGIONS:
                self.around.append(held)
                held = len(self.around) - 1
        if tag == "a":
            self.in_link += 1
        code = code or tag in ("pre", "code")
        self.open[tag] += 1
        stack.append((tag, dropped, region, held, mark, block if tag in INLINE else tag, code))

    def add_mark(self, around: int, words: frozenset, named: str, strict: bool) -> int:
        self.marks.append((around, words, named, strict))
        return len(self.marks) - 1

    def marked(self, tag: str, attrs: list, allowed: frozenset) -> tuple[bool, frozenset, str]:
        """Whether the element is hidden, its boilerplate words, and its id if only that has any."""
        found, named = frozenset(), ""
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return True, found, ""
            if value is None or tag in ("html", "body"):
                continue
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, found, ""
            if name in _MARKS:
                words = _read(value)
                if not words or words <= allowed:
                    continue
                if name == "id" and (tag in HEADINGS or any(
                        x[0] in HEADINGS for x in self.stack[-4:])):
                    continue  # made from the heading's text
                named = value if name == "id" and not found else ""
                found |= words
        return False, found, named

    def settled(self, how: Extraction) -> list[list]:
        """The lines that no mark drops. A mark is lifted from what holds the article or most of the
        page's text, and from an article's section whose id is its heading."""
        marks = self.marks
        size: Counter = Counter()
        holds: dict[int, int] = {}
        starts: dict[int, list] = {}
        for x in self.lines:
            mark, region = x[5], x[3]
            size[mark] += max(0, len(x[0]) - x[2])
            if mark:
                around, main = self.regions.get(region, (0, False))
                if around == mark:
                    holds[mark] = max(holds.get(mark, 0), 1 + main)
                first = starts.setdefault(mark, [x[0], 0, 0])
                first[1] += len(x[0])
                first[2] += x[2]
        if not starts:
            return self.lines
        lifted = {m for m, (head, n, linked) in starts.items()
                  if marks[m][2] and not marks[m][1] & READERS
                  and _slug(head) == _slug(marks[m][2]) and 2 * linked <= n}
        layout, strict = [True], [False]
        for around, words, _, only in marks[1:]:
            layout.append(layout[around] and words <= LAYOUT)
            strict.append(strict[around] or only)

        def clear() -> list[bool]:
            """Which marks are lifted with all around them."""
            free = [True]
            for m in range(1, len(marks)):
                free.append(m in lifted and free[marks[m][0]])
            return free

        free = clear()
        shown = sum(n for m, n in size.items() if free[m])
        for m in sorted(size, key=lambda m: (-holds.get(m, 0), not layout[m], -size[m], m)):
            if free[m] or (strict[m] and m not in holds):
                continue
            enough = max(0 if m in holds else how.least, (1 if layout[m] else how.times) * shown)
            if size[m] and (holds.get(m) == 2 or size[m] >= enough):
                while not free[m]:
                    lifted.add(m)
                    m = marks[m][0]
                free = clear()
                shown = sum(n for q, n in size.items() if free[q])
        out, tags = [], 0
        for x in self.lines:
            if free[x[5]]:
                x[1] += tags
                out.append(x)
                tags = 0
            else:
                tags += x[1]
        return out

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                if tag == "a":
                    self.in_link = max(0, self.in_link - 1)
                self.close_from(k)
                break
            if tag in INLINE and self.stack[k][0] not in INLINE:
                break  # an inline end tag closes nothing outside its block

    def handle_data(self, data: str) -> None:
        if not self.stack[-1][1]:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data)


def _read(value: str) -> frozenset:
    """Boilerplate words of a class, id or role, without those that tell of layout only."""
    found = set()
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        for i, w in enumerate(words):
            if w in BEFORE and i + 1 < len(words):
                break
            if w in BOILERPLATE and AFTER.isdisjoint(words[i + 1:i + 2]):
                found.add(w)
    return frozenset(found)


def _slug(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _upper_cluster(values: np.ndarray, apart: float) -> np.ndarray:
    """Which values lie above the threshold between two clusters; all, if they are one."""
    low, high = values.min(), values.max()
    for _ in range(30):
        above = values > (low + high) / 2
        if not above.any() or above.all():
            break
        new = values[~above].mean(), values[above].mean()
        if new == (low, high):
            break
        low, high = new
    if high < apart * max(low, 1.0):
        return np.ones(len(values), bool)
    return values > (low + high) / 2


def main_text(html: str, how: Extraction = Extraction()) -> str:
    """The article of a page: its blocks in page order, joined by one space."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.settled(how)
    if not lines:
        return ""
    ratio = np.array([max(0, len(x[0]) - x[2]) / (1 + x[1]) for x in lines])
    kernel = np.exp(-0.5 * (np.arange(-how.radius, how.radius + 1) / how.sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel, "full")[how.radius:-how.radius]
    smooth = np.convolve(ratio, kernel, "full")[how.radius:-how.radius] / weight
    content = np.flatnonzero(_upper_cluster(smooth, how.apart))
    articles = {lines[i][3] for i in content} - {0}
    if articles:
        return " ".join(x[0] for x in lines if x[3] in articles)
    # no article is dense: containers that reach the upper cluster, with all that is in them, and
    # what stands between content lines of the same parent
    around = parser.around
    inside = [False] * len(around)
    span: dict = {}
    for i in content:
        inside[lines[i][4]] = True
        span.setdefault(around[lines[i][4]], [i, i])[1] = i
    for c in range(1, len(around)):
        inside[c] = inside[c] or inside[around[c]]

    def between(i: int, parent: int) -> bool:
        first, last = span.get(parent, (1, 0))
        return first <= i <= last

    return " ".join(x[0] for i, x in enumerate(lines)
                    if inside[x[4]] or between(i, around[x[4]]))


def extract(pages: DataFrame, how: Extraction = Extraction(), id_col: str = "page_id",
            url: str = "url", html: str = "html") -> DataFrame:
    """Id, url, text and n_chars (code points) of each row, whatever its size.

    Null, empty and text-free pages have the empty text. Null ids and urls are kept, repeated rows
    have equal results, other columns are ignored and no rows give no rows.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v.as_py() or "", how) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                [id_col, url, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    chosen = pages.select(pages[id_col].alias("id"), pages[url].cast("string").alias("url"),
                          pages[html].cast("string").alias("html"))
    return chosen.mapInArrow(parse, f"`{id_col}` {kind}, `{url}` string, text string, n_chars long")
