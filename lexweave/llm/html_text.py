"""Main text of web pages from text-to-tag ratios.

The standard library's streaming parser turns a page into lines: a line ends wherever a block element starts or ends.
Each line has a ratio of text to tags; lines inside elements that are boilerplate by name, class or role have ratio 0.
Marks hide whole class, id and role tokens, but never html, body, main, article or an element with most of the page's
text; a page of nothing but marked elements is read without marks. The ratios are smoothed with a Gaussian kernel, and a threshold between the two clusters of the smoothed ratios marks
the lines that are surely content. The content region is the smallest sectioning element that holds all these lines,
widened to the article or main element around it, if there is one; every line of the region that is not boilerplate is
text, however short. Runs of lines that are links only and mostly below the threshold are menus, marked or not.

Edge cases: null, empty and text-free pages give an empty text; broken markup (unclosed elements, cut character
references, a page that ends anywhere) is read as far as it goes, in memory that grows in line with the page however
deep its elements are nested; pages are read whole; rows are independent, so
repeated rows and ties change nothing; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from lexweave.llm.common import map_batches

#: Characters of a page given to the parser at once.
CHUNK = 1 << 16

#: Lines of links in a row that make a menu.
MENU = 3

#: Width of the Gaussian kernel in lines.
SIGMA = 1.0

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html iframe li main menu nav noscript ol option p pre script search section select style summary svg table tbody td template textarea tfoot th thead title tr ul video".split()
)
SECTION = frozenset("article body div main section td".split())
#: Never text of the page, or never its main text.
HIDDEN = frozenset("aside audio button canvas datalist dialog fieldset footer form head iframe input label menu nav noscript object option script search select style svg template textarea title video".split())
#: Words of boilerplate: a class, id or role token made up of them (as cookie-notice) marks its element.
MARKS = frozenset(
    "ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription tags toolbar widget complementary contentinfo".split()
)
#: Words that say where or what kind of box a marked element is (as sidebar-left, ad-container), not what it holds.
PLACES = frozenset("area bar block bottom box container inner item items left links list main right section site top wrapper".split())
#: Elements that marks never hide.
WHOLE = frozenset("article body html main".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: An element that the start of another closes.
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
_CLOSES = {tag: frozenset(names.split()) for tag, names in CLOSES.items()}


@dataclass
class Line:
    text: str
    tags: int
    hidden: bool
    mark: int
    section: int
    linked: bool


@dataclass
class Open:
    tag: str
    hidden: bool
    mark: int
    article: bool
    section: int


class Lines(HTMLParser):
    """Collects the lines of a page from the parser's events."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[Open] = [Open("", False, 0, False, 0)]
        #: How many elements of each name are open.
        self.count: Counter[str] = Counter()
        self.data: list[str] = []
        self.tags = 0
        #: Whether a link is open that began in this line, and the characters of such links.
        self.in_link = False
        self.linked = 0
        #: For each sectioning element in the order of their starts (0: the page) the one around it.
        self.outer: list[int] = [0]
        self.articles: set[int] = set()
        #: For each marked element (0: none) the marked element around it.
        self.around: list[int] = [0]

    def _end_line(self) -> None:
        text = " ".join("".join(self.data).split())
        self.data.clear()
        linked, self.linked, self.in_link = self.linked, 0, False
        if text:
            top = self.open[-1]
            self.lines.append(Line(text, max(1, self.tags), top.hidden, top.mark, top.section, linked >= len(text.replace(" ", ""))))
            self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._end_line()
        self.tags += 1
        self.in_link = self.in_link or tag == "a"
        if tag in VOID:
            return
        if tag in _CLOSES:
            self._close_open(_CLOSES[tag])
        top = self.open[-1]
        hidden = top.hidden or tag in HIDDEN or (tag == "header" and not top.article)
        mark = top.mark
        if not hidden and attrs:
            hidden = self._invisible(attrs)
            if tag not in WHOLE and self._marked(attrs, top.article):
                self.around.append(mark)
                mark = len(self.around) - 1
        section = top.section
        if tag in SECTION:
            self.outer.append(section)
            section = len(self.outer) - 1
            if tag in ("article", "main"):
                self.articles.add(section)
        self.open.append(Open(tag, hidden, mark, top.article or tag in ("article", "main"), section))
        self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "iframe", "script", "style"):
            self.handle_endtag(tag)

    def _close_open(self, names: frozenset[str]) -> None:
        """Close the innermost of these elements if only inline elements stand inside it."""
        if not any(self.count[name] for name in names):
            return
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in names:
                self._close_from(i)
                return
            if tag in BLOCK:
                return

    def _close_from(self, i: int) -> None:
        self.count.subtract(element.tag for element in self.open[i:])
        del self.open[i:]

    @staticmethod
    def _invisible(attrs: list[tuple[str, str | None]]) -> bool:
        return any(name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and re.search(r"display\s*:\s*none", value)) for name, value in attrs)

    @staticmethod
    def _marked(attrs: list[tuple[str, str | None]], article: bool) -> bool:
        for name, value in attrs:
            if name in ("class", "id", "role") and value:
                for token in value.split():
                    for words in ({token.lower()}, {word.lower() for word in _WORD.findall(token)}):
                        rest = words - MARKS if article else words - MARKS - {"header"}
                        if len(rest) < len(words) and rest <= PLACES:
                            return True
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_line()
        self.tags += 1
        self.in_link = self.in_link and tag != "a"
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._close_from(i)
                return
            if tag not in BLOCK and self.open[i].tag in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        self.data.append(data)
        if self.in_link:
            self.linked += len("".join(data.split()))

    def close(self) -> None:
        super().close()
        self._end_line()


def parsed(html: str) -> Lines:
    parser = Lines()
    for at in range(0, len(html), CHUNK):
        parser.feed(html[at : at + CHUNK])
    parser.close()
    return parser


def region_of(sections: list[int], page: Lines) -> range:
    """The numbers of the smallest section around all of these, or of the innermost article around that, and of all inside
    it. Numbers follow the starts of elements, so what is inside an element has the numbers behind its own."""
    ends = list(range(len(page.outer)))
    for section in range(len(ends) - 1, 0, -1):
        ends[page.outer[section]] = max(ends[page.outer[section]], ends[section])
    region, last = min(sections), max(sections)
    while ends[region] < last:
        region = page.outer[region]
    around = region
    while around and around not in page.articles:
        around = page.outer[around]
    region = around or region
    return range(region, ends[region] + 1)


def hide_marked(page: Lines) -> None:
    """Hide the lines of marked elements, save those with most of the page's text, or none if no line would be left."""
    size = [0] * len(page.around)
    whole = 0
    for line in page.lines:
        if not line.hidden:
            size[line.mark] += len(line.text)
            whole += len(line.text)
    for mark in range(len(size) - 1, 0, -1):
        if page.around[mark]:
            size[page.around[mark]] += size[mark]
    hides = [False] * len(size)
    for mark in range(1, len(size)):
        hides[mark] = hides[page.around[mark]] or 2 * size[mark] <= whole
    if all(line.hidden or hides[line.mark] for line in page.lines):
        return
    for line in page.lines:
        line.hidden = line.hidden or hides[line.mark]


def hide_menus(lines: list[Line], ratios: list[float], border: float) -> None:
    """Hide the lines of menus without a mark: MENU or more in a row that are links only, most of them in the low cluster of
    ratios (content beside a menu lifts the lines at its ends)."""
    start = 0
    for end in range(len(lines) + 1):
        if end == len(lines) or not lines[end].linked:
            if end - start >= MENU and 2 * sum(r < border for r in ratios[start:end]) > end - start:
                for line in lines[start:end]:
                    line.hidden = True
            start = end + 1


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Values under a normalised Gaussian kernel of three sigma."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for k in range(max(0, i - reach), min(len(values), i + reach + 1)):
            g = kernel[k - i + reach]
            total += g * values[k]
            weight += g
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """The border between two clusters of the values (2-means in one dimension, from 0 and the largest).

    The low cluster starts at the ratio of a line without text, so that a page of content only is not divided.
    """
    low, high = 0.0, max(values)
    for _ in range(20):
        border = (low + high) / 2
        below, above = [v for v in values if v < border], [v for v in values if v >= border]
        new = (sum(below) / len(below) if below else low, sum(above) / len(above) if above else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def main_text(html: str | None) -> str:
    """The blocks of the page's main text, joined by line ends."""
    page = parsed(html or "")
    hide_marked(page)
    lines = page.lines
    visible = [line for line in lines if not line.hidden]
    if not visible:
        return ""
    ratios = smoothed([0.0 if line.hidden else math.log1p(len(line.text) / line.tags) for line in lines])
    border = threshold([r for r, line in zip(ratios, lines) if not line.hidden])
    region = region_of([line.section for r, line in zip(ratios, lines) if not line.hidden and r >= border], page)
    hide_menus(lines, ratios, border)
    return "\n".join(line.text for line in visible if not line.hidden and line.section in region)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return map_batches(pages.select("page_id", "url", "html"), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
