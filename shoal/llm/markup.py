"""Main text of web pages by text-to-tag ratios.

The standard library's parser is fed a page piece by piece. Its events become lines, one for each block of text, with the
number of characters and of tags. The ratios of the two are smoothed by a Gaussian over neighbouring lines and split
into two clusters by the threshold between them; the lines above it say where the content is. Where one of them lies in an article or main
element, these elements settle the borders; where none does, the region takes in both. The content region is the smallest element that holds all of
their text, and all of its lines are kept, short ones too. Elements that by their tag, role or class are menus, headers, footers, side bars,
notices, adverts, forms, scripts, styles or reader comments give no lines at all. A class or id says so only if it does not qualify the
word ("no-sidebar"), and does not count for an element that holds all of the text, or with other words beside it most of the text.

A null or empty page gives an empty text. Each row is a page of its own: repeated rows give repeated results, null ids
and urls are kept, other columns are ignored. Pages are read whole, in time linear in their length but for joining pieces.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 1 << 16
RADIUS = 2

# HTML's elements by how they lay out text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section
summary table tbody td tfoot th thead title tr ul""".split())
# What an open element ends when another begins.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
        "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
NEVER_TEXT = set("""script style noscript template head title svg math canvas iframe object audio video select textarea
button form fieldset nav menu footer aside dialog datalist map""".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = set("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies
consent disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup
promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social sponsor
sponsored subscribe subscription teaser toolbar widget widgets""".split())
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


# Words that turn round what a class or id says ("no-sidebar", "article-with-sidebar").
_QUALIFIERS = set("no not non without with has have had is hide hides".split())
SHARE = 0.5
SPREAD = 4.0


class _Element:
    """`named`: 0, or 1 if a class or id says that it is no content, 2 if the words of these say nothing else."""

    __slots__ = ("tag", "parent", "hidden", "core", "number", "named")

    def __init__(self, tag, parent, hidden, core, number, named=0):
        self.tag, self.parent, self.hidden, self.core, self.number, self.named = tag, parent, hidden, core, number, named


class Lines(HTMLParser):
    """Blocks of text of a page, in order: (text, tags met since the last one, element)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Element("", None, False, False, 0)
        self.open, self.elements = [self.root], [self.root]
        self.lines: list[tuple[str, int, _Element]] = []
        self.found: list[tuple[list[tuple[str, _Element]], int, _Element]] = []
        self.held: list[tuple[str, _Element]] = []
        self.tags = 0

    def flush(self) -> None:
        held, self.held = self.held, []
        if any(piece and not piece.isspace() for piece, _ in held):
            self.found.append((held, self.tags, self.open[-1]))
            self.tags = 0

    def resolve(self) -> None:
        """Take out what lies in elements named as no content, unless their share of the page's text says otherwise."""
        sizes, total = [0] * len(self.elements), 0
        for held, _, _ in self.found:
            for piece, element in held:
                n = len("".join(piece.split()))
                total += n
                sizes[element.number] += n
        for e in reversed(self.elements[1:]):  # parents have lower numbers
            sizes[e.parent.number] += sizes[e.number]
        out = [False] * len(self.elements)
        for e in self.elements[1:]:
            n = sizes[e.number]
            content = n == total or n > SHARE * total and e.named == 1
            out[e.number] = out[e.parent.number] or bool(e.named) and not content
        tags = 0
        for held, met, element in self.found:
            tags += met
            text = " ".join("".join(piece for piece, e in held if not out[e.number]).split())
            if text:
                self.lines.append((text, tags, element))
                tags = 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.held.append((" ", self.open[-1]))
        if tag in VOID:
            return
        if tag in ("article", "main"):  # what is left open before the content does not hold it
            while not self.open[-1].core and self._out(self.open[-1]):
                self.open.pop()
        ends = ENDS.get(tag) or ({"p"} if tag in BLOCKS else None)
        if ends:
            self._end(ends)
        above = self.open[-1]
        core = above.core or tag in ("article", "main")
        hidden = above.hidden or self._hidden(tag, attrs, above.core)
        named = 0 if hidden else self._named(tag, attrs, above.core)
        self.open.append(_Element(tag, above, hidden, core, len(self.elements), named))
        self.elements.append(self.open[-1])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _end(self, ends: set[str]) -> None:
        """Close elements that the next one ends: the nearest of them, if only text-level elements are open in it."""
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in ends:
                del self.open[k:]
                if ends == {"p"}:
                    return
                self._end(ends)
                return
            if tag in BLOCKS:
                return

    @staticmethod
    def _out(element: _Element | None) -> bool:
        while element is not None:
            if element.hidden or element.named:
                return True
            element = element.parent
        return False

    @staticmethod
    def _hidden(tag: str, attrs: list, in_core: bool) -> bool:
        if tag in NEVER_TEXT or tag == "header" and not in_core:
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            if name == "role" and value and ROLES & set(value.lower().split()):
                return True
            if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        return False

    @staticmethod
    def _named(tag: str, attrs: list, in_core: bool) -> int:
        if tag in ("html", "body", "article", "main"):
            return 0
        names, others = False, False
        for name, value in attrs:
            if name in ("class", "id") and value:
                for token in value.split():
                    words = {w.lower() for w in _WORD.findall(token)}
                    plain = not words & _QUALIFIERS and bool(words & NAMES or "header" in words and not in_core)
                    names |= plain
                    others |= not plain or not words <= NAMES | {"header"}
        return (1 if others else 2) if names else 0

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in ("article", "main", "body") and tag in ("p", "li", "b", "i", "a", "span"):
                return  # a stray end tag does not close what lies around

    def handle_data(self, data):
        if not self.open[-1].hidden:
            self.held.append((data, self.open[-1]))


def lines_of(html: str) -> Lines:
    parser = Lines()
    for at in range(0, len(html), PIECE):
        parser.feed(html[at:at + PIECE])
    parser.close()
    parser.flush()
    parser.resolve()
    return parser


def smoothed(ratios: list[float], radius: int = RADIUS) -> list[float]:
    """Gaussian mean over `radius` neighbours on either side; at the ends over those that exist."""
    weights = [math.exp(-(i * i) / (2 * radius * radius)) for i in range(-radius, radius + 1)]
    out = []
    for k in range(len(ratios)):
        total = mass = 0.0
        for i, w in enumerate(weights):
            j = k + i - radius
            if 0 <= j < len(ratios):
                total += w * ratios[j]
                mass += w
        out.append(total / mass)
    return out


def threshold(values: list[float]) -> float:
    """The border between two clusters on a line: each value nearer to its own cluster's mean.

    Nothing is below it if all are equal, or if the means differ by less than SPREAD times: long and short paragraphs are both text.
    """
    low, high = min(values), max(values)
    for _ in range(50):
        border = (low + high) / 2
        under, over = [v for v in values if v < border], [v for v in values if v >= border]
        if not under:
            return border
        moved = sum(under) / len(under), sum(over) / len(over)
        if moved == (low, high):
            break
        low, high = moved
    return min(values) if high < SPREAD * low else (low + high) / 2


def main_text(html: str | None) -> str:
    """The text of the content region, a line for each block."""
    page = lines_of(html or "")
    lines = page.lines
    if not lines:
        return ""
    ratios = smoothed([len(text) / max(1, tags) for text, tags, _ in lines])
    border = threshold(ratios)
    inside = [0] * len(page.elements)
    total = 0
    over = [ratio >= border for ratio in ratios]
    core = [element.core for _, _, element in lines]
    if any(a and b for a, b in zip(over, core)):  # the page says itself where its content is, and the ratios confirm it
        chosen = core
    else:  # without such elements, or if the content lies elsewhere too
        chosen = [a or b for a, b in zip(over, core)]
    for (text, _, element), taken in zip(lines, chosen):
        if taken:
            total += len(text)
            while element is not None:
                inside[element.number] += len(text)
                element = element.parent
    children: dict[int, list[_Element]] = {}
    for e in page.elements[1:]:
        if inside[e.number]:
            children.setdefault(e.parent.number, []).append(e)
    region = page.root
    while region.tag not in ("article", "main"):
        best = max(children.get(region.number, []), key=lambda e: inside[e.number], default=None)
        if best is None or inside[best.number] < total or best.tag not in _HOLDERS:
            break
        region = best
    kept = []
    for text, _, element in lines:
        while element is not None and element is not region:
            element = element.parent
        if element is region:
            kept.append(text)
    return "\n".join(kept)


# What the way down may enter. Lists, quotations and figures are parts of a text, not its frame.
_HOLDERS = set("html body main article section div center td th tr table tbody".split())


def extracted(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each page, and its code points."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
