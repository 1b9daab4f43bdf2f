"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser gives events; block elements cut the page into lines, each with its text, its number
of tags and the container it stands in. The ratio of text to tags of each line is smoothed by a Gaussian; lines above
the spread of the smoothed ratios are content. Where an article or main part holds any of them, the main part with most of
them, or else all articles and main parts, are the content region; else the innermost container that holds all of them is, a bar
of a line or two beside the body's story left out. So link lists, menus, other stories and the like
outside it go whatever their mark-up calls them, and where no line stands out nothing is given. All of the region's lines are given but
those in menus, headers, footers, sidebars, notices, adverts, forms and reader comments, which tags, roles and class words tell.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import markup

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Their text is no part of the page.
MUTE = frozenset("script style noscript template head title svg math iframe object audio video canvas select textarea button datalist".split())
#: Parts of a page that are not its article.
PARTS = frozenset("nav aside footer form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments commentlist reply replies respond disqus discussion "
    "share sharing social related recommended toolbar widget search pagination pager skip "
    "werbung anzeige seitenleiste fusszeile brotkrumen hinweis kommentar kommentare leserkommentare teilen verwandt "
    "publicite annonce barrelaterale ariane avis commentaire commentaires partager reponses "
    "publicidad anuncio migas aviso comentario comentarios compartir respuestas pie".split()
)
#: Words that say where or what kind of box; a name made of these and at least one of the others is such a part, any
#: other word beside them (``has-sidebar``, ``social-policy``) makes it something else.
PLAIN = frozenset(
    "site page post entry article main global primary secondary left right top bottom upper lower side inner outer float sticky fixed box block bar list links link item items area wrap wrapper container section "
    "holder row col column panel pane group unit slot zone icon icons button buttons btn header head title form field module card wide small large desktop mobile text content body user reader readers js the and of for us".split()
)
#: Elements that a page's head may hold; any other start tag, or text, ends it.
HEAD_TAGS = frozenset("head title meta link base style script noscript template".split())
_NOT_P = BLOCK - {"p"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start of one of these ends an open element of the same kind, up to the list, table or page part around it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
SIGMA, RADIUS = 1.0, 2
_KERNEL = [math.exp(-((k / SIGMA) ** 2) / 2) for k in range(-RADIUS, RADIUS + 1)]


def _names(value: str, words: frozenset | set) -> bool:
    """Whether a class or id has a name that is made of ``words`` and plain ones."""
    for name in value.split():
        parts = [p for p in _SPLIT.split(_CAMEL.sub("-", name).lower()) if p]
        if not words.isdisjoint(parts) and all(p in words or p in PLAIN or p in WORDS for p in parts):
            return True
    return False


class _Events(HTMLParser):
    """Lines of a page: (text, tags, container, is shown). Containers are numbered, each with the one around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, bool]] = []
        self.kinds: list[str] = []  # of the containers, by number
        self.parents: list[int] = []
        self.open: list[tuple[str, str, bool]] = []  # tag, what it is, whether it is a container
        self.count: dict[str, int] = {}  # open elements of each tag
        self.around = -1
        self.mute = self.part = self.header = self.article = self.heading = 0
        self.text: list[str] = []
        self.tags = 0

    def cut(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text.clear()
            if text:
                shown = not self.part and (not self.header or bool(self.article and self.heading))
                self.lines.append((text, self.tags, self.around, shown))
                self.tags = 0

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self._pop(len(self.open) - 1)
        if not self.mute:
            self.text.append(data)

    def _kind(self, tag: str, attrs: list) -> str:
        if tag in MUTE:
            return "mute"
        if tag in PARTS:
            return "part"
        if tag == "article" and self.count.get("article"):
            return "part"  # articles within one are what readers say of it
        kind = "header" if tag == "header" else ""
        for name, given in attrs:
            value = (given or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "mute"
            if tag == "article" and name == "class" and not WORDS.isdisjoint(value.split()):
                return "part"
            if tag in ("html", "body", "article", "main"):
                continue  # parts of their class words tell of the page's style
            if name == "role" and value in ROLES:
                return "part"
            if name in ("class", "id"):
                if _names(given or "", WORDS):
                    return "part"
                if _names(given or "", {"header"}):
                    kind = "header"
        return kind

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.count.get("head") and tag not in HEAD_TAGS:
            self.handle_endtag("head")
        self.tags += 1
        if tag in BLOCK:
            self._close("p", _NOT_P)
            self.cut()
        elif tag in ("br", "td", "th"):
            self.text.append(" ")
        if tag in CLOSES:
            for one in CLOSES[tag][0]:
                self._close(one, CLOSES[tag][1])
        if tag in VOID:
            return
        kind = self._kind(tag, attrs)
        holds = tag in BLOCK and tag not in ("p", "li", "html", *HEADINGS)
        self.open.append((tag, kind, holds))
        self.count[tag] = self.count.get(tag, 0) + 1
        if kind:
            setattr(self, kind, getattr(self, kind) + 1)
        if tag in ("article", "main"):
            self.article += 1
        if tag in HEADINGS:
            self.heading += 1
        if holds:
            self.parents.append(self.around)
            self.around = len(self.kinds)
            self.kinds.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def _close(self, tag: str, until: set | frozenset) -> None:
        if not self.count.get(tag):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return
            if self.open[k][0] in until:
                return

    def _pop(self, k: int) -> None:
        self.cut_if_block(k)
        for tag, kind, holds in self.open[k:]:
            self.count[tag] -= 1
            if kind:
                setattr(self, kind, getattr(self, kind) - 1)
            if tag in ("article", "main"):
                self.article -= 1
            if tag in HEADINGS:
                self.heading -= 1
            if holds:
                self.around = self.parents[self.around]
        del self.open[k:]

    def cut_if_block(self, k: int) -> None:
        if any(tag in BLOCK for tag, _, _ in self.open[k:]):
            self.cut()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if not self.count.get(tag):
            return
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return


def content_lines(ratios: list[float]) -> list[bool]:
    """Which lines stand out: smoothed ratios above their standard deviation.

    A line whose own ratio is below a sixteenth of that was only lifted by its neighbours, as the first link of a list behind
    a paragraph is.
    """
    n = len(ratios)
    if not n:
        return []
    smooth = []
    for i in range(n):
        total = weight = 0.0
        for k, w in enumerate(_KERNEL, i - RADIUS):
            if 0 <= k < n:
                total += w * ratios[k]
                weight += w
        smooth.append(total / weight)
    mean = sum(smooth) / n
    spread = math.sqrt(sum((x - mean) ** 2 for x in smooth) / n)
    return [x >= spread and 16 * own >= spread for x, own in zip(smooth, ratios, strict=True)]


_TOKEN = re.compile(rf"{markup.COMMENT}|</{markup.NAME}{markup.ATTRS}(?:>|(?P<cut>{markup.END}))|<(?P<name>{markup.NAME}){markup.ATTRS}(?:>|(?P<open>{markup.END}))|(?P<bogus><[!?/][^>]*+(?:>|{markup.END}))", re.A | re.I)
_CLOSES = {name: re.compile(rf"</{name}(?=[ \t\n\f\r/>]|{markup.END})", re.A | re.I) for name in markup.RAW if name != "xmp"}


def cleaned(html: str) -> str:
    """``html`` without comments, declarations, bodies that are never text, and tags that its end cuts off: one pass, whatever is broken.

    What is left takes the parser a time that follows its length.
    """
    out, at, look = [], 0, 0
    while m := _TOKEN.search(html, look):
        look = m.end()
        if m["name"] is None:
            if m["bogus"] is not None or m["cut"] is not None or m[0].startswith("<!"):
                out.append(html[at : m.start()])
                at = look
        elif m["open"] is not None:
            out.append(html[at : m.start()])
            at = look
        elif (close := _CLOSES.get(m["name"].lower())) is not None:
            end = close.search(html, look)
            out.append(html[at:look])
            at = look = end.start() if end else len(html)
    out.append(html[at:])
    return "".join(out)


def main_text(html: str) -> str:
    """The blocks of the content region, joined by one line end; empty where no line stands out."""
    page = _Events()
    page.feed(cleaned(html))
    page.close()
    page.cut()
    shown = [line for line in page.lines if line[3]]
    ratio = lambda line: len(line[0]) / max(1, line[1])
    marks = content_lines([ratio(line) for line in page.lines])
    content = [(line[2], len(line[0])) for line, mark in zip(page.lines, marks, strict=True) if line[3] and mark]
    if not content:  # what stands out is no part of the article: the others are held against one another
        content = [(line[2], len(line[0])) for line, mark in zip(shown, content_lines([ratio(line) for line in shown]), strict=True) if mark]
    inside = _region(page, content)
    return "\n".join(text for text, _, around, _ in shown if inside(around))


def _within(page: _Events, start) -> list[bool]:
    """Of each container whether it or one around it is of a kind; parents have smaller numbers."""
    out: list[bool] = []
    for k, parent in enumerate(page.parents):
        out.append(start(k) or (parent >= 0 and out[parent]))
    return out


def _region(page: _Events, content: list[tuple[int, int]]):
    """Whether a container belongs to the region of the content lines (container, characters)."""
    if not content:
        return lambda around: False
    total = lambda held: sum(n for k, n in content if k >= 0 and held[k])
    main = _within(page, lambda k: page.kinds[k] == "main")
    named = _within(page, lambda k: page.kinds[k] in ("article", "main"))
    if total(named):
        # Articles beside a main part with most of the content are other stories.
        held = main if 2 * total(main) > total(named) else named
        return lambda around: around >= 0 and held[around]
    home = _innermost(page.parents, {k for k, _ in content})
    if home < 0 or page.kinds[home] == "body":
        home = _story(page, content, home)
    if home < 0:
        return lambda around: True
    held = _within(page, lambda k: k == home)
    return lambda around: around >= 0 and held[around]


def _story(page: _Events, content: list[tuple[int, int]], home: int) -> int:
    """The part of a page's body that has its story, where all else that stands out is a line or two of a bar; ``home`` where there is none."""
    by: dict[int, list[tuple[int, int]]] = {}
    for k, n in content:
        top = k
        while top != home and top >= 0 and page.parents[top] != home:
            top = page.parents[top]
        if top in (home, -1):
            return home  # the body has lines of its own
        by.setdefault(top, []).append((k, n))
    size = {top: sum(n for _, n in rows) for top, rows in by.items()}
    best = max(size, key=size.get)
    if 4 * size[best] < 3 * sum(size.values()) or any(len(rows) > 2 for top, rows in by.items() if top != best):
        return home
    return _innermost(page.parents, {k for k, _ in by[best]})


def _innermost(parents: list[int], content: set[int]) -> int:
    """The innermost container that holds all of ``content``, or -1; parents have smaller numbers."""
    held = [0] * len(parents)
    for k in content:
        if k >= 0:
            held[k] = 1
    for k in range(len(parents) - 1, -1, -1):
        if held[k] == len(content):
            return k
        if parents[k] >= 0:
            held[parents[k]] += held[k]
    return -1


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) if x else "" for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page.

    Character references are decoded; white space inside a block, line breaks included, becomes one space; blocks
    are trimmed and joined by one line end; nothing is capped. A heading in an article's own header stays.

    Defined cases: a null or empty html, or one without shown text, gives an empty text; a null id or url
    stays null; repeated rows each get their row; unclosed tags end with what is around them; other
    columns are ignored; an empty table gives an empty one.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
