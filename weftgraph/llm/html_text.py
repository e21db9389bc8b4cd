"""Main text of HTML pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

Python's own streaming parser turns a page into events; no tree is built. Text between two block-level tags is a line, with white space made
single, inline markup joined as it stands, and character references decoded. Events also keep a stack of open containers, so that each line
knows its container, and whether it stands in something that is no main text by its element (scripts, styles, menus, headers and footers of the page,
asides, forms, buttons, embedded media, hidden elements) or by a word of its class, id or role (`BESIDE`; `no-sidebar`, `has-menu` don't count).

Every other line has a text-to-tag ratio: its characters by the tags since the line before. Ratios are smoothed by a Gaussian over neighbouring lines, and
lines of at least one standard deviation are the content regions. They choose a container: from the page inwards, an article or main element is
entered if it holds most of the characters in regions, another container if it holds nearly all and leaves no headline behind. In an
article or main element every line stays, however short, since regions only choose it. Elsewhere lines before and after the regions go (a line that
only its neighbours lift over the threshold ends none), unless they are headings, paragraphs, quotations or preformatted text. The chosen lines, joined by a blank in page order, are the text.

Unclosed paragraphs, items and cells end where the next one starts; an end tag closes what was left open inside, and is ignored if nothing is open.
A page that breaks off inside a tag or comment ends there. Articles within articles belong to the outer one. A form that holds all text of a page isn't left out.
A null or empty page, or one without main text, gives an empty text. Repeated rows are handled one by one; columns named like results give way to them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the smoothing in lines; lines of this many standard deviations are content.
SIGMA, THRESHOLD = 1.0, 1.0
#: Share of the content that an article, or another container, holds if it is entered.
ARTICLE_SHARE, OTHER_SHARE = 0.5, 0.8
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup"
    " hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose text is never shown as such, and those that stand beside the main text.
UNSEEN = frozenset("script style head title noscript template iframe object svg math canvas audio video textarea select option button datalist noframes noembed".split())
ASIDE = frozenset("nav aside footer menu dialog".split())
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
#: What an opening tag ends, if it is open up to the nearest of the containers named.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("td", "th", "tr"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
}
#: Containers nested deeper than this count as their parent.
DEPTH = 512
#: Words of a class, id or role that mark what stands beside the main text.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored sponsors promo promotion promoted banner sidebar sidebars nav navbar navigation menu menus"
    " submenu breadcrumb breadcrumbs masthead footer colophon copyright notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup"
    " login share sharing social related recommended recommendations comment comments commentlist discussion disqus replies reply respond responses toolbar pagination pager"
    " skip search complementary contentinfo".split()
)
HEADER = frozenset("header topbar".split())
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
_NEGATED = re.compile(r"\b(?:no|not|non|has|with|without|is|hide|category|cat|tag|topic|type|status)[-_]\w+(?:[-_]\w+)*", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
KEEP, FORM, BESIDE_TEXT, UNSEEN_TEXT = range(4)


class Lines(HTMLParser):
    """Lines of a page and its containers, from parser events."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, bool]] = []  # text, tags before it, container, what it stands in, prose, headline
        self.parents, self.kinds = [0], ["page"]
        self.stack: list[tuple[str, int, int]] = []  # element, container, what it is
        self.open: Counter[str] = Counter()
        self.pieces: list[str] = []
        self.tags, self.prose, self.ended, self.no_comment_end = 0, "", False, False

    # events

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self._end_line()
            self._imply(tag)
        self.tags += 1
        if tag == "br":
            self.pieces.append(" ")
        if tag in VOID:
            return
        kind = self._kind(tag, attrs)
        if kind == UNSEEN_TEXT or len(self.stack) < DEPTH and (tag in BLOCKS or kind > (self.stack[-1][2] if self.stack else KEEP)):
            self._push(tag, kind)
            if tag in PROSE:
                self.prose = tag

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML
        if tag in UNSEEN and self.open[tag]:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        self.tags += 1
        if self.open[tag]:
            self._pop_to(tag)

    def handle_data(self, data: str) -> None:
        if not self.stack or self.stack[-1][2] < UNSEEN_TEXT:
            self.pieces.append(data)

    def close(self) -> None:
        self.ended = True
        super().close()
        self._end_line()

    # unfinished markup, which the parser would otherwise report as text, or stop at

    def parse_comment(self, i: int, report: bool = True) -> int:
        end = -1 if self.no_comment_end else self.rawdata.find("-->", i + 2)
        if end >= 0:
            return end + 3
        self.no_comment_end = True
        return len(self.rawdata) if self.ended else -1

    def parse_html_declaration(self, i: int) -> int:
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else len(self.rawdata) if self.ended else -1

    def parse_pi(self, i: int) -> int:
        return self.parse_html_declaration(i)

    def parse_starttag(self, i: int) -> int:
        end = super().parse_starttag(i)
        return len(self.rawdata) if end < 0 and self.ended else end

    def parse_endtag(self, i: int) -> int:
        end = super().parse_endtag(i)
        return len(self.rawdata) if end < 0 and self.ended else end

    # containers

    def _kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        """What an element is, within what it stands in."""
        above = self.stack[-1][2] if self.stack else KEEP
        if tag in UNSEEN:
            return UNSEEN_TEXT
        inside = self.open["article"] + self.open["main"]
        if tag in ASIDE or tag == "header" and not inside:
            return max(above, BESIDE_TEXT)
        if tag == "form":
            above = max(above, FORM)
        if attrs and tag not in ("html", "body", "main") and above < BESIDE_TEXT:
            named = dict(attrs)
            if "hidden" in named or _HIDDEN.search(named.get("style") or "") or named.get("aria-hidden") == "true":
                return BESIDE_TEXT
            marks = " ".join(named.get(a) or "" for a in ("class", "id", "role"))
            if marks.strip():
                words = {w.lower() for w in _WORD.findall(_NEGATED.sub(" ", marks))}
                if words & BESIDE or words & HEADER and not inside and tag != "article":
                    return BESIDE_TEXT
        return above

    def _push(self, tag: str, kind: int) -> None:
        container = self.stack[-1][1] if self.stack else 0
        if tag in BLOCKS and tag not in PROSE:
            self.parents.append(container)
            self.kinds.append(tag if kind < BESIDE_TEXT else "")
            container = len(self.kinds) - 1
        self.stack.append((tag, container, kind))
        self.open[tag] += 1

    def _pop(self) -> str:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        return tag

    def _pop_to(self, tag: str) -> None:
        while self._pop() != tag:
            pass

    def _imply(self, tag: str) -> None:
        """End what `tag` ends: any block a paragraph, an item the one before."""
        if self.open["p"]:
            depth = len(self.stack) - 1
            while self.stack[depth][0] not in BLOCKS:
                depth -= 1
            if self.stack[depth][0] == "p":
                self._pop_to("p")
        ends, within = IMPLIED.get(tag, ((), ()))
        for end in ends:
            if self.open[end]:
                found = next(e[0] for e in reversed(self.stack) if e[0] == end or e[0] in within)
                if found == end:
                    self._pop_to(end)

    def _end_line(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            self.pieces = []
            if text:
                _, container, kind = self.stack[-1] if self.stack else ("", 0, KEEP)
                self.lines.append((text, max(1, self.tags), container, kind, self.prose != "", self.prose in ("h1", "h2")))
                self.tags = 0
        self.prose = ""


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at either end the weights of the lines that exist count alone."""
    reach = max(1, round(2 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def content_regions(ratios: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(lines of content: smoothed ratios of at least `threshold` standard deviations, never none; those of them that reach it by themselves)."""
    smooth = smoothed(ratios)
    cut = min(threshold * smooth.std(), smooth.max())
    return smooth >= cut, (smooth >= cut) & (ratios >= cut)


def main_text(html: str) -> str:
    """The main text of a page."""
    page = Lines()
    page.feed(html)
    page.close()
    shown = [x for x in page.lines if x[3] < BESIDE_TEXT]
    semantic = [c for c, kind in enumerate(page.kinds) if kind in ("article", "main")]
    if semantic:
        inside = _within(page, semantic)
        shown = [x for x in shown if inside[x[2]]]
    plain = [x for x in shown if x[3] == KEEP]
    in_forms = sum(len(x[0]) for x in shown if x[3] == FORM and x[4])
    if in_forms <= 9 * sum(len(x[0]) for x in plain):  # else the form is the page
        shown = plain
    if not shown:
        return ""
    chars = np.array([len(x[0]) for x in shown])
    content, strong = content_regions(chars / np.array([x[1] for x in shown]))
    chosen, whole = _container(page, shown, np.where(content, chars, 0))
    inside = _within(page, [chosen])
    at = [i for i, x in enumerate(shown) if inside[x[2]]]
    if not whole:
        keep = [i for i in at if strong[i] or shown[i][4]]
        at = [i for i in at if keep and keep[0] <= i <= keep[-1]]
    return " ".join(shown[i][0] for i in at)


def _within(page: Lines, containers: list[int]) -> list[bool]:
    """Whether each container is one of `containers` or lies in one."""
    out = [False] * len(page.parents)
    for c in containers:
        out[c] = True
    for c in range(1, len(out)):  # parents come before their children
        out[c] |= out[page.parents[c]]
    return out


def _container(page: Lines, shown: list, mass: np.ndarray) -> tuple[int, bool]:
    """(container that the content lies in, whether it is an article or main element)."""
    total = np.zeros(len(page.parents))
    np.add.at(total, [x[2] for x in shown], mass)
    heads = np.zeros(len(page.parents), np.int64)
    np.add.at(heads, [x[2] for x in shown], [x[5] for x in shown])
    children: dict[int, list[int]] = {}
    for c in range(len(page.parents) - 1, 0, -1):
        total[page.parents[c]] += total[c]
        heads[page.parents[c]] += heads[c]
        children.setdefault(page.parents[c], []).append(c)
    semantic = [c for c, kind in enumerate(page.kinds) if kind in ("article", "main") and total[c] > 0]
    at, whole = 0, bool(semantic)
    if semantic:  # from the page straight to the one that holds most; an article within it may be entered next
        at = max((c for c in semantic if not _has_semantic_parent(page, c)), key=lambda c: (total[c], -c))
    while page.kinds[at] != "article":
        inner = max(children.get(at, []), key=lambda c: (total[c], -c), default=None)
        if inner is None or not total[inner]:
            break
        named = page.kinds[inner] in ("article", "main")
        if total[inner] < (ARTICLE_SHARE if named else OTHER_SHARE) * total[at] or not named and (whole or heads[inner] < heads[at]):
            break
        at, whole = inner, whole or named
    return at, whole


def _has_semantic_parent(page: Lines, c: int) -> bool:
    while c:
        c = page.parents[c]
        if page.kinds[c] in ("article", "main"):
            return True
    return False


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` without its html, with text and n_chars."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept), "text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) if x else "" for x in batch.column(len(kept)).to_pylist()]
            own = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *own], names=[*kept, "text", "n_chars"])

    return pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").cast("string").alias(html)).mapInArrow(run, schema)


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract(pages.select("page_id", "url", "html"))
