"""Main text of web pages by text-to-tag ratios."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article.
_NEVER = frozenset("script style noscript template svg math head title iframe object canvas audio video form fieldset button select textarea label datalist nav footer aside menu dialog".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Only these end a line; all other tags, those of dropped and unknown elements too, stand within one.
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_LANDMARKS = frozenset(("article", "main"))
_HOLDERS = frozenset("html body article main section div td center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words in a class or id that mark what surrounds an article; alone, or with words of no meaning of their own.
_STRONG = re.compile(
    r"nav\w*|menus?|menubar|sidebars?|sidepanels?|footers?|masthead|topbar|ads?|ad(?:s?box|slot|unit|sense|block|space|container|wrapper)s?|adverts?|advertisements?|advertising|sponsor(?:s|ed)?|promoted|banners?|promos?|cookies?|cookiebar|consent|gdpr|popups?|modal|newsletters?|subscribe|subscription|signup|signin|login|paywall|share|sharing|related|recommended|recommendations|comments?|commentlist|replies|disqus|breadcrumbs?|pagination|pager|toolbar|werbung|anzeigen?|publicit[eé]|publicidad|kommentare?|commentaires?|comentarios?"
)
#: Words that do so only where the text is thin, or in twos.
_TALK = re.compile(r"threads?|discussions?|responses?|reactions|readers?|users?|visitors?|community|talks?|opinions|feedback|forum|reviews|diskussion(?:en)?|meinungen|leser\w*|r[eé]actions|lecteurs|avis|opiniones|respuestas|lectores")
_WEAK = re.compile(_TALK.pattern + r"|headers?|notices?|alerts?|toast|disclaimers?|legal|copyright|search|social|widgets?|promotions?|overlay|rail|skip|hidden|hinweise?|avisos?")
_FILLERS = re.compile(r"|list|box|wrap|wrapper|container|area|block|unit|section|inner|outer|links?|bar|items?|site|page|global|main|top|bottom|left|right|buttons?|form|col|row|panel|module|slot|primary|secondary|js|\d+")
#: A heading over what readers have said.
_TALK_HEADING = re.compile(r"(?:\d+ )?(?:(?:reader|user|leser|visitor)[ -]?)?(?:comments?|responses?|replies|discussion|reactions|kommentare?|commentaires?|comentarios?|r[eé]ponses|respuestas|antworten)(?: ?\(\d+\)| ?\d+)?:?", re.IGNORECASE)
_PARTS = re.compile(r"[_\W]+|(?<=[a-z])(?=[A-Z])")
#: Says what stands beside an element, not what it is.
_BESIDE = re.compile(r"\b(?:has|with|without|no)[_-][\w-]+", re.IGNORECASE)
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BLOCKS_CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_STOPS = frozenset("article section div body main td th table blockquote ul ol li".split())
#: Share of a page's rich text that its landmarks have at least together, and of the largest one's that another has which counts.
_ALONE, _OF_LARGEST = 0.1, 0.25
#: Share of a landmark's rich text outside the landmarks in it up to which these stand for it.
_OUTSIDE = 0.2
#: Share of linked text from which a poor line is one of links.
_LINKED = 0.5
#: Share of a holder's rich text from which the holder inside it is taken, and of rich text in paragraphs from which text outside any is foreign.
_INNER, _IN_PARAGRAPHS = 0.8, 0.8
#: Lines before the rich ones among which a headline is sought.
_ABOVE = 5


def _mark(names: str) -> int:
    """2: a class or id says that the element surrounds an article; 1: perhaps; 0: not."""
    most = 0
    for name in _BESIDE.sub(" ", names).split():
        parts = [p.lower() for p in _PARTS.split(name)]
        strong, weak = (sum(map(bool, map(kind.fullmatch, parts))) for kind in (_STRONG, _WEAK))
        whole = all(_STRONG.fullmatch(p) or _WEAK.fullmatch(p) or _FILLERS.fullmatch(p) for p in parts)
        most = max(most, 2 if whole and (strong or weak > 1) else min(strong + weak, 1))
    return most


def _talk(names: str) -> bool:
    """Whether a class or id may mean what readers say, and nothing else."""
    named = [[p.lower() for p in _PARTS.split(name)] for name in _BESIDE.sub(" ", names).split()]
    return any(any(map(_TALK.fullmatch, parts)) and all(_TALK.fullmatch(p) or _STRONG.fullmatch(p) or _FILLERS.fullmatch(p) for p in parts) for parts in named)


class _Lines(HTMLParser):
    """Parser events -> a tree of block elements, and lines: (text, tags since the line before, length of linked text, element).

    Work and memory grow with the page alone, however deep its elements are nested.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool]] = []  # name, dropped, new element of the tree
        self.scopes: list[tuple[int, dict[str, int]]] = [(-1, {})]  # place in the stack, open names above it
        self.opened: dict[str, int] = {}
        self.dropped = self.linked = self.landmarks = 0
        self.at = 0
        self.parent, self.kinds, self.marks, self.talk = [0], ["html"], [0], [False]
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.link_length = 0

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, self.tags, self.link_length, self.at))
                self.tags = 0
            self.parts.clear()
            self.link_length = 0

    def pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            name, drop, element = self.stack.pop()
            self.dropped -= drop
            self.linked -= name == "a"
            self.landmarks -= name in _LANDMARKS
            self.opened[name] -= 1
            if element:
                self.at = self.parent[self.at]
            if self.scopes[-1][0] == len(self.stack):
                self.scopes.pop()
            self.scopes[-1][1][name] -= 1

    def push(self, name: str, drop: bool, element: bool) -> None:
        self.scopes[-1][1][name] = self.scopes[-1][1].get(name, 0) + 1
        self.opened[name] = self.opened.get(name, 0) + 1
        if name in _STOPS:
            self.scopes.append((len(self.stack), {}))
        self.stack.append((name, drop, element))
        self.dropped += drop
        self.linked += name == "a"
        self.landmarks += name in _LANDMARKS

    def close_nearest(self, names: tuple[str, ...], with_stop: bool) -> None:
        """Closes the innermost element of these names up to the next element that such a search stops at, which counts ``with_stop``."""
        stop, open_ = self.scopes[-1]
        if any(open_.get(name) for name in names):
            at = len(self.stack) - 1
            while self.stack[at][0] not in names:
                at -= 1
            self.pop_to(at)
        elif with_stop and stop >= 0 and self.stack[stop][0] in names:
            self.pop_to(stop)

    def _never(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in _NEVER or tag == "header" and not self.landmarks:
            return True
        if tag in ("html", "body", "article", "main"):
            return False
        return any(
            name == "role" and (value or "").strip().lower() in _ROLES or name == "hidden" or name == "aria-hidden" and (value or "").lower() == "true" or name == "style" and "display:none" in (value or "").replace(" ", "").lower()
            for name, value in attrs
        )

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in _BLOCKS:
            self.end_line()
        if tag in _VOID:
            return
        closes = ("p",) if tag in _BLOCKS_CLOSE_P else _CLOSES.get(tag, ())
        if closes:
            self.close_nearest(closes, True)
        drop = self._never(tag, attrs)
        element = tag not in _INLINE
        if element:
            self.parent.append(self.at)
            self.at = len(self.kinds)
            self.kinds.append(tag)
            names = " ".join(v or "" for name, v in attrs if name in ("class", "id")) if attrs and tag not in ("html", "body", "article", "main") else ""
            self.marks.append(_mark(names) if names else 0)
            self.talk.append(bool(names) and _talk(names))
        self.push(tag, drop, element)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in _INLINE:
            self.close_nearest((tag,), False)
            return
        if tag in _BLOCKS:
            self.end_line()
        if self.opened.get(tag):
            at = len(self.stack) - 1
            while self.stack[at][0] != tag:
                at -= 1
            self.pop_to(at)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.parts.append(data)
            if self.linked:
                self.link_length += len(data)


def _smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing over ``2 sigma`` lines to both sides."""
    if not sigma:
        return ratios
    reach = int(np.ceil(2 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


class _Regions:
    """Which lines of a page are content: ratios, smoothing and a threshold first, then the tree."""

    def __init__(self, page: _Lines, sigma: float):
        self.page = page
        self.texts = [line[0] for line in page.lines]
        self.of = np.array([line[3] for line in page.lines])
        self.size = np.array([len(t) for t in self.texts])
        self.plain = np.maximum(self.size - np.array([line[2] for line in page.lines]), 0)
        self.ratio = self.size / np.maximum([line[1] for line in page.lines], 1)
        smooth = _smooth(self.ratio, sigma)
        self.threshold = 0.5 * smooth.std()
        self.rich = smooth >= self.threshold
        if not (self.rich * self.plain).sum():
            self.rich = np.ones(len(self.of), bool)
        self.gone = np.zeros(len(page.kinds), bool)
        self.gone = self._surroundings()
        self.stays = ~self.gone[self.of]

    def _total(self, of_lines: np.ndarray) -> np.ndarray:
        """Sums of lines by element, elements inside included."""
        out = np.bincount(self.of, of_lines * ~self.gone[self.of], len(self.page.kinds)).tolist()
        for k in range(len(out) - 1, 0, -1):
            out[self.page.parent[k]] += out[k]
        return np.array(out)

    def _surroundings(self) -> np.ndarray:
        """Elements marked as what surrounds an article, but for those with half of the rich text; perhaps marked ones if their text is thin."""
        rich, size, rich_size = self._total(self.rich * self.plain), self._total(self.size), self._total(self.rich * self.size)
        marks = np.array(self.page.marks)
        gone = (rich < 0.5 * rich[0]) & ((marks == 2) | (marks == 1) & (rich_size < 0.5 * size))
        for k in range(1, len(gone)):
            gone[k] |= gone[self.page.parent[k]]
        return gone

    def landmarks(self) -> list[int]:
        """The elements <article> and <main> that hold the article: those with a fair share of the text, and in place of one the ones in it that have nearly all its rich text."""
        kinds, parent = self.page.kinds, self.page.parent
        rich, size = self._total(self.rich * self.plain), self._total(self.size)
        share = np.maximum(rich / max(rich[0], 1), size / max(size[0], 1))
        inner: dict[int, list[int]] = {}
        around = [0] * len(kinds)  # the nearest landmark around an element, which comes before it
        for k in range(1, len(kinds)):
            up = parent[k]
            around[k] = up if kinds[up] in _LANDMARKS and not self.gone[up] and size[up] else around[up]
            if kinds[k] in _LANDMARKS and not self.gone[k] and size[k]:
                inner.setdefault(around[k], []).append(k)

        chosen, todo = [], [0]
        while todo:
            k = todo.pop()
            held = inner.get(k, [])
            fair = [m for m in held if share[m] >= _OF_LARGEST * max(share[m] for m in held)]
            if held and (k == 0 or kinds[k] == "main" and rich[k] - sum(rich[m] for m in held) <= _OUTSIDE * rich[k]):
                todo += fair
            elif k:
                chosen.append(k)
        return sorted(chosen) if sum(share[k] for k in chosen) >= _ALONE else []

    def holder(self) -> int:
        """The element that holds the article where no landmark tells."""
        kinds, parent = self.page.kinds, self.page.parent
        rich = self._total(self.rich * self.plain)
        inside = 0
        for k in range(1, len(kinds)):  # each holder comes after the one around it
            if kinds[k] in _HOLDERS and parent[k] <= inside and rich[k] >= _INNER * rich[inside] and rich[k]:
                at = parent[k]
                while at > inside:
                    at = parent[at]
                if at == inside:
                    inside = k
        return inside

    def within(self, tops: list[int]) -> np.ndarray:
        """Lines of some elements and those inside them."""
        held = np.zeros(len(self.page.kinds), bool)
        held[tops] = True
        for k in range(1, len(held)):
            held[k] |= held[self.page.parent[k]]
        return held[self.of] & self.stays

    def chosen(self) -> list[int]:
        tops = self.landmarks()
        if tops:
            stays = self.within(tops)
            stays &= ~self._said(stays)
            return np.flatnonzero(stays & ~self._bars(stays)).tolist()
        stays = self.within([self.holder()])
        stays &= self._region(stays)
        lines = np.flatnonzero(stays).tolist()
        links = [not self.rich[i] and self.size[i] - self.plain[i] >= 0.9 * self.size[i] for i in lines]
        out, k = [], 0
        while k < len(lines):  # three or more lines of links alone are a menu
            end = k
            while end < len(lines) and links[end]:
                end += 1
            if end - k < 3:
                end = max(end, k + 1)
                out += lines[k:end]
            k = end
        return out

    def _said(self, inside: np.ndarray) -> np.ndarray:
        """Lines of a landmark that readers have written: what follows a heading that says so in its element, and elements at the end whose class may mean so."""
        kinds, parent = self.page.kinds, self.page.parent
        end = list(range(1, len(kinds) + 1))  # one past the last element inside
        for k in range(len(kinds) - 1, 0, -1):
            end[parent[k]] = max(end[parent[k]], end[k])
        spans = np.zeros(len(kinds) + 1, np.int64)
        headings = [i for i in np.flatnonzero(inside).tolist() if kinds[self.of[i]] in _HEADINGS and _TALK_HEADING.fullmatch(self.texts[i])]
        for i in headings:
            spans[self.of[i]] += 1
            spans[end[parent[self.of[i]]]] -= 1
        said = inside & (np.cumsum(spans)[self.of] > 0)

        order = np.argsort(self.of, kind="stable")
        sorted_of, rich = self.of[order], np.concatenate(([0], np.cumsum((self.rich * self.plain * inside)[order])))
        upto = lambda k: rich[np.searchsorted(sorted_of, k)]
        left = np.unique(self.of[inside & ~said]).tolist()  # elements with lines that stay, of which the last go
        for k in sorted((k for k, talk in enumerate(self.page.talk) if talk), reverse=True):
            own = upto(end[k]) - upto(k)
            if left and left[-1] < end[k] and upto(k) > 0 and own < 0.5 * rich[-1]:
                while left and left[-1] >= k:
                    left.pop()
        return said | inside & ~np.isin(self.of, left)

    def _bars(self, inside: np.ndarray) -> np.ndarray:
        """Runs of two or more lines of a landmark that are links, most of them poor, unless a heading stands right over them: rows of buttons, tags and the like."""
        heading = lambda i: self.page.kinds[self.of[i]] in _HEADINGS
        bars, lines = np.zeros(len(inside), bool), np.flatnonzero(inside).tolist()
        links = [self.size[i] - self.plain[i] >= _LINKED * self.size[i] and not heading(i) for i in lines]
        k = 0
        while k < len(lines):
            to = k
            while to < len(lines) and links[to]:
                to += 1
            headed = k > 0 and (heading(lines[k - 1]) or self.texts[lines[k - 1]].endswith(":"))
            if to - k > 1 and not headed and 2 * self.rich[lines[k:to]].sum() < to - k:
                bars[lines[k:to]] = True
            k = max(to, k + 1)
        return bars

    def _region(self, inside: np.ndarray) -> np.ndarray:
        """Lines that belong to the rich ones, where no landmark tells: rich lines and the paragraphs, items and headings of what holds such."""
        kinds, parent = self.page.kinds, self.page.parent
        rich = self._total(self.rich * self.plain * inside)
        block = [k if kind in _HOLDERS else 0 for k, kind in enumerate(kinds)]
        for k in range(1, len(kinds)):
            block[k] = block[k] or block[parent[k]]
        own = np.bincount([block[k] for k in self.of], self.rich * self.plain * inside, len(kinds))
        loose = np.array([kinds[k] in _HOLDERS for k in self.of])
        foreign = loose & ((self.rich * self.plain * inside * ~loose).sum() >= _IN_PARAGRAPHS * rich[0])
        keep = np.array([own[block[k]] > 0 for k in self.of]) & ~loose | self.rich & np.where(foreign, self.ratio >= self.threshold, True)
        first = next((i for i in np.flatnonzero(inside & self.rich & ~foreign).tolist()), None)
        if first is not None:
            for i in range(max(first - _ABOVE, 0), first):
                keep[i] |= kinds[self.of[i]] in ("h1", "h2") and self.plain[i] > 0
        return keep


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The article of one page; empty if there is none.

    Lines are the runs of text between block-level tags, whatever other tags stand in them; navigation, asides,
    forms and the like have none. Each line's ratio of text to tags is smoothed
    over its neighbours, and lines above the threshold (half the standard deviation of all) are
    rich. Elements whose class or id marks them as comments, adverts and so on go,
    unless half of the rich text is in them; where the words may mean something else they go if their own lines aren't rich.
    The article are the page's <article> and <main> elements with a fair share of the
    text, of one in another the inner one if little rich text is outside; all their lines stay but what readers have written at
    the end and runs of lines of links, most of them poor, that no heading stands over. Else it is the innermost holder of most rich
    text, and those of its lines stay that are rich or stand in one block with
    rich ones; a headline may stand before them. Runs of three or more links that aren't rich go.
    """
    if not html:
        return ""
    if "<![" in html:
        html = re.sub(r"<!\[[^>]*>?", "", html)
    parser = _Lines()
    parser.feed(html)
    if not re.match(r"<[!/?a-zA-Z]", parser.rawdata):  # a tag or comment that the page's end cuts off is no text
        parser.close()
    parser.end_line()
    if not parser.lines:
        return ""
    regions = _Regions(parser, sigma)
    return "\n".join(regions.texts[i] for i in regions.chosen())


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the main text of the whole html as ``text_col`` (replaced if there); null and empty html give an empty text.

    Character references are decoded, white space inside a line becomes one
    space, lines are joined by a line feed in page order. Each row is read on
    its own; repeated rows each give a row; other columns stay as they are. An empty table gives an empty result.
    Time and memory of a page grow with its length, however deep its elements are nested.
    """

    @F.pandas_udf("string")
    def run(htmls: pd.Series) -> pd.Series:
        return htmls.map(main_text)

    return pages.withColumn(text_col, run(F.col(html_col)))
