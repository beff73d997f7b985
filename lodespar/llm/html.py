"""Main text of web pages: streaming parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodespar.llm.common import in_arrow

# HTML's elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NO_TEXT = frozenset("script style noscript template iframe object embed svg math canvas audio video map select option datalist textarea button input label legend head title menu nav footer aside dialog noframes frameset".split())
FORMS = frozenset("form fieldset".split())
CLOSED_BY_BLOCK = frozenset("p".split())
NO_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form note status tooltip".split())
# What parts of a class or id say. Comments never are the article; apart from it by name; apart if they are small or mostly links.
_COMMENTS = re.compile(r"comments?|commentlist|disqus|repl(?:y|ies)|respond", re.I)
_APART = re.compile(
    r"ads?|adverts?|advert(?:isement|ising)s?|adslot|adbox|adsense|sponsor(?:ed|s)?|promos?|promotions?|banners?|cookies?|cookiebar|consent|gdpr|notices?|alerts?|"
    r"nav|navbar|navigation|menus?|submenu|breadcrumbs?|crumbs|sidebars?|footers?|foot|masthead|topbar|toolbar|"
    r"newsletter|subscri(?:be|ption)|signup|login|popup|modal|overlay|paywall|pagination|pager|hidden|copyright|search(?:box|form)|discussion",
    re.I,
)
_LOOSE = re.compile(r"aside|rail|shar(?:e|ing)|social|follow|related|recommend(?:ed|ations?)?|tags|tagcloud|widgets?|skip|search|disclaimer", re.I)
_HEADER = re.compile(r"header|head|logo", re.I)
# What a name says an element has or lacks beside it, or is filed under, isn't what it is.
_BESIDE = frozenset("has with no without show hide category cat tag topic author format type status postid".split())
CONTENT = frozenset(("article", "main"))
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HARD, COMMENTS, APART, LOOSE = range(4)


def named(names: str, declared: bool) -> int | None:
    """What the words of a class and id say the element is: COMMENTS, APART, LOOSE, or None. A declared article can only be a comment."""
    kinds = []
    for name in names.split():
        parts = [x for x in re.split(r"[-_]+|(?<=[A-Za-z])(?=\d)", name) if x]
        parts += [y for x in parts for y in re.split(r"(?<=[a-z])(?=[A-Z])", x) if y != x]  # as in cookieBanner
        if not parts or parts[0].lower() in _BESIDE or re.match("[a-z]*", parts[0])[0] in _BESIDE:
            continue
        for kind, pattern in ((COMMENTS, _COMMENTS), (APART, _APART), (LOOSE, _LOOSE)):
            if any(pattern.fullmatch(x) for x in parts) and (kind == COMMENTS or not declared):
                kinds.append(kind)
    return min(kinds, default=None)


class Lines(HTMLParser):
    """A line for each run of inline content: its text, tags, links, characters in links, container, and the innermost element apart it is in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, bool]] = []  # tag, element apart, container, inside a link
        self.parent, self.content = [-1], [False]  # of each container
        self.kind, self.above = [], []  # of each element apart, and the one around it (-1: none)
        self.text: list[str] = []
        self.linked = self.links = self.tags = 0
        self.rows: list[tuple[str, int, int, int, int, int]] = []

    def _top(self) -> tuple[str, int, int, bool]:
        return self.stack[-1] if self.stack else ("", -1, 0, False)

    def _close_line(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            _, apart, container, _ = self._top()
            self.rows.append((text, max(1, self.tags), self.links, self.linked, container, apart))
            self.tags = 0
        self.text, self.linked, self.links = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        inline = tag in INLINE
        if not inline:
            if tag == "br":
                self.text.append(" ")
                self.tags += 1
                return
            self._close_line()
        self.tags += 1
        self.links += tag == "a"
        if tag in VOID:
            return
        if not inline and self.stack and tag not in ("html", "body"):
            for k in range(len(self.stack) - 1, -1, -1):  # a block ends an open paragraph, an item ends an open item
                open_tag = self.stack[k][0]
                if open_tag in CLOSED_BY_BLOCK or (open_tag == tag and tag in ("li", "tr", "td", "th", "dt", "dd", "option")):
                    del self.stack[k:]
                    break
                if open_tag not in INLINE:
                    break
        _, apart, container, in_link = self._top()
        own = dict(attrs)
        declares = tag in CONTENT or (own.get("role") or "").lower() in ("main", "article") or (own.get("itemprop") or "") == "articleBody"
        if apart < 0 or self.kind[apart] != HARD:
            kind = self._kind(tag, own, container, declares)
            if kind is not None:
                self.kind.append(kind)
                self.above.append(apart)
                apart = len(self.kind) - 1
        if not inline and tag not in ("p", "li", "tr", "td", "th", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "ul", "ol", "table", "tbody", "thead", "header"):
            self.parent.append(container)
            self.content.append(declares)
            container = len(self.parent) - 1
        self.stack.append((tag, apart, container, in_link or tag == "a"))

    def _kind(self, tag: str, own: dict[str, str | None], container: int, declares: bool) -> int | None:
        if tag in ("html", "body"):
            return None
        if tag in NO_TEXT or "hidden" in own or (own.get("aria-hidden") or "").lower() == "true" or _HIDDEN.search(own.get("style") or ""):
            return HARD
        names = f"{own.get('class') or ''} {own.get('id') or ''}"
        kind = named(names, declares) if tag not in INLINE and names.strip() else None
        if kind in (COMMENTS, APART):
            return kind
        if tag in FORMS or (own.get("role") or "").lower() in NO_ROLES:
            return APART
        head = tag == "header" or any(_HEADER.fullmatch(y) for x in names.split() for y in re.split(r"[-_]+", x))
        return APART if head and tag not in INLINE and not declares and not self._in_content(container) else kind

    def _in_content(self, container: int) -> bool:
        while container > 0:
            if self.content[container]:
                return True
            container = self.parent[container]
        return False

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        if tag not in INLINE:
            self._close_line()
        self.tags += 1
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if tag in INLINE and self.stack[k][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self._top()[3]:
            self.linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._close_line()

    def eligible(self, least: int = 200) -> list[tuple[str, int, int, int, int]]:
        """The lines of no element that stays apart, without that element's number.

        Hard ones and comments do. One that holds more than half of what text these leave outside links, and of the declared
        article's where there is one, isn't apart whatever it's called; nor is one called something loose with at least ``least``
        characters outside links, and less in them."""
        if not self.kind:
            return [x[:5] for x in self.rows]
        plain, linked, article = [0] * len(self.kind), [0] * len(self.kind), [0] * len(self.kind)
        total = declared = 0
        for text, _, _, in_links, container, apart in self.rows:
            chain = []
            while apart >= 0:
                chain.append(apart)
                apart = self.above[apart]
            if any(self.kind[k] in (HARD, COMMENTS) for k in chain):
                continue
            n = max(0, len(text) - in_links)
            own = n if self._in_content(container) else 0
            total, declared = total + n, declared + own
            for k in chain:
                plain[k] += n
                article[k] += own
                linked[k] += in_links
        stays = []  # of each element, whether it or one around it is apart; those around come first
        for kind, above, n, own, m in zip(self.kind, self.above, plain, article, linked, strict=True):
            most = 2 * n > total and 2 * own >= declared
            mine = kind in (HARD, COMMENTS) or not (most or (kind == LOOSE and n >= least and n > m))
            stays.append(mine or (above >= 0 and stays[above]))
        return [x[:5] for x in self.rows if x[5] < 0 or not stays[x[5]]]


def content_lines(ratio: np.ndarray, sigma: float = 1.0, prior: np.ndarray | None = None) -> np.ndarray:
    """Which lines are content: Gaussian smoothing, then two clusters of the logarithms about a threshold midway between their means.

    Clusters whose means differ by less than a factor of e are one: all lines are content. ``prior`` (-1 to 1 for each
    line) moves a line's threshold by up to a quarter of the means' distance."""
    if len(ratio) < 2:
        return np.ones(len(ratio), bool)
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel, "same") if len(ratio) > len(kernel) else np.convolve(np.ones(len(ratio)), kernel)[reach : reach + len(ratio)]
    smooth = (np.convolve(ratio, kernel, "same") if len(ratio) > len(kernel) else np.convolve(ratio, kernel)[reach : reach + len(ratio)]) / weight
    level = np.log1p(smooth)
    threshold = (level.min() + level.max()) / 2
    for _ in range(20):
        low, high = level[level < threshold], level[level >= threshold]
        moved = (low.mean() + high.mean()) / 2 if len(low) and len(high) else threshold
        if abs(moved - threshold) < 1e-6:
            break
        threshold = moved
    low, high = level[level < threshold], level[level >= threshold]
    gap = high.mean() - low.mean() if len(low) and len(high) else 0.0
    if gap < 1:
        return np.ones(len(ratio), bool)
    return level >= threshold - (0.0 if prior is None else prior * gap / 4)


def link_lists(linked: np.ndarray, content: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which lines are lists of links: in a run of two or more mostly linked ones that aren't all content, or ``many`` links by themselves."""
    out = linked & many
    edges = np.flatnonzero(np.diff(np.concatenate([[0], linked.astype(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out[a:b] |= b - a > 1 and not content[a:b].all()
    return out


def main_text(html: str, chunk: int = 1 << 16) -> str:
    """The article of a page: its content lines and the other lines of the element that holds them, joined by a space.

    Lines in menus, headers, footers, forms, comments and the like don't count (see ``Lines.eligible``). Elements that declare the article are a prior: the
    threshold is lower inside and higher outside them. Content lines stay wherever they are. Other lines stay inside a
    declared element, and inside the innermost element that holds nine tenths of the content's
    characters; but lists of links go (see ``link_lists``)."""
    parser = Lines()
    for k in range(0, len(html), chunk):
        parser.feed(html[k : k + chunk])
    parser.close()
    rows = parser.eligible()
    if not rows:
        return ""
    declared = np.array([parser._in_content(x[4]) for x in rows])
    size = np.array([len(x[0]) for x in rows], float)
    linked = np.minimum(np.array([x[3] for x in rows], float), size)
    prior = np.where(declared, 1.0, -1.0) if declared.any() else None
    content = content_lines((size - linked) / np.array([x[1] for x in rows], float), prior=prior)
    lists = link_lists(linked >= 0.5 * size, content, np.array([x[2] for x in rows]) >= 5)
    content &= ~lists
    held: dict[int, float] = {}
    for x, n, yes in zip(rows, size - linked, content, strict=True):
        c = x[4]
        while yes and c >= 0:
            held[c] = held.get(c, 0.0) + n
            c = parser.parent[c]
    total = max(held.values(), default=0.0)
    best = max((c for c, n in held.items() if n >= 0.9 * total), default=0)
    keep = content.copy()
    for k, x in enumerate(rows):
        c = x[4]
        while c > best:
            c = parser.parent[c]
        keep[k] |= (declared[k] or c == best) and not lists[k]
    return " ".join(x[0] for x, yes in zip(rows, keep, strict=True) if yes)


def extract_pages(pages: DataFrame) -> DataFrame:
    """For every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    A null html counts as empty; an empty or textless page has an empty text. Whole pages are parsed, fed in pieces.
    Repeated rows get equal results; no rows give no rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").transform(in_arrow, run, "page_id long, url string, text string, n_chars long")
