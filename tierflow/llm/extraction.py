"""Main text of web pages by scoring the element tree.

Every paragraph gives points for its length and commas, less by the share of its
text inside links, to the elements around it: all to the nearest container, half
to the next, a third and a fourth to those beyond.  An element's score is
discounted by its own link density; the best one tells where the article is.  If
that is inside an ``article`` or ``main``, the article is that element and every other
one with a container of a fifth of the best one's own points.  Else it is all of the
smallest element around all such containers, but for lists of links between them.
With it stay its siblings that are headings, read like its paragraphs, score well or
hold paragraphs without many links.

Elements that hold no article by their tag, role, class or id (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments by readers) are left out
wherever they stand.  A class or id names such a part as a whole (``sidebar``), by its
last word (``user-comments``) or by its first before a word for a thing of layout
(``related-posts``); one that only begins so (``share-price``) leaves it to the links:
half of the text must be in them.  A block left out by name, or a form, stays if it
holds the page: more than half of all points and an ``article``, ``main`` or ``h1``,
or nine tenths of all points.

Text of a block element is one block: character references decoded, white space
made single spaces, trimmed; blocks are joined in page order by a space.  Inline
tags add nothing, ``br`` is white space.

A null or empty page gives the empty text, as does one without any text outside
what is left out.  Repeated rows are read alike, each as a row; an empty table gives none.  Tags that are never closed end with the element around them;
an unclosed comment, script or style runs to the end of the page.  Work is linear in
the page's length, apart from attributes with unbalanced quotes.
"""

from __future__ import annotations

import heapq
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import append_columns

# Elements and names that tell parts of a page apart.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style textarea title xmp iframe noembed noframes".split()
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q "
    "ruby rt rp s samp small span strike strong sub sup time tt u var".split()
)
PARAGRAPHS = set("p pre blockquote li dd dt h1 h2 h3 h4 h5 h6 figcaption caption".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
LEFT_OUT = set(
    "head script style noscript template iframe object svg math canvas audio video nav header "
    "footer aside form button select textarea menu dialog fieldset noembed noframes xmp title".split()
)
LEFT_OUT_ROLES = set(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu "
    "menubar toolbar".split()
)
LEFT_OUT_NAMES = set(
    "ad ads adv advert advertisement adverts adsense adslot sponsor sponsored promo promotion "
    "banner sidebar aside comment comments commentlist disqus respond reply replies cookie "
    "cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe "
    "subscription share sharing social related recommended breadcrumb breadcrumbs nav navbar "
    "navigation menu topbar toolbar footer header masthead widget widgets pagination pager login "
    "signup signin skip hidden".split()
)
# Last words of a name that say nothing of what it holds.
LAYOUT = set(
    "area bar block body bottom box button buttons center col column container content footer form "
    "group header heading holder icon icons inner item items label left link links list main menu "
    "message outer panel posts articles right row section side slot stories text thread title top "
    "unit widget widgets wrap wrapper zone".split()
)
ARTICLE_NAMES = set("article body content entry main post story text".split())
FORMS = set("form fieldset".split())
NEVER_LEFT_OUT = set("html body article main".split())
SEMANTIC = set("article main".split())
# A start tag of these ends an open element of those.
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPES = set("ul ol dl table tbody thead tfoot select article section div body html".split())

#: Points go this far up.
LEVELS = 4
SIBLING_SHARE, SIBLING_POINTS = 0.2, 10.0
#: Own points of a container of the article, as a share of the most.
WELL = 0.2
LONG_PARAGRAPH, LINKED = 80, 0.25
#: Shares of a page's points an element holds that is not left out by its name.
WITH_ARTICLE, WHOLE_PAGE = 0.5, 0.9
LINK_LIST = 0.5
STAYS, BY_LINKS, BY_NAME, GONE = range(4)

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | <[!?/a-zA-Z][^>]*+(?:>|\Z)""",
    re.VERBOSE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NAME = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE) for tag in RAW}


def _left_out(tag: str, attributes: str, in_article: bool) -> int:
    """STAYS, BY_LINKS (if half of it is links), BY_NAME (unless it holds the page) or GONE."""
    if tag in LEFT_OUT and tag not in FORMS and not (tag == "header" and in_article):
        return GONE
    by_tag = BY_NAME if tag in FORMS else STAYS
    if not attributes or tag in NEVER_LEFT_OUT:
        return by_tag
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    if "hidden" in found or found.get("aria-hidden") == "true":
        return GONE
    role = found.get("role")
    if role in LEFT_OUT_ROLES and role != "form" or _HIDDEN.search(found.get("style", "")):
        return GONE
    if role == "form":
        return BY_NAME
    tokens = [_NAME.findall(t) for t in f"{found.get('class', '')} {found.get('id', '')}".split()]
    named = max(map(_names_no_article, tokens), default=STAYS)
    if named == STAYS or any(_names_article(words) for words in tokens):
        return by_tag
    # inside a line of text there is no page to hold
    if tag in INLINE:
        return GONE if named == BY_NAME else STAYS
    return max(named, by_tag)


def _names_no_article(words: list[str]) -> int:
    """What the words of one class or id say of what it holds."""
    words = [w for w in words if len(w) > 1]
    if not words:
        return STAYS
    if words[-1] in LEFT_OUT_NAMES or words[0] in LEFT_OUT_NAMES and words[-1] in LAYOUT:
        return BY_NAME
    return BY_LINKS if words[0] in LEFT_OUT_NAMES else STAYS


def _names_article(words: list[str]) -> bool:
    return bool(words) and words[-1] in ARTICLE_NAMES and words[0] not in LEFT_OUT_NAMES


class Page:
    """The element tree of a page, as lists by element, and its blocks of text."""

    def __init__(self, source: str):
        self.tags, self.parents, self.out, self.within = ["#page"], [-1], [False], [False]
        self.by_name, self.by_links = [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._stack = [0]
        self._open: dict[str, int] = {}
        self._block: list[str] = []
        self._linked = self._links = 0
        self._owner = -1
        at = 0
        while match := _TOKEN.search(source, at):
            if match.start() > at:
                self._text(source[at : match.start()])
            at = match.end()
            tag = match["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if match["end"]:
                self._end(tag)
                continue
            self._start(tag, match["attributes"] or "")
            if tag in _RAW_END:
                close = _RAW_END[tag].search(source, at)
                at = close.end() if close else len(source)
                self._end(tag)
        self._text(source[at:])
        self._flush()

    def _flush(self) -> None:
        text = " ".join("".join(self._block).split())
        if text:
            self.blocks.append((self._owner, text, min(self._linked, len(text))))
        self._block, self._linked, self._owner = [], 0, -1

    def _text(self, raw: str) -> None:
        top = self._stack[-1]
        if not raw or self.out[top]:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if self._owner < 0 and not text.isspace():
            at = top
            while self.tags[at] in INLINE:
                at = self.parents[at]
            self._owner = at
        self._block.append(text)
        if self._links:
            self._linked += len(" ".join(text.split()))

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._block.append(" ")
            return
        block = tag not in INLINE
        if block and tag not in VOID:
            if self._open.get("p"):
                self._end("p")
            for other in CLOSES.get(tag, ()):
                self._close_in_scope(other)
        if block:
            self._flush()
        if tag in VOID:
            return
        parent = self._stack[-1]
        within = self.within[parent] or tag in SEMANTIC
        left_out = _left_out(tag, attributes, self.within[parent])
        out = self.out[parent] or left_out == GONE
        self.tags.append(tag)
        self.parents.append(parent)
        self.out.append(out)
        self.by_name.append(left_out == BY_NAME)
        self.by_links.append(left_out == BY_LINKS)
        self.within.append(within)
        self._stack.append(len(self.tags) - 1)
        self._open[tag] = self._open.get(tag, 0) + 1
        self._links += tag == "a"

    def _close_in_scope(self, tag: str) -> None:
        """End an open ``tag`` unless a list, table or section began inside it."""
        if not self._open.get(tag):
            return
        for at in reversed(self._stack):
            if self.tags[at] == tag:
                self._end(tag)
                return
            if self.tags[at] in SCOPES:
                return

    def _end(self, tag: str) -> None:
        if not self._open.get(tag):
            return
        while True:
            closed = self.tags[self._stack.pop()]
            self._open[closed] -= 1
            self._links -= closed == "a"
            if closed not in INLINE:
                self._flush()
            if closed == tag:
                return


def main_text(source: str | None) -> str:
    """The article of a page, empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    if any(page.by_name):
        _leave_out_by_name(page)
    if any(page.by_links):
        _leave_out_link_lists(page)
    if not page.blocks:
        return ""
    keep = _kept(page)
    for at in range(1, len(keep)):
        if keep[at] is None:
            keep[at] = keep[page.parents[at]]
    return " ".join(text for owner, text, _ in page.blocks if keep[owner])


def _points(text: str, links: int) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))


def _leave_out_by_name(page: Page) -> None:
    """Drop the blocks of elements left out by name, but for those that hold the page."""
    held = [0.0] * len(page.tags)
    article = [tag in SEMANTIC or tag == "h1" for tag in page.tags]
    for owner, text, links in page.blocks:
        held[owner] += _points(text, links)
    for at in range(len(held) - 1, 0, -1):
        held[page.parents[at]] += held[at]
        article[page.parents[at]] |= article[at]
    for at in range(1, len(held)):
        share = held[at] / held[0] if held[0] else 0.0
        holds = share >= WHOLE_PAGE or share > WITH_ARTICLE and article[at]
        page.out[at] |= page.out[page.parents[at]] or page.by_name[at] and not holds
    page.blocks = [block for block in page.blocks if not page.out[block[0]]]


def _totals(page: Page) -> tuple[list[int], list[int]]:
    """Characters below each element, and how many of them are in links."""
    lengths, linked = [0] * len(page.tags), [0] * len(page.tags)
    for owner, text, links in page.blocks:
        lengths[owner] += len(text)
        linked[owner] += links
    for at in range(len(lengths) - 1, 0, -1):
        lengths[page.parents[at]] += lengths[at]
        linked[page.parents[at]] += linked[at]
    return lengths, linked


def _leave_out_link_lists(page: Page) -> None:
    lengths, linked = _totals(page)
    for at in range(1, len(lengths)):
        dense = lengths[at] and linked[at] >= LINK_LIST * lengths[at]
        page.out[at] |= page.out[page.parents[at]] or bool(page.by_links[at] and dense)
    page.blocks = [block for block in page.blocks if not page.out[block[0]]]


def _kept(page: Page) -> list[bool | None]:
    """Whether each element's text is kept, None where its parent decides."""
    tags, parents = page.tags, page.parents
    scores, own, prose = [0.0] * len(tags), [0.0] * len(tags), [False] * len(tags)
    lengths, linked = _totals(page)
    for owner, text, links in page.blocks:
        points = _points(text, links)
        at = parents[owner] if tags[owner] in PARAGRAPHS else owner
        prose[at] |= tags[owner] in PARAGRAPHS
        own[at] += points
        for level in range(LEVELS):
            if at < 0:
                break
            scores[at] += points / (level + 1)
            at = parents[at]
    density = [k / n if n else 0.0 for k, n in zip(linked, lengths)]
    best = max(range(len(tags)), key=lambda at: scores[at] * (1 - density[at]))
    own = [points * (1 - d) for points, d in zip(own, density)]
    semantic = [0] * len(tags)
    for at in range(1, len(tags)):
        semantic[at] = at if tags[at] in SEMANTIC else semantic[parents[at]]
    least = WELL * max(own)
    well = [at for at in range(len(tags)) if own[at] and own[at] >= least]
    keep: list[bool | None] = [False] + [None] * (len(tags) - 1)
    if semantic[best]:
        roots = {semantic[best], *(semantic[at] for at in well if semantic[at])}
    else:
        root = _around(parents, [best, *well])
        roots = {root}
        _drop_link_lists(tags, parents, root, well, density, lengths, keep)
    for root in roots:
        keep[root] = True
    # what is above or beside is not kept, but for some siblings
    for at in range(len(tags) - 1, 0, -1):
        prose[parents[at]] |= prose[at]
    beside = {parents[root]: root for root in roots if root}
    enough = max(SIBLING_POINTS, SIBLING_SHARE * scores[best] * (1 - density[best]))
    for at in range(1, len(tags)):
        if at in roots or parents[at] not in beside or keep[at] or not lengths[at]:
            continue
        if tags[at] in HEADINGS:
            keep[at] = not linked[at]
        elif tags[at] in PARAGRAPHS:
            keep[at] = density[at] < (LINKED if lengths[at] > LONG_PARAGRAPH else LINK_LIST)
        else:
            alike = prose[at] and density[at] < LINKED and tags[at] == tags[beside[parents[at]]]
            keep[at] = alike or scores[at] * (1 - density[at]) >= enough
    return keep


def _around(parents: list[int], elements: list[int]) -> int:
    """The smallest element around all of some; one is around itself."""
    # parents have smaller numbers: the largest of them steps up until one is left
    open_ = set(elements)
    heap = [-at for at in open_]
    heapq.heapify(heap)
    while len(open_) > 1:
        at = -heapq.heappop(heap)
        open_.discard(at)
        if parents[at] not in open_:
            open_.add(parents[at])
            heapq.heappush(heap, -parents[at])
    return open_.pop()


def _drop_link_lists(tags, parents, root, well, density, lengths, keep) -> None:
    """Inside ``root``, elements without a container of the article that are mostly links."""
    holds = [False] * len(tags)
    for at in well:
        holds[at] = True
    for at in range(len(tags) - 1, 0, -1):
        holds[parents[at]] |= holds[at]
    inside = [False] * len(tags)
    inside[root] = True
    for at in range(root + 1, len(tags)):
        inside[at] = inside[parents[at]]
        # judged where it leaves the path to a container
        if inside[at] and not holds[at] and holds[parents[at]] and tags[at] not in PARAGRAPHS | INLINE:
            if lengths[at] and density[at] >= LINK_LIST:
                keep[at] = False


def extract(pages: DataFrame, payload: str = "html", column: str = "text") -> DataFrame:
    """``pages`` with the main text of ``payload`` and its length, ``n_chars``.

    Columns of ``pages`` with these names are replaced.
    """

    def run(batch):
        texts = [main_text(page) for page in batch.column(payload).cast(pa.string()).to_pylist()]
        return {column: texts, "n_chars": [len(text) for text in texts]}

    return append_columns(pages, {column: "string", "n_chars": "bigint"}, run, payload)
