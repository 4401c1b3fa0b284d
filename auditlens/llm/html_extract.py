"""Main-text extraction by composite text density (operator 1).

Every page becomes a DOM; each node gets its link-adjusted characters per tag
(the composite text density of Sun, Song and Liao, 2011), a node's score is
the sum of its children's densities, and the subtree with the greatest score
among nodes at or above the body-path threshold is the article.  Words in class
and id names lower densities; a subtree is dropped by them only when every word
of a name marks furniture and it holds no article, no article heading and no
large share of the page's text.  So is a form.  Containers of reader comments go
whatever their size, unless they hold the article itself.  The work is one map over the pages: no
shuffle, memory bounded by one Arrow batch.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that never hold article text.
DROPPED = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video nav footer aside "
    "button select input textarea label datalist dialog menu".split())
#: Start tags that end an open element of these names (up to the nearest barrier).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
BARRIERS = frozenset("html body table ul ol dl select article section div main td th".split())
#: Elements that may stand in a head, and those in it whose content is not markup of the page.
HEAD_CONTENT = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
RAW_IN_HEAD = frozenset("noframes noscript script style template".split())
#: Words in class or id names, and roles, that mark page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices popup modal overlay newsletter subscribe subscription signup sidebar aside menu nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager masthead footer header topbar comment comments disqus reply replies share sharing "
    "social related recommended widget toolbar login search copyright disclaimer alert skip".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
KEPT = frozenset("html body article main".split())
#: Words that name a container of reader comments, words beside them that do not, and elements that can be one.
COMMENT_WORDS = frozenset("comment comments disqus replies".split())
COMMENT_STATES = frozenset("open opened closed status enabled disabled on off allowed no count counts link links".split())
COMMENT_TAGS = frozenset("div section article aside ul ol li dl table details".split())
#: Text blocks that a class or id name never drops, only lowers.
TEXT_BLOCKS = HEADINGS | frozenset("p blockquote pre figure figcaption table tbody thead tfoot tr td th li dt dd".split())
#: Factors of the densities below a name that has a furniture word, and one of furniture words only.
PARTLY, WHOLLY = 0.7, 0.3
#: Share of the page's non-link text from which a name drops nothing.
LARGE_SHARE = 1 / 3
_NAME_PARTS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "chars", "link_chars", "tags", "link_tags", "density", "score", "factor", "holds", "comment")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool, factor: float = 1.0):
        self.tag, self.parent, self.dropped, self.factor = tag, parent, dropped, factor
        self.holds = self.comment = False
        self.parts: list[str | _Node] = []
        self.chars = self.link_chars = self.tags = self.link_tags = 0
        self.density = self.score = 0.0


class _Builder(HTMLParser):
    """Lenient DOM builder: implied end tags, void elements, stray end tags ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", None, False)
        self.open = [self.root]
        self.order = [self.root]  # parents before children

    def handle_starttag(self, tag, attrs):
        stack = self.open
        self._leave_head(tag)
        if tag in BLOCKS and tag not in ("html", "body"):
            self._close_until({"p"}, BARRIERS)
        if tag in CLOSES:
            self._close_until(CLOSES[tag], BARRIERS - CLOSES[tag])
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        top = stack[-1]
        node = _Node(tag, top, top.dropped or self._furniture(tag, attrs), _factor(tag, attrs))
        node.comment = _comment(tag, attrs)
        top.parts.append(node)
        self.order.append(node)
        if tag not in VOID:
            stack.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # "<p/>" opens a p in HTML; only void elements have no content

    def handle_endtag(self, tag):
        stack = self.open
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                del stack[i:]
                return
            if tag not in BLOCKS and stack[i].tag in BLOCKS:
                return  # a stray inline end tag does not close blocks

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def handle_data(self, data):
        if self.open[-1].tag == "head" and not data.isspace():
            self.open.pop()
        self.open[-1].parts.append(data)

    def _leave_head(self, tag):
        """The end tag of a head is optional: body, or the first element that cannot stand in it, ends it."""
        stack = self.open
        at = next((i for i in range(1, min(len(stack), 4)) if stack[i].tag == "head"), 0)
        if not at or tag == "html" or tag == "head":
            return
        inner = stack[at + 1:]
        if tag == "body" or (tag not in HEAD_CONTENT and not any(n.tag in RAW_IN_HEAD for n in inner) and (not inner or tag in BLOCKS)):
            del stack[at:]

    def _close_until(self, names, barriers):
        stack = self.open
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in barriers:
                return

    def _furniture(self, tag, attrs) -> bool:
        if tag in DROPPED:
            return True
        if tag == "header":
            return not any(n.tag in ("article", "main") for n in self.open)
        for name, value in attrs:
            if name == "hidden":
                return True
            if not value:
                continue
            if name == "style" and _HIDDEN.search(value):
                return True
            if tag in KEPT:
                continue
            if name == "role" and value.strip().lower() in ROLES:
                return True
        return False


def _factor(tag: str, attrs) -> float:
    """What class and id names make of the densities below: 1, ``PARTLY``, or ``WHOLLY`` if every word of one name marks furniture."""
    out = 1.0
    if tag in KEPT:
        return out
    if tag == "form":
        return WHOLLY
    for name, value in attrs:
        if value and name in ("class", "id"):
            for one in value.lower().split():
                words = _NAME_PARTS.findall(one)
                if words and not FURNITURE.isdisjoint(words):
                    out = min(out, WHOLLY if FURNITURE.issuperset(words) else PARTLY)
    return out


def _comment(tag: str, attrs) -> bool:
    """Whether class or id name a container of reader comments."""
    if tag not in COMMENT_TAGS:
        return False
    names = (one for name, value in attrs if value and name in ("class", "id") for one in value.lower().split())
    return any(not COMMENT_WORDS.isdisjoint(words) and COMMENT_STATES.isdisjoint(words) for words in map(_NAME_PARTS.findall, names))


def _own_text(order: list[_Node]) -> dict[_Node, int]:
    """Non-link characters of every subtree that is not dropped."""
    own: dict[_Node, int] = {}
    for n in reversed(order):
        if n.dropped:
            continue
        total = 0
        for part in n.parts:
            if isinstance(part, str):
                total += len("".join(part.split()))
            elif not part.dropped:
                total += own[part]
        own[n] = 0 if n.tag == "a" else total
    return own


def _drop_comments(order: list[_Node]) -> None:
    """Drops containers of reader comments, whatever their size and inner tags.

    One that holds the article is none: where a marked article stands outside all of
    them, none holds it; else the one with a heading or article that nearly starts
    the page's text does, or one that holds all text.
    """
    named = [n for n in order if n.comment and not n.dropped]
    if not named:
        return
    own = _own_text(order)
    page, seen, before = own[order[0]], 0, {}
    todo = [order[0]]
    while todo:  # characters before each node, in page order
        n = todo.pop()
        if isinstance(n, str):
            seen += len("".join(n.split()))
            continue
        before[n] = seen
        if n.tag != "a":
            todo.extend(p for p in reversed(n.parts) if isinstance(p, str) or not p.dropped)
    marks = dict.fromkeys(order, False)  # holds a heading or an article
    for n in reversed(order):
        if not n.dropped and own[n]:
            marks[n] = marks[n] or n.tag in HEADINGS or n.tag in ("article", "main")
            if n.parent is not None and marks[n]:
                marks[n.parent] = True
    while named:
        within: dict[_Node, bool] = {order[0]: False}
        for n in order[1:]:
            within[n] = within[n.parent] or n.comment
        marked = any(n.tag in ("article", "main") and not within[n] and own.get(n) for n in order)
        outer = [n for n in named if not within[n.parent]]
        kept = [n for n in outer if own[n] == page or (not marked and marks[n] and 4 * before[n] < own[n])]
        for n in kept:
            n.comment = False
        if not kept:
            for n in order[1:]:
                n.dropped = n.dropped or n.comment or n.parent.dropped
            return
        named = [n for n in named if n.comment]


def _drop_marked(order: list[_Node]) -> None:
    """Drops comments, and the subtrees whose name is wholly furniture and that hold nothing of the article; hands the factors down.

    A form is such a subtree by its tag; one that is kept lowers nothing.
    """
    _drop_comments(order)
    if all(n.factor == 1.0 for n in order):
        return
    scope: dict[_Node, tuple] = {order[0]: (None, None, False)}  # nearest article or main, nearest heading, below a marked name
    started = set()
    for n in order[1:]:
        article, heading, marked = scope[n.parent]
        article, heading = (n if n.tag in ("article", "main") else article), (n if n.tag in HEADINGS else heading)
        scope[n] = article, heading, marked or n.factor < 1
        n.holds = n.tag in ("article", "main", "h1")
        if article not in started and not n.dropped and any(isinstance(x, str) and x.strip() for x in n.parts):
            started.add(article)
            if article is not None and heading is not None:
                heading.holds = True  # an article starts with its heading
    own = _own_text(order)
    for n in reversed(order):
        if not n.dropped:
            n.holds = n.holds or any(not isinstance(part, str) and not part.dropped and part.holds for part in n.parts)
    page = own[order[0]]
    # a page that marks its article says itself that large texts beside it are not part of it
    beside = any(n.tag in ("article", "main") and own.get(n) and not scope[n][2] for n in order)
    code = {order[0]: False}  # names in program text are those of its highlighter
    for n in order[1:]:
        up = n.parent
        code[n] = code[up] or up.tag in ("pre", "code")
        if up.dropped:
            n.dropped = True
        if n.dropped:
            continue
        large = own[n] >= LARGE_SHARE * page and not (beside and scope[n][0] is None)
        if n.factor == WHOLLY and n.tag not in TEXT_BLOCKS and not n.holds and not large and not code[n]:
            n.dropped = True
        elif n.tag == "form":
            n.factor = up.factor
        elif n.tag not in ("article", "main"):  # a marked article counts whole wherever it stands
            n.factor *= up.factor


def _measure(order: list[_Node]) -> None:
    """Counts, densities and scores, children before parents."""
    for n in reversed(order):
        if n.dropped:
            continue
        for part in n.parts:
            if isinstance(part, str):
                n.chars += len("".join(part.split()))
            elif not part.dropped:
                n.chars += part.chars
                n.tags += part.tags + 1
                n.link_chars += part.link_chars
                n.link_tags += part.link_tags + (part.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars


def _density(n: _Node, body: _Node) -> float:
    """Characters per tag, lowered by the share of link text and link tags."""
    if not n.chars:
        return 0.0
    tags, links, link_tags = n.tags or 1, n.link_chars or 1, n.link_tags or 1
    base = math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + body.link_chars / max(1, body.chars) * n.chars + math.e)
    inner = n.chars / links * tags / link_tags
    return n.chars / tags * (math.log(max(inner, 1.0)) / math.log(max(base, 1.0001)) if base > 1 else 0.0)


def _blocks(top: _Node) -> list[str]:
    """Texts of the blocks below ``top`` in page order, white space folded."""
    out: list[str] = []
    run: list[str] = []

    def flush():
        text = " ".join("".join(run).split())
        if text:
            out.append(text)
        run.clear()

    todo: list = [iter((top,))]
    closing: list[bool] = [False]
    while todo:
        part = next(todo[-1], None)
        if part is None:
            todo.pop()
            if closing.pop():
                flush()
        elif isinstance(part, str):
            run.append(part)
        elif not part.dropped:
            if part.tag == "br":
                run.append(" ")
                continue
            block = part.tag in BLOCKS
            if block:
                flush()
            todo.append(iter(part.parts))
            closing.append(block)
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article text of one page; empty when there is none."""
    if not html:
        return ""
    parser = _Builder()
    parser.feed(html)
    parser.close()
    order = parser.order
    _drop_marked(order)
    _measure(order)
    body = next((n for n in order if n.tag == "body" and not n.dropped), parser.root)
    inside = [n for n in order if not n.dropped]
    for n in inside:
        n.density = _density(n, body) * n.factor
        if n.parent is not None:
            n.parent.score += n.density
    best = max(inside, key=lambda n: n.score)  # the first one wins a tie: parents come before children
    if best.score <= 0:
        return "\n\n".join(_blocks(body))
    # threshold: the least density on the path from the best-scored node to the body
    threshold, at = best.density, best
    while at is not None and at is not body and at.parent is not None:
        at = at.parent
        if at.density:
            threshold = min(threshold, at.density)
    best = max((n for n in inside if n.density >= threshold), key=lambda n: n.score, default=body)
    at = best
    while at is not None:  # a marked article around the chosen subtree also holds its headings
        if at.tag in ("article", "main"):
            best = at
            break
        at = at.parent
    return "\n\n".join(_blocks(best))


def extract_main_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns plus text and n_chars (code points) for every page row.

    Null or empty html gives an empty text.  Rows are independent: repeated
    rows and null ids pass through unchanged; of subtrees with equal scores the first
    in page order wins; very long pages are parsed whole, one at a time; other
    columns (whatever their names) are not read.  An empty table gives an empty result.
    """
    from auditlens.llm.common import ready
    ready(pages.sparkSession)

    @F.pandas_udf("string")
    def article(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(x) for x in s], dtype=object)

    out = pages.select(*keep, article(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
