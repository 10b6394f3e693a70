"""Main text of HTML pages (operator 8).

The standard library's parser streams events; block elements cut the page into
lines. Each line has a text-to-tag ratio. A Gaussian smooths the ratios, lines at
or over a threshold cluster into content regions, and the regions choose the article: the
parts that the page itself calls article or main and that hold enough of the regions, or
else the innermost container of all regions with the headings beside it. A chosen part is
taken whole, short lines too, but for what is vetoed and for lists of links at its edges.

Scripts, styles, controls and hidden elements are always vetoed. Menus, notices, forms,
adverts, comments and the like are vetoed by their element, role or class words, weighed
against the text that they hold: one that holds most of the page's text, with little or
nothing of the page left beside it, is the page's wrapper and stays. Ids count only where they are wholly a
mark, and in an article only for brief parts; there, classes that only mention a mark don't count. Words that say what a
page hasn't or how it is set (``no-comments``, ``has-sidebar``, ``comments-open``) mark nothing.

Every step is linear in the page: elements are numbered in page order and know their
parent, so sums run from the last to the first and flags from the first to the last.

Defined results: null, empty and text-free pages give an empty text; characters are decoded; a tag
that the page's end cuts off goes;
markup that the parser refuses is read again with the offending declarations removed; very
long or deep pages are read whole; repeated rows give repeated results; of extra columns none
is used, and a kept one named like a result gives way to it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, with_text_columns

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
#: Elements that never hold text of an article.
NEVER = frozenset("annotation annotation-xml button canvas datalist head iframe input label noscript object optgroup option script select style svg template textarea title".split())
#: Elements and roles of a page's surroundings.
AROUND = frozenset("aside dialog footer form menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: Class or id words that mark such parts.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adslot sponsor sponsored promo promotion banner "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar rail widget "
    "footer copyright disclaimer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended form".split()
)
READERS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: Words after which a mark is denied or only mentioned, and words that turn it into a state.
DENIED = frozenset("no not non without has have with is show hide enable disable can".split())
STATES = frozenset("open opened closed enabled disabled on off active inactive visible allowed true false".split())
#: Words that only place, number or wrap the part that a mark names.
NEUTRAL = frozenset(
    "a b c i area bar block body bottom box center column container content desktop div fixed form global group header inner item items large left "
    "list lg main md mobile outer panel page posts primary right row secondary section sm site slot small sticky tertiary text thread top unit wrap wrapper xs zone".split()
)
#: What an article's own header is called.
OWN = frozenset("article content entry post story text title".split())
#: Containers that their class words don't rule out.
ROOTS = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article aside blockquote body div dl fieldset figure footer form header html main nav ol section table td th ul".split())

SIGMA, RADIUS = 1.0, 3
#: Share of the regions' text that the elements which the page itself calls article or main hold at least.
NAMED = 0.3
#: Share of a page's text over which a marked element can be the page's wrapper, and the text beside it by its own, at most.
WRAPPER, BESIDE = 0.5, 0.1
#: Share of an article's text that a container or a heading before it adds at most; characters of a line of prose.
ADDED, PROSE = 0.3, 80
#: Elements that can hold a whole article.
HOLDERS = frozenset("article body center details div html main search section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 header hgroup".split())

#: Kinds of veto: none, always, by an id in an article (of what is brief alone), by a name that mentions a mark, by a mark, by a mark of readers' parts.
NONE, ALWAYS, BRIEF, WEAK, STRONG, OF_READERS = range(6)
#: Characters from which on a part is more than a remark.
LONG = 200
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
_OPENER = re.compile(r"<[A-Za-z/!?]")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)


def name_kind(name: str) -> int:
    """The veto that one class or id asks for: strong where it is a mark with words that place it."""
    words = _NAME.findall(_CAMEL.sub(r"\1 \2", name).lower())
    marks = [w for w in words if w in MARKS or w in READERS]
    if not marks or words[0] in DENIED or words[-1] in STATES:
        return NONE
    if all(w in MARKS or w in READERS or w in NEUTRAL or w in OWN for w in words):
        return OF_READERS if any(w in READERS for w in marks) else STRONG
    return WEAK


class _Line:
    __slots__ = ("parts", "tags", "element", "text", "linked")

    def __init__(self, element: int):
        self.parts: list[tuple[int, bool, str]] = []  # element, in a link, text
        self.tags, self.element, self.text, self.linked = 0, element, "", False


class Page(HTMLParser):
    """Elements in page order and the lines that block elements cut."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.kinds = ["#page"], [0], [NONE]
        self.stack, self.linked, self.blocks = [0], [False], [0]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.lines: list[_Line] = []
        self.line = _Line(0)

    def _break(self) -> None:
        tags = self.line.tags
        if self.line.parts:
            self.lines.append(self.line)
            tags = 0
        self.line = _Line(self.blocks[-1])
        self.line.tags = tags

    def _pop_to(self, place: int) -> None:
        """Close the element at a place of the stack and all within it."""
        while len(self.stack) > place:
            tag = self.tags[self.stack.pop()]
            self.linked.pop()
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            if tag in BLOCK:
                self.blocks.pop()

    def _close(self, names: tuple[str, ...]) -> None:
        """Close the innermost of some elements, unless a scope began within it."""
        place = max((self.places[n][-1] for n in names if self.places.get(n)), default=0)
        if place and place >= (self.scopes[-1] if self.scopes else 0):
            self._pop_to(place)

    def _kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> int:
        if tag in NEVER:
            return ALWAYS
        found = STRONG if tag in AROUND else NONE
        if tag == "footer" and self.places.get("blockquote"):
            found = NONE  # whom a quotation is of
        root = tag in ROOTS
        for key, value in attrs:
            value = value or ""
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
                if tag not in ("html", "body"):
                    return ALWAYS
            elif key == "role" and value.lower() in ROLES and not root:
                found = max(found, STRONG)
            elif key in ("class", "id") and tag not in ("html", "body", "main"):
                for name in value.split():
                    kind = name_kind(name)
                    # An id is often made of a heading, and in an article a class that only mentions a mark is its own.
                    if kind == WEAK and (key == "id" or self._in_article()):
                        continue
                    if kind == STRONG and key == "id" and self._in_article():
                        kind = BRIEF
                    if not root or kind == OF_READERS:
                        found = max(found, kind)
                    if self._header(name) and not root and not self._in_article():
                        found = max(found, STRONG)
        if tag == "header" and not self._in_article():
            found = max(found, STRONG)  # a page's header; an article's own holds its title
        return found

    def _in_article(self) -> bool:
        return bool(self.places.get("article") or self.places.get("main"))

    @staticmethod
    def _header(name: str) -> bool:
        words = _NAME.findall(name.lower())
        return bool(words) and words[-1] == "header" and not OWN.intersection(words[:-1])

    def handle_starttag(self, tag, attrs):
        block = tag in BLOCK
        if block:
            self._close(("p",))
        if tag in CLOSED_BY_OWN:
            self._close(CLOSED_BY_OWN[tag])
        self.line.tags += 1
        if tag == "br" and self.line.parts:
            self.line.parts.append((self.stack[-1], False, " "))
        if tag in VOID:
            if tag == "hr":
                self._break()
            return
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.kinds.append(self._kind(tag, attrs))
        number = len(self.tags) - 1
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.linked.append(tag == "a" or self.linked[-1] and not block)
        self.stack.append(number)
        if block:
            self.blocks.append(number)
            self._break()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash at the end means nothing in HTML

    def handle_endtag(self, tag):
        self.line.tags += 1
        if self.places.get(tag):
            self._pop_to(self.places[tag][-1])
            if tag in BLOCK:
                self._break()

    def handle_data(self, data):
        self.line.parts.append((self.stack[-1], self.linked[-1], data))


def finished(html: str) -> str:
    """The page without a tag that its end cuts off; a comment that never ends is read as text.

    The parser would look for either's end again at each place where one begins.
    """
    cut = html.rfind(">") + 1
    if unfinished := _OPENER.search(html, cut):
        html = html[: unfinished.start()]
    last = html.rfind("-->") + 3 if "-->" in html else 0
    return html[:last] + html[last:].replace("<!--", "&lt;!--")


def read_page(html: str) -> Page:
    html = finished(html)
    page = Page()
    try:
        page.feed(html)
        page.close()
    except AssertionError:
        page = Page()
        page.feed(re.sub(r"<!\[[^>]*>?", " ", html))
        page.close()
    page._break()
    return page


def summed(values: list[int], parents: list[int]) -> list[int]:
    """Each element's value with those of all within it."""
    out = list(values)
    for e in range(len(out) - 1, 0, -1):
        out[parents[e]] += out[e]
    return out


def spread(flags: list[bool], parents: list[int]) -> list[bool]:
    """Which elements are flagged or within a flagged one."""
    out = list(flags)
    for e in range(1, len(out)):
        out[e] = out[e] or out[parents[e]]
    return out


def vetoed(page: Page) -> list[bool]:
    """Which elements' text can't be the article's, for themselves or for what they are within."""
    parents, kinds = page.parents, page.kinds
    never = spread([k == ALWAYS for k in kinds], parents)
    own = [0] * len(kinds)
    for line in page.lines:
        for e, _, text in line.parts:
            if not never[e]:
                own[e] += len(text.strip())
    mass = summed(own, parents)
    # Text that no mark within an element covers.
    free = list(own)
    for e in range(len(free) - 1, 0, -1):
        if kinds[e] in (NONE, BRIEF):
            free[parents[e]] += free[e]
    total, plain = mass[0], free[0]
    out = [False] * len(kinds)
    for e in range(1, len(kinds)):
        kind = kinds[e]
        if out[parents[e]] or kind == ALWAYS:
            out[e] = True
        elif kind == BRIEF:
            out[e] = mass[e] < LONG
        elif kind != NONE:
            beside = 0 if kind == OF_READERS else mass[e] if kind == WEAK else BESIDE * mass[e]
            if mass[e] > WRAPPER * total and plain <= beside:
                plain += free[e]  # the page's wrapper
            else:
                out[e] = True
    return out


def smoothed(ratios: Sequence[float]) -> list[float]:
    kernel = [math.exp(-0.5 * (k / SIGMA) ** 2) for k in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(ratios)):
        near = [(w, ratios[i + k]) for w, k in zip(kernel, range(-RADIUS, RADIUS + 1), strict=True) if 0 <= i + k < len(ratios)]
        out.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    return out


def content_lines(ratios: Sequence[float]) -> list[bool]:
    """Which lines lie in content regions: runs whose smoothed ratio reaches its own standard deviation.

    Smoothing fills gaps but doesn't stretch a region: it begins and ends with lines that reach it themselves.
    """
    if not ratios:
        return []
    smooth = smoothed(ratios)
    mean = sum(smooth) / len(smooth)
    threshold = math.sqrt(sum((r - mean) ** 2 for r in smooth) / len(smooth))
    out = [False] * len(ratios)
    run: list[int] = []
    for i, r in enumerate([*smooth, -1.0]):
        if r >= threshold:
            run.append(i)
        elif run:
            dense = [j for j in run if ratios[j] >= threshold]
            if dense:
                out[dense[0] : dense[-1] + 1] = [True] * (dense[-1] + 1 - dense[0])
            run = []
    return out


def named_parts(page: Page, mass: list[int]) -> set[int]:
    """The outermost elements that the page calls article or main, each narrowed to an inner one that holds the same."""
    outer, best = [0] * len(mass), {}
    for e in range(1, len(mass)):
        outer[e] = outer[page.parents[e]]
        if mass[e] and page.tags[e] in ("article", "main"):
            outer[e] = outer[e] or e
            if mass[e] == mass[outer[e]]:
                best[outer[e]] = e
    return set(best.values())


def common_part(page: Page, lines: list[_Line], regions: list[_Line]) -> list[bool]:
    """Which lines stand in the innermost container of all regions, with what belongs to it.

    The container grows over holders below the body while what they add is little and not mostly links (a lead, a
    title in a box of its own, a short end). Then come the lines from the nearest heading before it on.
    """
    tags, parents = page.tags, page.parents
    held, mass, linked = ([0] * len(tags) for _ in range(3))
    for x in regions:
        held[x.element] += 1
    for x in lines:
        mass[x.element] += len(x.text)
        linked[x.element] += len(x.text) * x.linked
    held, mass, linked = (summed(v, parents) for v in (held, mass, linked))
    part = max(e for e, n in enumerate(held) if n == len(regions))
    leaves = {x.element for x in lines}
    while part and (tags[part] not in HOLDERS or len(regions) == 1 and part in leaves):
        part = parents[part]
    if not part:
        return [True] * len(lines)
    above = parents[part]
    while above and tags[above] in HOLDERS and tags[above] not in ("html", "body"):
        more = mass[above] - mass[part]
        if more > ADDED * mass[part] or 2 * (linked[above] - linked[part]) > more:
            break
        part, above = above, parents[above]
    within = spread([e == part for e in range(len(tags))], parents)
    inside = [within[x.element] for x in lines]
    first = inside.index(True)
    heads = spread([t in HEADINGS for t in tags], parents)
    start, between = first, 0
    for i in range(first - 1, -1, -1):
        x = lines[i]
        if heads[x.element] and x.text:
            start = i  # with the headings right before it
        elif start < first:
            break
        elif (between := between + len(x.text)) > ADDED * mass[part]:
            break
    return [start <= i < first or x for i, x in enumerate(inside)]


def menus(page: Page, lines: list[_Line], regions: list[_Line], inside: list[bool]) -> list[bool]:
    """Which elements are, or are within, lists whose lines are links alone.

    Of the lists of an article (the lines ``inside``), one with regions of prose before and after it is its own.
    """
    any_line, plain_line = [0] * len(page.tags), [0] * len(page.tags)
    first, last = [len(lines)] * len(page.tags), [-1] * len(page.tags)
    for i, x in enumerate(lines):
        if x.text:
            any_line[x.element] += 1
            plain_line[x.element] += not x.linked
            first[x.element], last[x.element] = min(first[x.element], i), max(last[x.element], i)
    any_line, plain_line = summed(any_line, page.parents), summed(plain_line, page.parents)
    for e in range(len(first) - 1, 0, -1):
        p = page.parents[e]
        first[p], last[p] = min(first[p], first[e]), max(last[p], last[e])
    chosen = set(map(id, regions))
    prose = [i for i, (x, yes) in enumerate(zip(lines, inside, strict=True)) if yes and id(x) in chosen and not x.linked and len(x.text) >= PROSE]
    least, most = (prose[0], prose[-1]) if prose else (len(lines), -1)
    return spread([t in ("ul", "ol") and n > 0 and not p and not least < a <= b < most for t, n, p, a, b in zip(page.tags, any_line, plain_line, first, last, strict=True)], page.parents)


def main_text(html: str | None) -> str:
    """The article of one page, its blocks joined by newlines."""
    if not html:
        return ""
    page = read_page(html)
    out = vetoed(page)
    lines = page.lines
    for x in lines:
        # An inline part that is vetoed still parts the words around it.
        x.text = " ".join("".join(" " if out[e] else text for e, _, text in x.parts).split())
        x.linked = not any(text.strip() and not linked and not out[e] for e, linked, text in x.parts)
    # Lines of white space alone aren't lines; their tags belong to the next one.
    kept, tags = [], 0
    for x in lines:
        x.tags += tags
        tags = 0 if x.text or any(text.strip() for _, _, text in x.parts) else x.tags
        if not tags:
            kept.append(x)
    lines = kept
    chosen = content_lines([len(x.text) / max(1, x.tags) for x in lines])
    regions = [x for x, yes in zip(lines, chosen, strict=True) if yes and x.text] or [x for x in lines if x.text]
    if not regions:
        return ""
    mass = [0] * len(page.tags)
    for x in regions:
        mass[x.element] += len(x.text)
    mass = summed(mass, page.parents)
    named = named_parts(page, mass)
    if named and sum(mass[n] for n in named) >= NAMED * mass[0]:
        within = spread([e in named for e in range(len(page.tags))], page.parents)
        inside = [within[x.element] for x in lines]
    else:
        inside = common_part(page, lines, regions)
    menu = menus(page, lines, regions, inside)
    return "\n".join(x.text for x, yes in zip(lines, inside, strict=True) if yes and x.text and not menu[x.element])


def extract_pages(pages: DataFrame, html_col: str = "html", keep: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """Each row's main ``text`` and its length in code points."""

    def make():
        def work(pages):
            texts = [main_text(p) for p in pages]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return with_text_columns(pages, html_col, "text string, n_chars bigint", make, keep)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
