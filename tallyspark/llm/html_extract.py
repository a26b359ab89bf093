"""Operator 2, HTML extraction by tag-path ratios.

A page is walked once into text blocks, each with its root-to-leaf tag path (block tags with their
class). Per path the text length and the punctuation are summed over its blocks and divided by their
number; both ratios are smoothed over neighbouring blocks with a Gaussian, fused by their product,
and a path is content if the mean of its blocks reaches ``LAMBDA`` standard deviations. The deepest element
that holds nearly all text of the content paths is widened to hold all content around it, within an enclosing ``article``
or ``main`` if there is one, and then to the nearest such element; without one the result runs from the first content
to the last, with headings just before it. The blocks of the article are the result, except those inside elements that by name are menus, headers, footers, notices, adverts, forms or comments.

Defined results: null or empty html gives an empty text. Character references are decoded, white
space inside a block becomes one space, blocks are joined by ``\\n`` in page order. Unclosed tags,
comments and scripts end where a browser ends them, at the latest with the page. Pages are row-local:
equal rows give equal results, columns of other names are not read. Nothing is cut.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea select object canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var nobr center "
    "math semantics mrow mi mo mn ms mtext msub msup msubsup mfrac msqrt mroot mover munder munderover mstyle".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

#: Names of elements, classes, ids and roles that hold no article text.
BOILERPLATE_TAGS = frozenset("head nav footer aside form button dialog menu fieldset audio video".split())
BOILERPLATE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promos?|banners?|cookies?|consent|notices?|"
    r"alerts?|popups?|modals?|overlays?|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|aside|header|masthead|"
    r"footers?|comments?|replies|respond|disqus|share|sharing|social|related|recommended|newsletter|"
    r"subscribe|subscription|signup|login|search|widgets?|pagination|pager|toolbar|skip|hidden|complementary|"
    r"contentinfo)(?=$|[\s_-])", re.I)

#: Words that also name a page's layout: a holder of an ``article`` or ``main`` is not named a sidebar for being one.
LAYOUT_WORDS = re.compile(r"(?:^|[_-])(?:nav|navbar|navigation|menus?|sidebars?|aside|header|masthead|footers?|banners?|toolbar|hidden)(?:$|[_-])", re.I)
#: Words that, as a part of the name of one paragraph within an article, may be what it is about.
TOPIC_WORDS = re.compile(r"(?:^|[_-])(?:nav|navigation|menus?|search|related|header|footers?|share|sharing|social|sidebars?|alerts?|widgets?)(?:$|[_-])", re.I)
PARAGRAPHS = frozenset("p li dd td blockquote pre figcaption".split())

LAYOUT_NAMES = re.compile(r"(?:has|with|without|no|show|hide)[_-]", re.I)
HEADING_NAMES = re.compile(r"(?:article|entry|post|story|content)[_-]header$", re.I)

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

LAMBDA = 0.5
SIGMA = 1.0
ARTICLE_SHARE = 0.8
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"
    r"<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|"
    r"<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
WHITE = re.compile(r"\s+")


class Element:
    """``own``: what its tag (2) or its names (1) say against its text; ``bad``: whether it or one around it has that mark."""

    __slots__ = ("up", "tag", "path", "own", "depth")

    def __init__(self, up: Element | None, tag: str, names: str, own: int) -> None:
        self.up, self.tag, self.depth, self.own = up, tag, up.depth + 1 if up else 0, own
        self.path = (up.path + "/" if up else "") + tag + ("." + names if names else "")

    @property
    def bad(self) -> bool:
        node = self
        while node:
            if node.own:
                return True
            node = node.up
        return False


def attributes(attrs: str) -> dict[str, str]:
    return {name.lower(): v1 or v2 or v3 for name, v1, v2, v3 in reversed(ATTRIBUTE.findall(attrs))}


def unseen(attrs: dict[str, str]) -> bool:
    """An element that its attributes hide; words in a value, of a title for instance, do not."""
    return "hidden" in attrs or attrs.get("aria-hidden", "").strip().lower() == "true" or bool(UNSEEN_STYLE.search(attrs.get("style", "")))


def inline_end(page: str, tag: str, at: int) -> int:
    """Where an inline element that began before ``at`` ends, elements of its tag inside it counted."""
    depth = 1
    for m in re.compile(rf"<(/?){re.escape(tag)}(?=[\s/>])[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else not m[0].endswith("/>")
        if not depth:
            return m.end()
    return at


def blocks_of(page: str) -> list[tuple[Element, str]]:
    """(element, text) of every block that has text, in page order."""
    here, out, parts, at = Element(None, "", "", 0), [], [], 0

    def flush() -> None:
        if parts:
            text = WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append((here, text))
            parts.clear()

    while m := TAG.search(page, at):
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            if m["cdata"]:
                parts.append(m["cdata"])
            continue
        tag, attrs = name.lower(), m["attrs"] or m["attrs2"] or ""
        if m["end"] or m["end2"]:
            if tag in INLINE or tag in VOID:
                continue
            node = here
            while node.up and node.tag != tag:
                node = node.up
            if node.up:
                flush()
                here = node.up
            continue
        if tag in RAW:
            if not attrs.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if tag in INLINE:
            if attrs:
                given = attributes(attrs)
                if unseen(given) or named_boilerplate(naming(given), True):
                    at = inline_end(page, tag, at)
            continue
        if tag in VOID:
            parts.append(" ")
            continue
        flush()
        node = here
        while node.up and node.tag == "p":  # a block start ends an open paragraph
            node = here = node.up
        if tag in CLOSES:
            node = here
            while node.up and node.tag not in SCOPES.get(tag, ()):
                if node.tag in CLOSES[tag]:
                    here = node.up
                node = node.up
        if tag == "body":  # the head ends here, closed or not
            while here.up and here.tag == "head":
                here = here.up
        in_article = "/article" in here.path or "/main" in here.path
        own = 2 if tag in BOILERPLATE_TAGS or (tag == "header" and not in_article) else 0
        names = ""
        if attrs:
            given = attributes(attrs)
            names = naming(given)
            if unseen(given):
                own = 2
            elif not own and tag not in ("html", "body", "main", "article"):
                own = int(named_boilerplate(names, in_article, in_article and tag in PARAGRAPHS))
        if tag in ("article", "main"):  # the names of what holds it spoke of the page's layout
            node = here
            while node:
                if node.own == 1 and LAYOUT_WORDS.search(node.path.rpartition("/")[2].replace(" ", "_")):
                    node.own = 0
                node = node.up
        here = Element(here, tag, names, own)
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def naming(attrs: dict[str, str]) -> str:
    """Classes, id and role, in the order given."""
    return " ".join(attrs[name] for name in attrs if name in ("class", "id", "role"))


def named_boilerplate(names: str, in_article: bool, paragraph: bool = False) -> bool:
    """Whether an element's names say that it holds no article text; layout names such as ``has-sidebar`` do not.

    Of a ``paragraph`` of an article a word within a longer name, as in ``related-work``, says nothing.
    """
    for name in names.split():
        if LAYOUT_NAMES.match(name):
            continue
        found = BOILERPLATE_NAMES.search(name)
        heading = HEADING_NAMES.match(name) or (in_article and name.lower().endswith("header"))
        topic = paragraph and ("-" in name or "_" in name) and TOPIC_WORDS.search(name)
        if found and not heading and not topic:
            return True
    return False


def smooth(values: list[float]) -> list[float]:
    """Gaussian over the two neighbours on either side."""
    kernel = [math.exp(-(k * k) / (2 * SIGMA * SIGMA)) for k in range(-2, 3)]
    out = []
    for i in range(len(values)):
        near = [(kernel[k + 2], values[i + k]) for k in range(-2, 3) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def content_paths(blocks: list[tuple[Element, str]]) -> tuple[set[str], set[str]]:
    """Paths whose smoothed, fused ratios reach the threshold, and those whose own ratios do."""
    total: dict[str, list[float]] = {}
    for element, text in blocks:
        sums = total.setdefault(element.path, [0, 0, 0])
        sums[0] += len(text)
        sums[1] += len(PUNCTUATION.findall(text))
        sums[2] += 1
    length = smooth([total[e.path][0] / total[e.path][2] for e, _ in blocks])
    marks = smooth([(1 + total[e.path][1]) / total[e.path][2] for e, _ in blocks])
    fused = [a * b for a, b in zip(length, marks, strict=True)]
    mean = sum(fused) / len(fused)
    deviation = math.sqrt(sum((v - mean) ** 2 for v in fused) / len(fused))
    by_path: dict[str, list[float]] = {}
    for (element, _), value in zip(blocks, fused, strict=True):
        by_path.setdefault(element.path, []).append(value)
    scores = {path: sum(v) / len(v) for path, v in by_path.items()}
    best = max(scores.values())
    paths = {path for path, v in scores.items() if v >= min(best, LAMBDA * deviation)}
    plain = {path for path, (n, m, k) in total.items() if n / k * ((1 + m) / k) >= LAMBDA * deviation}
    return paths, plain


def up_to(element: Element | None, kinds: tuple[str, ...]) -> list[Element]:
    """The element and those around it, inside out, that are of these tags."""
    out = []
    while element:
        if element.tag in kinds:
            out.append(element)
        element = element.up
    return out


def inside(element: Element | None, around: Element) -> bool:
    while element and element.depth > around.depth:
        element = element.up
    return element is around


def common(a: Element, b: Element) -> Element:
    """The deepest element that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
    return a


def main_text(page: str | None) -> str:
    if not page:
        return ""
    blocks = [(e, t) for e, t in blocks_of(page) if not e.bad]
    if not blocks:
        return ""
    # what stands beside the page's articles is none of them, however long
    within = [(e, t) for e, t in blocks if up_to(e, ("article", "main"))]
    blocks = within or blocks
    paths, plain = content_paths(blocks)
    weight: dict[Element, int] = {}
    chosen = 0
    for element, text in blocks:
        if element.path in paths:
            chosen += len(text)
            node = element
            while node:
                weight[node] = weight.get(node, 0) + len(text)
                node = node.up
    holders = [e for e, n in weight.items() if n >= ARTICLE_SHARE * chosen and e.tag != "p"]
    holder = max(holders, key=lambda e: e.depth)
    # content outside the holder belongs to the article if its own ratios say so, not only its neighbours'
    content = [e.path in paths and e.path in plain for e, _ in blocks]
    around = up_to(holder, ("article", "main"))
    article = holder
    for (element, _), good in zip(blocks, content, strict=True):
        if good and (not around or inside(element, around[-1])):
            article = common(article, element)
    named = up_to(article, ("article",)) or up_to(article, ("main",))
    if named:
        article = named[0]
        return "\n".join(text for element, text in blocks if inside(element, article))
    # no element that by its name is the article: from the first content to the last, headings before it included
    held = [k for k, (element, _) in enumerate(blocks)
            if inside(element, holder) or (content[k] and inside(element, article))]
    first, last = held[0], held[-1]
    while first and blocks[first - 1][0].tag in HEADINGS:
        first -= 1
    return "\n".join(text for _, text in blocks[first:last + 1])


def extract_main_text(pages: DataFrame, markup: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, ``text`` and its code points ``n_chars``, for every row."""

    @F.pandas_udf("string")
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages_ in parts:
            yield pages_.map(main_text, na_action=None)

    out = pages.select(*keep, texts(F.col(markup)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
