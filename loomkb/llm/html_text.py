"""Main text of web pages by two passes over their blocks."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Frequent function words of the languages served.
STOP_WORDS = frozenset(
    (
        "a about after all also an and any are as at be been before but by can could do for from had has have he her his how i if in into is it its "
        "more most my no not of on one only or other our out over she so some such than that the their them then there these they this to up was we were "
        "what when which who will with would you your "
        "aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im in ist ja kein man mit "
        "nach nicht noch nur oder sein sich sie sind so über um und uns unter von vor war was wenn wer wie wir wird zu zum zur "
        "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais même ne nous on ou où par pas plus pour qu que qui sa "
        "sans se ses si son sont sur te tu un une vous "
        "al algo como con cuando del desde donde e el ella ellos entre era esta este fue ha hasta hay la las lo los me mi muy más no nos o para pero por "
        "porque que se ser si sin sobre son su sus también tiene un una uno y ya"
    ).split()
)
#: Elements by what they mean for the text in them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe math noembed noframes noscript object script style svg template textarea title audio video canvas select button xmp".split())
BOILERPLATE = frozenset("aside dialog footer form head menu nav search fieldset".split())
CONTENT = frozenset("article main".split())
#: Class, id and role values that mark what is not the article, and those that mark it.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense alert banner billboard breadcrumb breadcrumbs comment commentlist comments complementary consent contentinfo "
    "cookie cookies copyright dialog discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination paywall "
    "popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget".split()
)
#: Words that may stand beside others in one value without a change of what it marks (cookie-notice, comments-area, site-footer).
BAD_SHAPES = frozenset(
    "area bar block body bottom box button buttons container form group inner item items left link links list panel post posts primary right secondary section site slot "
    "text top unit wrap wrapper".split()
)
GOOD_SHAPES = frozenset("blog body content full news single text".split())
#: These lie outside the article only; inside it they hold its own title.
OUTER_NAMES = frozenset("header".split())
GOOD_NAMES = frozenset("article articlebody articletext entry main maincontent post postbody story storybody".split())
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPS_LOW, STOPS_HIGH = 0.06, 0.12
LINKS_HIGH = 0.2

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
COMMENT_END = re.compile(r"--!?>")
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
HEADING = re.compile("h[1-6]")
LETTERS = re.compile(r"[^\W\d_]+")
WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
PAGE_TAGS = frozenset("body html main".split())


@dataclass
class Block:
    text: str
    link_chars: int
    element: int  # the innermost one around it
    place: str = ""  # what the elements around it say: good, bad or nothing
    heading: bool = False
    region: int = -1  # the innermost element around it that marks an article


@dataclass
class Element:
    around: int
    tag: str
    says: str  # bad, named (bad by its name, or a form), outer (bad outside an article) or nothing
    marks: bool  # whether it marks an article


@lru_cache(50_000)
def _named(value: str, names: frozenset[str], shapes: frozenset[str]) -> bool:
    """Whether a whole value is one of ``names``, or is made of them and of ``shapes`` alone."""
    if value.lower().replace("-", "").replace("_", "") in names:
        return True
    words = {w.lower() for w in WORD.findall(value)}
    return bool(words & names) and words <= names | shapes


def _element(around: int, tag: str, attributes: str) -> Element:
    """What an element by itself says about the text in it."""
    if tag in PAGE_TAGS:
        return Element(around, tag, "", tag == "main")
    values = [v for m in NAMES.finditer(attributes) for v in m[1].strip("\"'").split()] if attributes else []
    marks = tag in CONTENT or tag not in ("a", "span", "li") and any(_named(v, GOOD_NAMES, GOOD_SHAPES) for v in values)
    if tag in BOILERPLATE and tag != "form" or attributes and HIDDEN.search(attributes):
        return Element(around, tag, "bad", marks)
    if tag == "form" or any(_named(v, BAD_NAMES, BAD_SHAPES) for v in values):
        return Element(around, tag, "named", marks)
    return Element(around, tag, "outer" if tag == "header" or any(_named(v, OUTER_NAMES, BAD_SHAPES | {"page"}) for v in values) else "", marks)


def _wrappers(blocks: list[Block], elements: list[Element]) -> set[int]:
    """Elements with a bad name that hold main or most of the page's article text, and so say nothing about what is inside.

    The article text is the long text in article elements that have no bad name
    and lie in no such part of an article; without any, the page's good blocks; else its short ones.
    """
    if all(e.says in ("", "bad") for e in elements):
        return set()
    lost, own, apart = [], [], []  # below a bad element; in an article; in a part with a bad name within it
    for e in elements:
        top = e.around < 0
        lost.append(e.says == "bad" or not top and lost[e.around])
        told = not top and own[e.around] and elements[e.around].tag not in PAGE_TAGS
        apart.append(not top and apart[e.around] or e.says == "named" and told)
        own.append(not apart[-1] and e.says != "named" and (e.marks or not top and own[e.around]))
    left = [(b, first_pass(b)) for b in blocks if b.element < 0 or not lost[b.element]]
    within = [(b, x) for b, x in left if b.element >= 0 and own[b.element]]
    plain = lambda found: [b for b, x in found if x != "bad"]
    choices = [b for b, x in within if x in ("good", "near")], [b for b, x in left if x == "good"], plain(within), plain(left)
    text = next(filter(None, choices), [])
    share, main = [0] * len(elements), [e.tag == "main" and not x for e, x in zip(elements, lost, strict=True)]
    for b in text:
        if b.element >= 0:
            share[b.element] += len(b.text)
    for k in range(len(elements) - 1, -1, -1):
        if (up := elements[k].around) >= 0:
            share[up] += share[k]
            main[up] = main[up] or main[k]
    whole = sum(len(b.text) for b in text)
    return {k for k, e in enumerate(elements) if e.says in ("named", "outer") and (main[k] or 2 * share[k] > whole)}


def _place(blocks: list[Block], elements: list[Element]) -> list[int]:
    """Tell each block what the elements around it say together; the next region around each one that marks an article."""
    wrappers = _wrappers(blocks, elements)
    places: list[tuple[str, int]] = []
    outer = [-1] * len(elements)
    for k, e in enumerate(elements):
        place, region = places[e.around] if e.around >= 0 else ("", -1)
        if place != "bad":
            if e.says == "bad" or k not in wrappers and (e.says == "named" or e.says == "outer" and place != "good"):
                place = "bad"
            elif e.marks:
                outer[k] = region
                place, region = "good", k
        places.append((place, region))
    for b in blocks:
        if b.element >= 0:
            b.place, b.region = places[b.element]
    return outer


class Tags:
    """The tags of a page in order, each found in time that is in proportion to the page on the whole."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.doomed: set[int] = set()  # quotes that open where no tag ends any more
        self.unclosed: set[str] = set()  # raw elements without a further end tag

    def end(self, at: int) -> int:
        """The end of the tag whose name ends at ``at``: a > outside quotes, or the next one if quotes don't close."""
        pos, opened = at, []
        while m := STOP.search(self.page, pos):
            if m[0] == ">":
                return m.end()
            if m.start() in self.doomed:
                break
            opened.append(m.start())
            pos = self.page.find(m[0], m.end()) + 1
            if not pos:
                break
        self.doomed.update(opened)
        return self.page.find(">", at) + 1

    def raw_end(self, tag: str, at: int) -> int:
        """After the end tag of a raw element, or -1."""
        found = None if tag in self.unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(self.page, at)
        if not found:
            self.unclosed.add(tag)
        return found.end() if found else -1

    def after(self, at: int) -> tuple[int, int, str]:
        """Start, end and name ("" for comments and declarations, "/" before that of an end tag) of the next tag; (size, size, "") at the end."""
        page, size = self.page, len(self.page)
        k = page.find("<", at)
        while k >= 0:
            if page.startswith("<!--", k):
                m = COMMENT_END.search(page, k + 4)
                return k, m.end() if m else size, ""
            if k > self.last:  # no tag ends any more, but a comment may begin
                k = page.find("<!--", k)
                return (k, size, "") if k >= 0 else (size, size, "")
            if page.startswith(("<!", "<?"), k):
                return k, page.find(">", k) + 1, ""
            if m := NAME.match(page, k):
                return k, self.end(m.end()), ("/" if page[k + 1] == "/" else "") + m[1].lower()
            k = page.find("<", k + 1)
        return size, size, ""


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """The page's blocks of text in order (what stands between block elements' tags, raw elements left out), and the regions around regions."""
    found: list[Block] = []
    elements: list[Element] = []
    stack: list[tuple[str, int]] = []  # open elements
    opened: Counter[str] = Counter()  # how many of each are open
    text: list[str] = []
    links, at, inside, heads = 0, 0, -1, 0  # heads: open headings

    def flush():
        nonlocal links
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                found.append(Block(joined, links, inside, heading=heads > 0))
            text.clear()
        links = 0

    def say(raw: str):
        nonlocal links
        if raw:
            own = html.unescape(raw) if "&" in raw else raw
            text.append(own)
            if opened["a"]:
                links += len(own.strip())

    def close(k: int):
        nonlocal heads
        for x, _ in stack[k:]:
            opened[x] -= 1
            heads -= HEADING.fullmatch(x) is not None
        del stack[k:]

    tags, size = Tags(page), len(page)
    while at < size:
        start, end, tag = tags.after(at)
        say(page[at:start])
        at = end
        if not tag:
            continue
        closing, tag = tag[0] == "/", tag.lstrip("/")
        attributes = page[start + 1 + closing + len(tag) : end - 1]
        if tag == "br":
            text.append(" ")
            continue
        alone = attributes.endswith("/")
        if tag in RAW and not closing:
            stop = -1 if alone else tags.raw_end(tag, at)
            if stop >= 0:
                at = stop
            elif not alone and tag in ("script", "style", "textarea", "title"):
                at = size
            continue
        block = tag in BLOCKS
        if block:
            flush()
        if closing:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
        elif tag not in VOID:
            ends = "p" if block else "a" if tag == "a" else ""  # an open paragraph ends at the next block; a link at the next link
            if ends and opened[ends]:
                k = len(stack) - 1
                while stack[k][0] != ends and stack[k][0] not in BLOCKS:
                    k -= 1
                if stack[k][0] == ends:
                    close(k)
            if not alone or block:
                if tag == "body":  # ends an open head
                    close(0)
                elements.append(_element(stack[-1][1] if stack else -1, tag, attributes))
                stack.append((tag, len(elements) - 1))
                opened[tag] += 1
                heads += HEADING.fullmatch(tag) is not None
        inside = stack[-1][1] if stack else -1
    flush()
    return found, _place(found, elements)


def first_pass(block: Block) -> str:
    """good, near, short or bad, by link density, length and stop-word density."""
    n = len(block.text)
    if block.link_chars > LINKS_HIGH * n:
        return "bad"
    if n < LENGTH_LOW:
        return "short"
    words = LETTERS.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stops >= STOPS_HIGH:
        return "good" if n > LENGTH_HIGH else "near"
    return "near" if stops >= STOPS_LOW or n > LENGTH_HIGH and not block.link_chars else "bad"


def _favoured(block: Block) -> str:
    """The first pass with what the elements around say as a prior: bad ones decide, an article's lift all but link lists and short blocks."""
    if block.place == "bad":
        return "bad"
    label = first_pass(block)
    if block.place == "good" and label != "short" and block.link_chars <= LINKS_HIGH * len(block.text):
        return "good"
    return label


def main_text(page: str) -> str:
    """The article of a page, its blocks joined by line feeds.

    Both passes take every block of every page. The first decides by links, length
    and stop words; the elements around a block are its prior: in menus, sidebars,
    adverts, forms, notices and comments it is bad, and in an article or main
    element, or one named like it, good unless it is short or a link list. In the second,
    near-good and short blocks take the label of their nearest decided neighbours: a near-good one
    if either is good, a short one if both are, or one is and a near-good block or, below a heading,
    text follows, or if the article element that it lies in holds a good block.
    """
    blocks, outer = blocks_of(page)
    labels = [_favoured(b) for b in blocks]
    decided, articles = list(labels), set()
    for b, x in zip(blocks, labels, strict=True):
        r = b.region if x == "good" else -1
        while r >= 0 and r not in articles:
            articles.add(r)
            r = outer[r]

    def neighbours(sure: tuple[str, ...]) -> list[tuple[str, str]]:
        """The labels of the nearest blocks before and after each one that are among ``sure``; bad beyond the ends."""
        sides = []
        for order in (range(len(labels)), range(len(labels) - 1, -1, -1)):
            near, last = ["bad"] * len(labels), "bad"
            for k in order:
                near[k] = last
                if labels[k] in sure:
                    last = labels[k]
            sides.append(near)
        return list(zip(*sides, strict=True))

    firm, soft = neighbours(("good", "bad")), neighbours(("good", "bad", "near"))
    for k, label in enumerate(labels):
        if label == "short":
            favoured, sides, near = blocks[k].place == "good", firm[k], soft[k]
            both = sides[0] == sides[1] == "good"
            headed = blocks[k].heading and near[1] in ("good", "near") and "good" in sides
            own = favoured and blocks[k].region in articles
            decided[k] = "good" if both or own or headed or "good" in sides and (favoured or "near" in near) else "bad"
        elif label == "near":
            decided[k] = "good" if "good" in firm[k] else "bad"
    if "good" not in decided:  # nothing long enough to decide by: near-good blocks and an article's short ones stand for themselves
        decided = ["good" if x == "near" or x == "short" and b.place == "good" else "bad" for b, x in zip(blocks, labels, strict=True)]
    return "\n".join(b.text for b, label in zip(blocks, decided, strict=True) if label == "good")


def _extracted(html_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, html_col):
                texts = [main_text(x) if x else "" for x in part.column(html_col).to_pylist()]
                names = [c for c in part.schema.names if c != html_col]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` with text and n_chars (code points) in place of its html.

    Each page is one row's work, whole. Null and empty html and pages without
    an article have empty text. Other columns pass through unless they clash
    with the new ones.
    """
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c == html_col or c not in ("text", "n_chars")])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != html_col]
    return rows.mapInArrow(_extracted(html_col), ", ".join([*kept, "text string", "n_chars long"]))
