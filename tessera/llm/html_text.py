"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by length, link density and stop-word density;
what a block lies in is one more feature: menus, notices and the like are no text, and inside an article less is asked of a
block. Of class names and ids, those that only name such a part decide by themselves, those that also speak of the layout
do so where the page has text beside them, and those that may be about the subject only together with links or short texts. Short and middling blocks stay open, inside articles too. In the second pass an open block takes the label of its
nearest decided neighbours, those within the same article or beside it under the same parent first.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_arrow
from tessera.llm.quality import STOP_WORDS

#: Parameters of the first pass: characters, and shares of a block's characters or words.
SHORT, LONG = 70, 200
MAX_LINK_DENSITY, MAX_LINK_DENSITY_IN_ARTICLE = 0.5, 0.9
LOWEST_STOP_WORDS, LOW_STOP_WORDS, HIGH_STOP_WORDS = 0.03, 0.12, 0.2
#: Characters that paragraphs side by side must have together, so that they stand without a decided one among them.
TOGETHER = 100
#: A page whose texts together have fewer stop words is in a language that the list doesn't know: there they decide nothing.
KNOWN_LANGUAGE = 0.06

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|<[!?/a-zA-Z][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Tags that end a block, tags whose content is no text of the page, tags without content.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW_TAGS = frozenset("script style title textarea select template iframe noscript object svg math canvas audio video map noframes head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button search fieldset".split())
BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs masthead topbar footer foot sidebar aside widget widgets ad ads adv advert adverts advertisement "
    "advertising banner banners sponsor sponsored promo promos promotion notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe "
    "subscription signup signin login search comment comments commentlist respond reply replies disqus discussion social share sharing sharebar related "
    "recommended recommendations pagination pager toolbar alert alerts disclaimer copyright legal skip paywall".split()
)
#: Parts that make a name say something about the layout: "has-sidebar" is no sidebar.
MODIFIERS = frozenset("has no not with without is hide hidden show layout open enabled disabled".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Parts that place or shape a named part, and say nothing else: "sidebar-right", "commentBody".
LAYOUT = frozenset(
    "container wrapper wrap box block section list item items inner outer area left right top bottom center col column row grid panel module unit slot zone region "
    "content body text message msg title heading header label link links icon icons bar button btn buttons group card cards primary secondary main page site global "
    "mobile desktop sticky fixed float small large big first last thread author meta form feed post posts article articles story stories count image video tools".split()
)
#: Parts that are subjects as well: beside a part that isn't of the layout ("share-price") they are a hint only.
AMBIGUOUS = frozenset(
    "ad ads social share sharing related legal search notice notices discussion reply replies respond alert alerts promotion copyright skip foot menu menus banner "
    "recommended recommendations consent subscription login navigation comment dialog toolbar sponsor widget aside".split()
)
#: Link density, and characters outside an article, that bear out such a hint.
HINT_LINK_DENSITY, HINT_SHORT = 0.3, 200
PURE, PLACED, HINT = "pure", "placed", "hint"
#: Headings of what readers wrote.
_READERS = re.compile(r"(?:\d[\d.,]*\s+)?(?:reader\s+|user\s+)?(?:comments?|responses|replies)(?:\s*[(:]?\s*\d*\s*\)?)|(?:leave|post|add) a (?:comment|reply)|join the (?:discussion|conversation)", re.I)
ARTICLE_NAMES = frozenset(("article", "articlebody", "postbody", "postcontent", "entrycontent", "storybody", "articlecontent", "maincontent"))
#: Tags whose blocks lie side by side as the parts of one text.
PARAGRAPHS = frozenset("p blockquote pre h1 h2 h3 h4 h5 h6".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
GOOD, BAD, OPEN, HEADING = "good", "bad", "open", "heading"


class Block:
    __slots__ = ("parts", "link_chars", "boilerplate", "named", "article", "parent", "end", "tag", "text", "label")

    def __init__(self, boilerplate: bool, named: int, article: int, parent: int, tag: str):
        self.parts: list[str] = []
        self.named, self.end = named, 0
        self.link_chars, self.boilerplate, self.article, self.parent, self.tag = 0, boilerplate, article, parent, tag
        self.text, self.label = "", OPEN


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if "=" in raw or "hidden" in raw else {}


def _kind_of(name: list[str]) -> str:
    """What a class name or id, given by its parts, says about boilerplate: PURE, PLACED, HINT or nothing."""
    parts = {p.lower() for p in name if not p.isdigit()}
    listed = parts & BOILERPLATE_NAMES
    if not listed or parts & MODIFIERS:
        return ""
    if parts == {"discussion"}:
        return HINT  # a usual heading of papers too
    if parts == listed:
        return PURE
    return HINT if listed <= AMBIGUOUS and not parts <= listed | LAYOUT else PLACED


def _role(tag: str, raw: str, in_article: bool) -> tuple[bool, str, bool]:
    """Whether an element is boilerplate, whether it is so by a name that needs more (PLACED or HINT), and whether it holds an article."""
    attributes = _attributes(raw)
    named = [_NAME_PARTS.findall(x) for k in ("class", "id") for x in attributes.get(k, "").split()]
    lowered = [{p.lower() for p in parts} for parts in named]
    names = set().union(*(parts for parts in lowered if not parts & MODIFIERS))
    whole = {"".join(parts).lower() for parts in named} | {attributes.get("itemprop", "").lower()}
    role = attributes.get("role", "").lower()
    article = tag in ("article", "main") or role in ("article", "main") or bool(whole & ARTICLE_NAMES)
    hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "")
    header = (tag == "header" or "header" in names) and not in_article and not names & {"article", "post", "entry"} and tag not in _HEADINGS
    kinds = {_kind_of(parts) for parts in named} if tag not in ("html", "body", "main") else set()
    sure = tag in BOILERPLATE_TAGS or header or PURE in kinds or role in BOILERPLATE_ROLES or hidden
    return sure, "" if sure else PLACED if PLACED in kinds else HINT if HINT in kinds else "", article


def blocks_of(page: str) -> list[Block]:
    """The blocks with text, in page order; white space is one space, character references are decoded."""
    found: list[Block] = []
    # open elements: tag, in boilerplate, number of the article around (0: none), own number, innermost element around with a name to weigh (0: none)
    stack: list[tuple[str, bool, int, int, int]] = []
    weighed: list[tuple[str, int]] = [("", 0)]  # those elements: kind and the one around
    ends: dict[int, int] = {}  # the number of the last element within each element that was closed
    boilerplate, named, article, articles, links, at, breaks, elements = False, 0, 0, 0, 0, 0, 0, 0
    opened: Counter[str] = Counter()  # how many elements of each tag are on the stack
    last, unclosed = page.rfind(">") + 1, set()
    block = Block(False, 0, 0, 0, "")

    def around() -> tuple[bool, int, int]:
        return (stack[-1][1], stack[-1][2], stack[-1][4]) if stack else (False, 0, 0)

    def cut(tag: str) -> None:
        nonlocal block, links
        if block.parts:
            block.text = " ".join("".join(block.parts).split())
            if block.text:
                found.append(block)
        own = len(stack) - 1 - (tag in PARAGRAPHS and bool(stack) and stack[-1][0] == tag)  # not the paragraph itself
        block, links = Block(boilerplate, named, article, stack[own][3] if own >= 0 else 0, tag), 0

    def text(piece: str) -> None:
        nonlocal breaks
        if piece:
            piece = _html.unescape(piece) if "&" in piece else piece
            block.parts.append(piece)
            if stripped := len("".join(piece.split())):
                breaks = 0
                block.link_chars += stripped * (links > 0)

    for m in iter(lambda: _TOKEN.search(page, at, last), None):
        text(page[at : m.start()])
        at = m.end()
        if not (tag := (m[2] or "").lower()):
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK_TAGS or tag in RAW_TAGS or any(s[0] == tag for s in reversed(stack[-8:])):
                while opened[tag]:
                    gone = stack.pop()
                    opened[gone[0]] -= 1
                    ends[gone[3]] = elements
                    if gone[0] == tag:
                        break
                boilerplate, article, named = around()
                if tag in BLOCK_TAGS or block.boilerplate != boilerplate or block.named != named:
                    cut("")
        elif tag in RAW_TAGS:
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at) if tag not in unclosed else None
            if tag == "head" and not close:
                unclosed.add(tag)
                continue
            at = close.end() if close else len(page)
        elif tag == "br":
            breaks += 1
            block.parts.append(" ")
            if breaks == 2:
                cut(block.tag)
        elif tag in VOID_TAGS:
            if tag == "hr":
                cut("")
        else:
            if tag == "a":
                links += 1
            is_boilerplate, by_name, is_article = _role(tag, m[3] or "", article > 0) if tag in BLOCK_TAGS or m[3] else (False, "", False)
            if tag in BLOCK_TAGS or is_boilerplate or by_name:
                if tag != "p" or is_boilerplate or by_name:
                    if is_article and not article and not (boilerplate or is_boilerplate):
                        articles += 1
                    opened[tag] += 1
                    if by_name:
                        weighed.append((by_name, named))
                        named = len(weighed) - 1
                    stack.append((tag, boilerplate or is_boilerplate, article or (articles if is_article and not is_boilerplate and not boilerplate else 0), elements := elements + 1, named))
                    boilerplate, article, named = around()
                elif stack and stack[-1][0] == "p":  # a new paragraph ends one that was left open
                    gone = stack.pop()
                    opened["p"] -= 1
                    ends[gone[3]] = elements
                    boilerplate, article, named = around()
                cut(tag)
    text(re.split(r"<[!?/a-zA-Z]", page[at:], maxsplit=1)[0])  # a tag that isn't closed is none, and no text
    cut("")
    for b in found:
        b.end = ends.get(b.parent, elements)
    _weigh_names(found, weighed)
    _readers_parts(found)
    return found


def _weigh_names(blocks: list[Block], weighed: list[tuple[str, int]]) -> None:
    """Decides the elements with names that need more, from the outside in, and marks the blocks of those that are boilerplate.

    A PLACED name holds where text remains outside of the element: an article, or LONG characters without links. A HINT holds
    where much of the element's text is links or, outside an article, where it has little text.
    """
    n = len(weighed)
    if n == 1:
        return
    own, size, links = [0] * n, [0] * n, [0] * n  # of each element: text without links of its own, all its text, its links
    own_article = [False] * n
    for b in blocks:
        if not b.boilerplate:
            chars = size_of(b.text)
            own[b.named] += max(0, chars - b.link_chars)
            size[b.named] += chars
            links[b.named] += b.link_chars
            own_article[b.named] |= b.article > 0
    in_article = list(own_article)
    for e in range(n - 1, 0, -1):
        around = weighed[e][1]
        in_article[around] |= in_article[e]
        size[around] += size[e]
        links[around] += links[e]
    outside, article_outside, gone = own[0], own_article[0], [False] * n
    for e in range(1, n):
        kind, around = weighed[e]
        if gone[around]:
            gone[e] = True
        elif kind == HINT:
            gone[e] = links[e] > HINT_LINK_DENSITY * size[e] or (size[e] < HINT_SHORT and not in_article[e])
        else:
            gone[e] = article_outside or outside >= LONG or 2 * size[e] <= size[0]
        if not gone[e]:
            outside += own[e]
            article_outside |= own_article[e]
    for b in blocks:
        b.boilerplate |= gone[b.named]


def _readers_parts(blocks: list[Block]) -> None:
    """Marks what stands under a heading of readers' comments, up to the end of its part or a heading as high."""
    after_article, k = False, 0
    while k < len(blocks):
        b = blocks[k]
        after_article |= b.article > 0 and not b.boilerplate
        k += 1
        if b.tag in _HEADINGS and len(b.text) < SHORT and not b.boilerplate and _READERS.fullmatch(b.text):
            b.boilerplate = True
            while k < len(blocks):
                x = blocks[k]
                higher = x.tag in _HEADINGS and x.tag <= b.tag
                if higher or not b.parent <= x.parent <= b.end or (x.article != b.article and x.article and not after_article):
                    break
                x.boilerplate = True
                k += 1


def stop_word_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()[]#*$%&").encode("utf-8", "surrogatepass") in STOP_WORDS for w in words) / max(1, len(words))


def size_of(text: str) -> int:
    """A block's length in characters, those of scripts that write a word in one or two counted threefold."""
    return len(text) if text.isascii() else len(text) + 2 * sum(c >= "\u2e80" for c in text)


def first_pass(b: Block, known_language: bool) -> str:
    """A block's label by its own features."""
    n, stop = size_of(b.text), stop_word_density(b.text)
    links = b.link_chars / max(1, len("".join(b.text.split())))
    if b.boilerplate:
        return BAD
    if b.tag in _HEADINGS:
        return HEADING if b.article or links <= MAX_LINK_DENSITY else BAD
    if links > (MAX_LINK_DENSITY_IN_ARTICLE if b.article else MAX_LINK_DENSITY):
        return BAD
    if b.text[0] == "\N{COPYRIGHT SIGN}" and not b.article:
        return BAD
    if n < SHORT:
        return BAD if b.link_chars and not b.article else OPEN
    if not known_language:
        return GOOD if n > LONG and links <= MAX_LINK_DENSITY else OPEN
    if b.article:
        return GOOD if stop >= LOW_STOP_WORDS and links <= MAX_LINK_DENSITY else OPEN
    if n > LONG and stop >= HIGH_STOP_WORDS:
        return GOOD
    return OPEN if stop >= LOWEST_STOP_WORDS else BAD


def _nearest(k: int, decided: list[int]) -> list[int]:
    """Of ascending block numbers, those nearest to k on either side."""
    at = bisect_left(decided, k)
    return decided[max(0, at - 1) : at + 1]


def classify(blocks: list[Block]) -> None:
    """Sets the label of every block to good or bad."""
    words = " ".join(b.text for b in blocks if not b.boilerplate and not b.link_chars)
    known_language = stop_word_density(words) >= KNOWN_LANGUAGE
    first = [first_pass(b, known_language) for b in blocks]
    # what surrounds an article, or is set into it as a box, says nothing about its blocks; nor does what lies outside of their
    # common parent about paragraphs side by side
    decided, inside, beside, together = [], defaultdict(list), defaultdict(list), Counter()
    for k, b in enumerate(blocks):
        if first[k] in (GOOD, BAD):
            decided.append(k)
            if b.article and not b.boilerplate:
                inside[b.article].append(k)
            if b.tag in PARAGRAPHS:
                beside[b.parent].append(k)
        if b.tag in PARAGRAPHS and first[k] != BAD:
            together[b.parent] += size_of(b.text)
    for k, b in enumerate(blocks):
        b.label = first[k]
        if first[k] in (GOOD, BAD):
            continue
        alone = b.tag in PARAGRAPHS and not b.article and not beside[b.parent] and together[b.parent] >= TOGETHER
        near = [] if alone else _nearest(k, inside[b.article] if b.article else beside[b.parent] if b.tag in PARAGRAPHS and beside[b.parent] else decided)
        if not near:
            plain = size_of(b.text) >= SHORT and (not known_language or stop_word_density(b.text) >= LOWEST_STOP_WORDS)
            b.label = GOOD if b.article or plain or alone or first[k] == HEADING else BAD
        elif first[k] == HEADING and near[-1] > k:  # a heading belongs to what follows it
            b.label = first[near[-1]]
        else:
            least = min(abs(x - k) for x in near)
            labels = {first[x] for x in near if abs(x - k) == least}
            b.label = labels.pop() if len(labels) == 1 else GOOD if size_of(b.text) >= SHORT or b.article else BAD


def main_text(page: str | None) -> str:
    """The page's good blocks, one on a line. A null or empty page, or one without an article, gives an empty text."""
    blocks = blocks_of(page or "")
    classify(blocks)
    return "\n".join(b.text for b in blocks if b.label == GOOD)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    A null html gives an empty text; null ids and urls are kept. Repeated rows are returned as often as they come, pages
    of any length are read whole, other columns are ignored, and an empty table gives an empty result.
    """

    def texts(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(p) for p in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), texts, "page_id long, url string, text string, n_chars long")
