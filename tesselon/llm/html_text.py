"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Blocks in menus, headers, footers,
sidebars, forms, notices, adverts and reader comments (by tag, role, or the subject of a
name of class or id) are boilerplate. The first pass classifies each other block by its link
density, length and density of stop words: good, bad, near (long enough, middling
density) or short (too short, or too few stop words, to tell). The second pass gives
near and short blocks the label of their nearest decided neighbours; between a good
and a bad one, near blocks are good and short ones take the nearer label (bad if
equally near). Headings next to content follow it. On a page without any good block
the near ones are content, or else the short ones.

An ``article`` or ``main`` (or role) weights the labels between the passes by its share
of the page's prose. One with a third or more of the most that any has vouches for its
near blocks, sentences, lists and tables; its link lists and copyright lines stay bad,
and runs of labels between its prose and its edge or a bad block are bad. Outside of
it, where there is less prose, long text counts as short and the rest as bad. One with
less prose vouches for nothing: a card with a link keeps what is good by itself only,
others (a lead) are judged like any text.

Texts are whole: character references decoded, white space of any kind inside a
block one space, blocks in page order joined by one space.

Defined results: null html is an empty page with empty text; a page without content
has empty text; an unclosed tag, comment or script at the end is dropped; repeated
rows repeat; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as entities
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselon.llm.common import bounded, free_name, table
from tesselon.llm.text import parts

# Function words of four languages, for stop-word density.
STOP_WORDS = frozenset(
    """
    a an and are as at be been but by for from had has have he her his i if in into is it its may more not of on or our
    she so than that the their them there they this to was we were what when which who will with would you your
    aber alle als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer er es für hat
    ich ihr im in ist kann man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wenn wie
    wir zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus
    pour qu que qui sa se ses son sont sur un une vous
    al como con de del e el ella en entre era es esta este fue ha hay la las le lo los más me mi muy no nos o para pero
    por porque que se ser si sin sobre son su sus también un una y ya
    """.split()
)
LINK_MAX, SHORT, LONG, STOP_LOW, STOP_HIGH = 0.33, 70, 200, 0.18, 0.28

_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul button select label".split()
)
_VOID = frozenset("hr br img input meta link base col embed source track wbr area param".split())
_BAD_TAGS = frozenset("nav footer aside form head menu dialog button select fieldset search".split())
_BAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_BAD_WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion disqus footer gdpr login masthead menu modal "
    "nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion related recommended replies reply respond share sharebar sharing "
    "side sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
# Names of several words count if these are all that they have besides the words above.
_PLAIN_WORDS = frozenset("area bar block bottom box button buttons form global icons item items label line link links list message page post posts section site slot text top unit".split())
# What a name says after its subject: the kind of box, its place, its part.
_PART_WORDS = _PLAIN_WORDS | frozenset(
    "articles body col column container content count element entry fixed footer group header heading holder inner left listing meta outer panel pane right root row rows stories story thread title view wrap wrapper zone".split()
)
# Subjects that page builders also use for their boxes of content: only whole names count.
_BOX_WORDS = frozenset("alert alerts banner menu modal notice notices overlay reply side skip toolbar widget widgets".split())
_BOXES = frozenset("area block box col column container item panel section slot widget zone".split())
# A name of the main part too (content-sidebar-wrap) is one of boilerplate only for these.
_MAIN, _IN_MAIN = frozenset(("main", "content")), frozenset("ad ads adsense advertisement comment comments nav navbar navigation".split())
_NOT = frozenset("with without has no non and hide".split())
_HEADERS = frozenset("header site-header global-header main-header".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|object|canvas|title|textarea|audio|video|map)(?=[\s/>]).*?(?:</\1\s*>|\Z)"
    r"|<(svg)(?=[\s/>])(?:[^>]*/>|.*?(?:</svg\s*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?:[!?][^>]*|/?[a-zA-Z][^>]*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[^\W\d_]+")
_NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SENTENCE = re.compile(r"[.!?。！？؟।]\W*$|[^\w\s:;>)\]›»→▸+×-]$")  # ends in a mark, but not one of labels
LABEL, SHARE = 40, 3
_LISTED = frozenset("li dt dd td th pre blockquote figcaption caption".split())


@dataclass
class Block:
    text: str
    link_chars: int
    bad: bool
    article: int  # number of the innermost article that holds it, 0 for none
    heading: bool
    tag: str = ""
    label: str = ""


@functools.lru_cache(1 << 16)
def _boilerplate(name: str, whole: bool = False) -> bool:
    """Whether a name of class or id is one of boilerplate. Its words, cut at marks and
    capitals, up to one such as with (content-with-sidebar), are read from the end: words for
    boxes, places and parts are passed over, and the next one is the subject
    (user-comments, sidebarLeft, comment-body, but not comment-policy-article). A modifier
    (page--sidebar) only counts for a plain box. whole: all words must be of boilerplate or
    boxes."""
    base, _, modifier = name.partition("--")
    words = [w.lower() for w in _NAME_WORD.findall(base)]
    if modifier and words and all(w in _BOXES for w in words):
        words += [w.lower() for w in _NAME_WORD.findall(modifier)]
    known = set(words)
    if known & _BAD_WORDS and known <= _BAD_WORDS | _PLAIN_WORDS:
        return True
    if whole:
        return False
    for i, w in enumerate(words):
        if w in _NOT:
            words = words[:i]
            break
    while words and words[-1] in _PART_WORDS and words[-1] not in _BAD_WORDS:
        words.pop()
    if not words or words[-1] not in _BAD_WORDS - _BOX_WORDS:
        return False
    return _MAIN.isdisjoint(words[:-1]) or words[-1] in _IN_MAIN


def _element(tag: str, attributes: str, inside_article: bool, whole: bool) -> tuple[bool, bool]:
    """(is boilerplate, is the article) for an element by itself."""
    bad = tag in _BAD_TAGS or (tag == "header" and not inside_article)
    article = tag in ("article", "main")
    if not attributes:
        return bad, article
    for name, x, y, z in _ATTRIBUTE.findall(attributes):
        value = (x or y or z).lower()
        name = name.lower()
        if name in ("class", "id"):
            bad |= any(_boilerplate(n, whole) for n in (x or y or z).split()) or (not inside_article and not _HEADERS.isdisjoint(value.split()))
        elif name == "role":
            bad |= value in _BAD_ROLES
            article |= value in ("main", "article")
        elif name == "itemprop":
            article |= value == "articlebody"
        elif name == "style":
            bad |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            bad = True
    return bad and tag not in ("body", "html"), article


def blocks(page: str, whole: bool = False) -> list[Block]:
    """The blocks of a page that have text, in order. whole: only whole names of class and
    id make boilerplate."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int]] = []
    pieces: list[str] = []
    links, depth, at, articles, anchor = 0, 0, 0, 0, 0

    def flush():
        nonlocal links
        if pieces:
            raw = "".join(pieces)
            text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
            if text:
                top = stack[-1] if stack else ("", False, 0)
                heading = any(t[0][0] == "h" and t[0][1:].isdigit() for t in stack[-2:])
                out.append(Block(text, links, top[1], top[2], heading, top[0]))
            pieces.clear()
        links = 0

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if depth:
                links += len(piece.strip())
        at = m.end()
        tag = m[4]
        if tag is None:
            continue
        tag = tag.lower()
        closing = m[3] == "/"
        if tag == "a":
            depth, anchor = int(not closing and "href" in m[5].lower()), len(stack)
        elif tag == "br":
            pieces.append(" ")
        elif tag in _BLOCKS:
            flush()
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                if len(stack) < anchor:  # a link ends with the block that it began in
                    depth = 0
            elif tag not in _VOID and not m[5].rstrip().endswith("/"):
                if stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                    stack.pop()
                if len(stack) < anchor:
                    depth = 0
                if tag == "body":
                    stack = [s for s in stack if s[0] == "html"]
                up = stack[-1] if stack else ("", False, 0)
                bad, article = _element(tag, m[5], bool(up[2]), whole)
                articles += article
                stack.append((tag, up[1] or bad, 0 if up[1] or bad else articles if article else up[2]))
    pieces.append(page[at:])
    if depth:
        links += len(page[at:].strip())
    flush()
    return out


def _first_pass(b: Block) -> str:
    n = len(b.text)
    density = b.link_chars / n
    if density > LINK_MAX or n <= LONG and "©" in b.text:
        return "bad"
    if n < SHORT:
        return "bad" if b.link_chars else "short"
    words = _WORD.findall(b.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if stop >= STOP_HIGH:
        return "good" if n > LONG else "near"
    if stop >= STOP_LOW:
        return "near"
    return "bad" if b.link_chars else "short"  # few stop words may be a language unknown here


def _second_pass(items: list[Block]) -> None:
    """Near and short blocks inherit from the nearest decided neighbours."""
    n = len(items)
    before: list[tuple[str, int]] = []
    last, where = "bad", -1
    for i, b in enumerate(items):
        before.append((last, i - where))
        if b.label in ("good", "bad"):
            last, where = b.label, i
    last, where = "bad", n
    inherited: dict[int, str] = {}
    for i in range(n - 1, -1, -1):
        b = items[i]
        if b.label in ("good", "bad"):
            last, where = b.label, i
            continue
        (left, far), (right, off) = before[i], (last, where - i)
        if b.heading and right == "good":
            inherited[i] = "good"
        elif left == right:
            inherited[i] = left
        elif b.label == "near":
            inherited[i] = "good"
        else:
            inherited[i] = left if far < off else right if off < far else "bad"
    for i, label in inherited.items():
        items[i].label = label


def _weighted(items: list[Block]) -> None:
    """Labels of the first pass, weighted by the articles that hold the blocks."""
    prose: dict[int, int] = {}
    cards = set()
    for b in items:
        if not b.label:
            b.label = _first_pass(b)
            prose.setdefault(b.article, 0)
            if b.label != "bad":
                prose[b.article] += len(b.text) * (len(b.text) >= SHORT)
        if b.link_chars > LINK_MAX * len(b.text):
            cards.add(b.article)
    most = max(prose.values(), default=0)
    trusted = {k for k, v in prose.items() if v * SHARE >= most}
    for b in items:
        n, k = len(b.text), b.article
        if b.bad:
            continue
        if k in trusted and k:
            if b.label == "bad" and b.link_chars <= LINK_MAX * n and ("©" not in b.text or n > LONG):
                b.label = "short"
            if most and (b.label == "near" or b.label == "short" and (n > LABEL or b.tag in _LISTED or _SENTENCE.search(b.text))):
                b.label = "good"
        elif k:
            if k in cards and b.label != "good":
                b.label = "bad"
        elif 0 not in trusted or not most and len(trusted) > 1:
            b.label = "short" if b.label == "good" or b.label == "near" and n > LONG else "bad"
    if most:
        _edges(items, trusted - {0})


def _edges(items: list[Block], trusted: set[int]) -> None:
    """Runs of labels in an article that touch its edge or a bad block are bad. What
    structure took out of an article is no edge."""
    for k in trusted:
        own = [b for b in items if b.article == k and not b.bad]
        right = "bad"
        for b in reversed(own):  # a heading follows what comes after it
            if b.label in ("good", "bad"):
                right = b.label
            elif b.heading:
                b.label = right
        i = 0
        while i < len(own):
            j = i
            while j < len(own) and own[j].label not in ("good", "bad"):
                j += 1
            inside = 0 < i and j < len(own) and own[i - 1].label == own[j].label == "good"
            for b in own[i:j]:
                b.label = "good" if inside else "bad"
            i = max(j, i + 1)


def classify(items: list[Block]) -> list[Block]:
    """The blocks with label good or bad."""
    for b in items:
        b.label = "bad" if b.bad else ""
    _weighted(items)
    first = [None if b.bad else b.label for b in items]
    _second_pass(items)
    if not any(b.label == "good" for b in items):  # nothing certain: near blocks by themselves, else short ones
        least = "near" if "near" in first else "short"
        for b, label in zip(items, first, strict=True):
            if label == least:
                b.label = "good"
    return items


def main_text(page: str | None) -> str:
    """The text of the good blocks. A page without any is read again by whole names only: one
    of its outer boxes may have a name of boilerplate."""
    for whole in (False, True):
        text = " ".join(b.text for b in classify(blocks(page or "", whole)) if b.label == "good")
        if text:
            break
    return text


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns with text and n_chars."""
    bounded(pages)
    own = free_name("html", [*keep, "text", "n_chars"])
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for b in parts(batches, own):
            texts = [main_text(x) for x in b.column(own).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col("html").alias(own)).mapInArrow(run, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url"])
