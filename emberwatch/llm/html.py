"""Main text of web pages by two-pass block rules.

A page is read as blocks: runs of text between block-level tags, each with its words, its words inside
links and the zone it stands in. Pass one decides blocks by zone, link density, length and the share of
stop words: good, bad, or ambiguous. Pass two gives ambiguous short blocks the label of their nearest
decided neighbours, first within their own container.

Where the page names its article, that is the zone of good blocks, so one-word paragraphs stay; menus,
headers, footers, sidebars, notices, adverts, forms and comments are bad wherever they stand. Pages that
name nothing are decided by the rules alone.

Defined results: a null or empty page has an empty text; a page cut off in the middle of a tag,
reference, script or comment ends there; tags that are never closed end with their parents; any length
is read whole in one pass; other columns are not read.
"""

from __future__ import annotations

import html as entities
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import columns

#: fixed values: frequent words of the four languages
STOP = frozenset((
    "the and of to in is it that was for on are with as at be this have from or by not but they his her she had an which you we all will there their what so if out a i "
    "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über im dem oder "
    "le la les de des un une et est en que qui dans pour pas au sur plus par je avec tout faire son ce il elle nous vous ou mais se sa ses aux du ne "
    "el los las que y una del se con por su para como más pero sus este ya entre cuando muy sin sobre también me hasta hay donde quien desde todo lo al no es"
).split())

#: fixed values: tags that end a block
BLOCKS = frozenset((
    "address article aside blockquote body br canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead title tr ul textarea button"
).split())
#: fixed values: tags whose content is no text of the page
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title textarea select option button datalist".split())
#: fixed values: of these, the ones whose content is read as characters up to the end tag
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: fixed values: tags that never enclose anything
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
#: fixed values: boilerplate by tag
BAD_TAGS = frozenset("nav aside footer form menu dialog fieldset search".split())
#: fixed values: boilerplate by role
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert note status".split())
#: fixed values: words in class and id that name boilerplate
BAD_NAMES = frozenset((
    "ad ads adv advert adverts advertisement advertising banner billboard sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs "
    "topbar toolbar header masthead footer foot colophon copyright legal sidebar sidebars side aside rail widget widgets related recommended recommendations similar more popular trending teaser teasers "
    "cookie cookies consent gdpr notice notices alert popup modal overlay dialog disclaimer newsletter subscribe subscription signup login register search searchbox share sharing social follow "
    "comment comments commentlist respond reply replies discussion disqus reaction reactions feedback pager pagination tags tagcloud meta byline print skip hidden"
).split())
#: fixed values: names that enclose a page's content, never boilerplate themselves
GOOD_NAMES = frozenset("article content main story post entry page body text maincontent wrapper container layout wrap".split())

#: the thresholds of pass one
MAX_LINK_SHARE, LONG_WORDS, SHORT_WORDS, STOP_HIGH, STOP_LOW = 0.33, 25, 10, 0.22, 0.08

TAG = regex.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)", regex.S)
ATTRIBUTE = regex.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
NAMES = regex.compile(r"[a-z]+")
#: what a name says it has, or has not, it isn't itself
HAS = regex.compile(r"\b(?:with|has|no)[-_ ]?[a-z]+")
CAMEL = regex.compile(r"(?<=[a-z])(?=[A-Z])")
WORD = regex.compile(r"[\p{L}\p{N}]+")
CUT_REFERENCE = regex.compile(r"&[A-Za-z0-9#]{0,31}\Z")
#: tags that an opening tag of the same kind closes, and what stops the search for it
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody"}), "th": frozenset({"td", "th", "tr", "tbody"}), "option": frozenset({"option"}),
}
ARTICLE, OPEN, BAD = "article", "open", "bad"


class Block:
    __slots__ = ("parts", "linked", "zone", "box", "label", "text")

    def __init__(self, zone: str, box: int):
        self.parts, self.linked, self.zone, self.box, self.label, self.text = [], [], zone, box, None, ""

    def done(self) -> bool:
        self.text = " ".join("".join(self.parts).split())
        return bool(self.text)

    def link_share(self, words: int) -> float:
        return len(WORD.findall("".join(self.linked))) / max(1, words) if self.linked else 0.0


def zone_of(name: str, rest: str, parent: str) -> str:
    """The zone a tag opens: boilerplate by tag, role or name; the article; else its parent's."""
    if parent == BAD:
        return BAD
    said = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {}
    named: set[str] = set()
    for key in ("class", "id"):
        if key in said:
            named.update(NAMES.findall(HAS.sub(" ", CAMEL.sub("-", entities.unescape(said[key])).lower())))
    if name in BAD_TAGS or name == "header" and parent != ARTICLE or said.get("role", "").lower() in BAD_ROLES or "hidden" in said or said.get("aria-hidden") == "true":
        return BAD
    if named & BAD_NAMES and name not in ("body", "html", "main") and not (named & GOOD_NAMES and name == "article"):
        return BAD
    if name in ("article", "main") or said.get("role", "").lower() in ("main", "article") or said.get("itemprop", "").lower() == "articlebody":
        return ARTICLE
    return parent


def blocks(page: str) -> list[Block]:
    """The page's text in blocks."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, int]] = [("", OPEN, False, 0)]  # tag, zone, skipped, container
    depth: dict[str, int] = {}
    now, links, boxes, at, n = Block(OPEN, 0), 0, 0, 0, len(page)

    def end_block():
        nonlocal now
        if now.parts and now.done():
            out.append(now)
        now = Block(stack[-1][1], stack[-1][3])

    def text(a: int, b: int):
        if b > a and not stack[-1][2]:
            raw = page[a:b]
            if b == n and "&" in raw[-33:]:
                raw = CUT_REFERENCE.sub("", raw)
            said = entities.unescape(raw)
            now.parts.append(said)
            if links:
                now.linked.append(said)

    def close(tag: str, within: int = 0):
        nonlocal links
        if not depth.get(tag):
            return False
        while len(stack) > 1:
            top = stack.pop()[0]
            depth[top] -= 1
            links -= top == "a"
            if top == tag:
                return True
        return False

    while at < n:
        m = TAG.search(page, at)
        if not m:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        if m["cdata"] is not None:
            continue
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            if name == "br":  # a line break inside a block is white space there
                if not stack[-1][2]:
                    now.parts.append(" ")
                continue
            end_block()
        if m["end"]:
            if close(name) and name in BLOCKS:
                now = Block(stack[-1][1], stack[-1][3])
            continue
        for open_tag, closers in CLOSED_BY.items():
            if name in closers and depth.get(open_tag) and stack[-1][0] in (open_tag, "a", "b", "i", "em", "strong", "span", "font", "u", "small"):
                close(open_tag)
        if name in VOID or m["rest"].endswith("/") and name not in BLOCKS and name != "a" and name not in SKIPPED:
            continue
        zone = zone_of(name, m["rest"], stack[-1][1])
        box = stack[-1][3]
        if name in BLOCKS and name not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd"):
            boxes += 1
            box = boxes
        stack.append((name, zone, stack[-1][2] or name in SKIPPED, box))
        depth[name] = depth.get(name, 0) + 1
        links += name == "a"
        if name in BLOCKS or zone != now.zone:
            end_block()
        if name in RAW:
            close_at = regex.compile(rf"</{name}(?=[\s/>])", regex.I).search(page, at)
            if not close_at:
                break  # never closed: the rest of the page is its content
            at = close_at.start()
    end_block()
    return out


def decide(page: list[Block]) -> None:
    """Pass one labels what is plain; pass two hands labels on to ambiguous short blocks."""
    has_article = any(b.zone == ARTICLE for b in page)
    for b in page:
        if b.zone == BAD or has_article and b.zone != ARTICLE:
            b.label = False
            continue
        words = WORD.findall(b.text.lower()) if b.linked or not has_article else ()
        linked, n = b.link_share(len(words)), len(words)
        if has_article:
            # only lists of links are left open there
            b.label = None if linked > 0.9 and 3 < n < LONG_WORDS else True
            continue
        stop = sum(w in STOP for w in words) / max(1, n)
        if linked > MAX_LINK_SHARE:
            b.label = False
        elif n >= LONG_WORDS:
            b.label = stop >= STOP_LOW
        elif n >= SHORT_WORDS and stop >= STOP_HIGH:
            b.label = True
    decided = [i for i, b in enumerate(page) if b.label is not None]
    for i, b in enumerate(page):
        if b.label is None:
            k = bisect_left(decided, i)
            near = [page[j] for j in decided[max(0, k - 1): k + 1]]
            own = [x for x in near if x.box == b.box] or near
            # between unlike neighbours a block stays with the text
            b.label = any(x.label for x in own) if own else b.link_share(len(WORD.findall(b.text))) <= MAX_LINK_SHARE


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    decide(found)
    return "\n".join(b.text for b in found if b.label)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = columns(pages, id=id_col, url=url_col, html=html_col)
    return rows.withColumn("id", rows["id"].cast("bigint")).mapInArrow(run, "id bigint, url string, text string, n_chars bigint")
