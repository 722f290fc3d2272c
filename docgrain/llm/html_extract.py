"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides blocks by link density, stop-word density and
length; tags and names are features of single blocks: they veto menus, forms, adverts and the like, and set the limits
that hold in and outside articles. Short and doubtful blocks stay undecided. The second pass gives these the label of
the nearest decided block, borders of containers counting as blocks. Each block keeps the rule that decided it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

#: Frequent function words of four languages.
STOP_WORDS = frozenset(
    """
    a about after all also an and are as at be because been but by can could do for from had has have he her his how i
    if in into is it its me more my no not of on one or our out she so some than that the their them then there these
    they this to up was we were what when which who will with would you your
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer eines er es
    für haben hat hatte ich ihr im in ist ja kann man mit nach nicht noch nur oder sein sich sie sind so über um und
    uns unter vom von vor war was wenn werden wie wir wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et être eux il ils je la le les leur lui mais ne nous on ou où
    par pas plus pour que qui sa se ses son sont sur te tu un une vous
    al como con cuando de del desde donde el ella en entre era es esta este fue ha hasta hay la las lo los más me mi
    muy no nos o para pero por porque que se ser si sin sobre su sus también te todo un una uno y ya
    """.split()
)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Formatting that never bounds a block and is not followed.
INLINE = frozenset("abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small strike strong sub sup time tt u var".split())
#: Parts of formulas, which are text.
FORMULA = frozenset("math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mmultiscripts mtable mtr mtd mstyle mpadded menclose semantics".split())
#: Elements whose contents are no text of the page; what stands in a line doesn't bound a block.
UNREAD_INLINE = frozenset("annotation annotation-xml applet audio button canvas datalist embed map meter object output picture progress video".split())
UNREAD = UNREAD_INLINE | frozenset("iframe noframes noscript optgroup option script select style svg template textarea title xmp".split())
#: Other tags that don't bound a block.
RUNNING = INLINE | FORMULA | UNREAD_INLINE | frozenset("a span label img wbr".split())
BOILERPLATE = frozenset("aside dialog footer form menu nav".split())
LANDMARKS = frozenset("article main".split())
#: Elements whose borders part blocks.
CONTAINERS = frozenset("article aside body details dialog div fieldset footer form header main nav section table".split())
HEADINGS = frozenset("h1 h2 h3".split())
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split())

_NAMES = (
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletters?|subscribe|subscription|signup|social|share|sharing|"
    r"related|recommended|recommendations|sidebar|sidenav|widgets?|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|masthead|"
    r"comments?|commentlist|disqus|replies|respond|popup|modal|overlay|notice|notices|alert|toolbar|login|search|teasers?|banner|disclaimer|copyright|paywall"
)
#: Names of layouts (page-with-sidebar, main-no-sidebar) are not bad.
_BAD_NAME = re.compile(rf"(?:(?!with|has|no\b|without|layout|col)(?:(?!(?:with|has|no|without|layout|cols?)[-_])[^-_]*[-_])+)?(?:{_NAMES})(?:[-_].*)?", re.I)
_BAD_ARTICLE = re.compile(r"(?:.*[-_])?(?:comments?|replies|reply|related|promo|teasers?|ads?|advert\w*)(?:[-_].*)?", re.I)
#: Whole class names of articles that are no main text; an article's id says what it is about.
_BAD_LANDMARK = re.compile(
    r"comments?|comment[-_](?:body|content|text|list|item)|replies|reply|related(?:[-_](?:posts?|articles?|stories|content|items?))?|promo\w*|"
    r"teasers?|(?:post|article|story|news)[-_](?:teaser|promo|ad)|ads?|advert\w*|sponsored",
    re.I,
)
_GOOD_NAME = re.compile(r"(?:article|post|entry|story|page|main)[-_]?(?:body|content|text)", re.I)
#: Names of elements that hold a whole page or article, whatever else is named beside.
_WHOLE_NAME = re.compile(r"page|site|layout|(?:.*[-_])?(?:page|layout|template|theme)|(?:.*[-_])?(?:article|post|entry|story)[-_]?(?:body|text)", re.I)
_HEADER_NAME = re.compile(r"(?:(?:page|site|top|main)[-_])?header", re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|xmp|iframe|noscript|noframes|svg|template|title|select)\b(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+(?:>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)",
    re.S | re.I,
)
_NO_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class Limits:
    """Lengths are in characters, densities shares of words or characters. alone: length of text that is good outside
    the articles of a page that has some. border: how many blocks a container's border counts as."""

    short: int = 70
    long: int = 200
    alone: int = 400
    no_stop_words: float = 0.02
    few_stop_words: float = 0.10
    stop_words: float = 0.25
    links: float = 0.2
    links_in_article: float = 0.5
    border: int = 8


LIMITS = Limits()


@dataclass
class Block:
    """region: number of its article, 0 outside. container, borders: its element that bounds blocks, and how many such
    borders come before it. rule: what decided it."""

    text: str
    link_chars: int
    bad: bool
    region: int
    label: str = ""
    container: int = 0
    borders: int = 0
    heading: bool = False
    rule: str = ""


@dataclass
class _Open:
    tag: str
    bad: bool
    #: Number of the article it stands in, 0 for none.
    region: int
    unread: bool = False
    #: Why it is bad: 1 for a name alone, 2 for a name of lists of articles (comments, related), 3 for anything else.
    cause: int = 0
    #: Number of the container.
    container: int = 0


@dataclass
class _Cutter:
    blocks: list[Block] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=lambda: [_Open("", False, 0)])
    count: Counter = field(default_factory=Counter)
    pieces: list[str] = field(default_factory=list)
    link_chars: int = 0
    articles: int = 0
    breaks: int = 0
    containers: int = 0
    borders: int = 0
    #: Block in which the open link began.
    link_from: int = 0

    def text(self, raw: str) -> None:
        top = self.stack[-1]
        if top.unread or not raw:
            return
        raw = unescape(raw) if "&" in raw else raw
        if not raw.isspace():
            self.breaks = 0
            if self.count["a"]:
                self.link_chars += len(raw.strip())
        self.pieces.append(raw)

    def end_block(self) -> None:
        self.breaks = 0
        if self.pieces:
            top = self.stack[-1]
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append(Block(text, self.link_chars, top.bad, top.region, "", top.container, self.borders, top.tag in HEADINGS))
            self.pieces, self.link_chars = [], 0

    def pop(self, closed: bool = False) -> None:
        """Takes off the innermost element. A link that its own end tag doesn't close ends with the block it began in."""
        tag = self.stack.pop().tag
        self.count[tag] -= 1
        if tag in CONTAINERS:
            self.borders += 1
        elif tag == "a" and not closed:
            for b in self.blocks[self.link_from + 1 :]:
                b.link_chars = 0
            if len(self.blocks) > self.link_from:
                self.link_chars = 0

    def open(self, tag: str, rest: str) -> None:
        if tag == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.end_block()
            self.pieces.append(" ")
            return
        if tag not in RUNNING:
            self.end_block()
            if self.stack[-1].tag == "p" or tag in ("li", "dt", "dd", "option", "tr", "td", "th") and self.stack[-1].tag == tag:
                self.pop()
        if tag in VOID or tag in INLINE:
            return
        if tag == "a":
            while self.count["a"]:
                self.pop()
            self.link_from = len(self.blocks)
        top = self.stack[-1]
        bad, region = top.bad, top.region
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest and not rest.isspace() else {}
        role = named.get("role", "").lower()
        classes = named.get("class", "").split()
        names = classes + named.get("id", "").split()
        landmark = tag in LANDMARKS or role == "main" or "articlebody" in named.get("itemprop", "").lower() or any(map(_GOOD_NAME.fullmatch, names))
        if landmark and bad and any(x.tag == "form" for x in self.stack) and all(not x.bad or x.tag == "form" for x in self.stack[: 1 + next(i for i, x in enumerate(self.stack) if x.bad)]):
            bad = False  # the form holds the whole page
        main = tag == "main" or role == "main"
        if bad and (main and top.cause < 3 or tag == "article" and top.cause < 2):
            bad = False  # a wrapper whose name says what else it holds
        cause = top.cause if bad else 0
        if tag in BOILERPLATE or role in BAD_ROLES or "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", named.get("style", "")):
            bad, cause = True, 3
        elif tag == "header" and not region:
            bad, cause = True, 3
        elif names and tag not in ("html", "body") and not any(map(_WHOLE_NAME.fullmatch, names)) and (any(map(_BAD_LANDMARK.fullmatch, classes)) if landmark else any(map(_BAD_NAME.fullmatch, names))):
            bad, cause = True, max(cause, 2 if any(map(_BAD_ARTICLE.fullmatch, names)) else 1)
        elif not region and any(map(_HEADER_NAME.fullmatch, names)):
            bad, cause = True, max(cause, 1)
        if landmark and not bad and not region:
            self.articles += 1
            region = self.articles
        if bad != top.bad or region != top.region:
            self.end_block()
        self.stack.append(_Open(tag, bad, region, top.unread or tag in UNREAD, cause, top.container))
        self.count[tag] += 1
        if tag in CONTAINERS:
            self.borders += 1
            self.containers += 1
            self.stack[-1].container = self.containers

    def close(self, tag: str) -> None:
        if tag not in RUNNING:
            self.end_block()
        if tag == "p" and not self.count["p"] or tag in INLINE or not self.count[tag]:
            return
        while True:
            if self.stack[-1].tag not in RUNNING or self.stack[-1].bad != self.stack[-2].bad:
                self.end_block()
            found = self.stack[-1].tag == tag
            self.pop(found)
            if found:
                break


def blocks(html: str) -> list[Block]:
    """The blocks of a page that hold text, in page order."""
    cutter, at = _Cutter(), 0
    for m in _MARKUP.finditer(html):
        if m.start() > at:
            cutter.text(html[at : m.start()])
        at = m.end()
        if m["tag"]:
            tag = m["tag"].lower()
            if m["close"]:
                cutter.close(tag)
            else:
                cutter.open(tag, m["rest"])
    cutter.text(html[at:])
    cutter.end_block()
    return cutter.blocks


def _links(block: Block, limits: Limits) -> bool:
    """Whether it holds too many links."""
    return block.link_chars / len(block.text) > (limits.links_in_article if block.region else limits.links)


def _stop_words(words: list[str]) -> int:
    return sum(_NO_LETTERS.sub("", w) in STOP_WORDS for w in words)


def known_language(found: list[Block], limits: Limits = LIMITS) -> bool:
    """Whether the page's longer blocks have stop words; pages without such blocks count as known."""
    words = [b.text.lower().split() for b in found if not b.bad and len(b.text) >= limits.short and not _links(b, limits)]
    return not words or sum(map(_stop_words, words)) >= limits.few_stop_words * sum(map(len, words))


def first_pass(block: Block, limits: Limits = LIMITS, known: bool = True, alone: bool = False) -> str:
    """"good", "bad", or undecided: "near" for running text too short to be sure of, "short" for the rest.

    If the language isn't ``known``, stop words tell nothing: length and links decide. ``alone``: the block stands outside
    the articles of a page that has good ones.
    """

    def decided(label: str, rule: str) -> str:
        block.rule = rule
        return label

    long = limits.alone if alone else limits.long
    n = len(block.text)
    if _links(block, limits):
        return decided("bad", "link density")
    if block.bad:
        return decided("bad", "place")
    if n < limits.short:
        return decided("bad", "short with a link") if block.link_chars and not block.region else "short"
    if not known:
        return decided("good", "length") if n > long else "near"
    words = block.text.lower().split()
    stop = _stop_words(words) / len(words)
    if stop >= limits.stop_words:
        return decided("good", "stop words and length") if n > long else "near"
    if stop >= limits.few_stop_words:
        return decided("good", "some stop words, length and article") if block.region and n > long else "near"
    return decided("bad", "no stop words") if stop < limits.no_stop_words and not block.region else "short"


def seed(found: list[Block]) -> None:
    """Where the first pass decides no block good, the undecided blocks of the likeliest article or container are: the
    one of the most characters, running text, headings and articles counting double."""
    weight: Counter = Counter()
    headed = {b.container for b in found if b.heading and not b.bad}
    for b in found:
        if b.label in ("near", "short"):
            weight[b.region > 0, b.region or b.container] += len(b.text) * (1 + (b.label == "near")) * (1 + (b.container in headed)) * (1 + (b.region > 0))
    if weight:
        best = max(weight, key=lambda x: (weight[x], x[0], -x[1]))
        for b in found:
            if b.label in ("near", "short") and (b.region > 0, b.region or b.container) == best:
                b.label, b.rule = "good", "likeliest"


def second_pass(found: list[Block], limits: Limits = LIMITS) -> None:
    """Decides "near" and "short" blocks by the nearest decided block before and after, in the same article or outside.

    If both are as near: good in an article; outside, good if "near" and bad if "short". If there is none: good in an
    article; outside, good if nothing else is. What is vetoed inside an article (a form, an advert) interrupts it and is no neighbour.
    """
    decided = [b.label if b.label in ("good", "bad") and not (b.bad and b.region) else "" for b in found]
    nearest: list[list[tuple[int, str]]] = [[] for _ in found]
    for indexes in (range(len(found)), range(len(found) - 1, -1, -1)):
        seen: dict[int, int] = {}
        for i in indexes:
            region = found[i].region
            if decided[i]:
                seen[region] = i
            elif region in seen:
                j = seen[region]
                nearest[i].append((abs(i - j) + limits.border * abs(found[i].borders - found[j].borders), decided[j]))
    some = any(b.label == "good" for b in found)
    for b, near in zip(found, nearest):
        if b.label in ("good", "bad"):
            continue
        labels = {label for distance, label in near if distance == min(near)[0]}
        if len(labels) == 1:
            b.label, b.rule = labels.pop(), "nearest"
        elif labels:
            b.label, b.rule = "good" if b.region or b.label == "near" else "bad", "as near"
        else:
            b.label, b.rule = "good" if b.region or not some else "bad", "no neighbour"


def judged(html: str | None, limits: Limits = LIMITS) -> list[Block]:
    """All blocks of a page with labels, "good" or "bad", and the rules that decided them."""
    found = blocks(html or "")
    known = known_language(found, limits)
    for b in found:
        b.label = first_pass(b, limits, known)
    if any(b.region and b.label == "good" for b in found):
        for b in found:
            if not b.region and b.label == "good":
                b.label = first_pass(b, limits, known, alone=True)
    if all(b.label != "good" for b in found):
        seed(found)
    second_pass(found, limits)
    return found


def main_text(html: str | None, limits: Limits = LIMITS) -> str:
    """The page's main text: good blocks joined by an empty line. Null and empty pages give an empty text."""
    return "\n\n".join(b.text for b in judged(html, limits) if b.label == "good")


def extract(pages: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html), whole pages, row by row.

    Null html gives an empty text; null ids and urls and repeated rows stay; other columns are not read; an empty
    table gives an empty one. Very long pages are read whole, in time linear in their length. No shuffle, and memory
    for one Arrow batch.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), limits) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select("page_id", "url", "html"), work, "page_id long, url string, text string, n_chars long")
