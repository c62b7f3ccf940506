"""Main text of web pages: the best contiguous region of words against tags.

Method: maximum-scoring subsequence. A page is a sequence of words and tags. Words score by
where they stand (in a paragraph, a list, a link, inside or outside the page's article), tags
score negative, both with weights from labelled pages: log odds of lying in the main text. A
linear scan finds the region with the greatest sum. Elements that say themselves that they are
menus, adverts, comments and so on score nothing and are left out of the region. What they say
is weighed first: an element with most of the page's words is a wrapper whatever its class,
words with other meanings count only where links or few words bear them out, and an article
is one also in a form or a page header.

Extraction is one narrow stage; a page is worked on as a whole and nothing is shared between
pages but the weights.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements whose content is never text of the page.
OPAQUE = "script|style|noscript|template|svg|math|iframe|object|canvas|textarea|select|title|datalist"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<opaque>{OPAQUE})(?=[\s/>])[^>]*>.*?(?:</(?P=opaque)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-z][^\s/>]*)(?P<attributes2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements that run on inside a line of text; all others end a block.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# What an element holds by its name, and by words of its class, id or role.
BY_NAME = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar",
    "form": "form", "button": "form", "fieldset": "form", "dialog": "notice",
}
HINTS = {
    "advert": "ad ads adsbygoogle adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted",
    "comments": "comment comments disqus reply replies respond discussion",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc toolbar skip tabs",
    "sidebar": "sidebar aside related recommended recommendations trending widget popular complementary",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall disclaimer",
    "header": "masthead topbar",
    "footer": "footer copyright colophon contentinfo",
    "share": "share sharing social",
    "form": "search login form",
}
# Words of the above that sections of an article have as well.
WEAK_HINTS = set(
    "promotion discussion menu skip tabs popular related recommended recommendations trending complementary"
    " consent notice notices alert overlay disclaimer share sharing social search login form".split()
)
# has-sidebar, with-comments: said of what stands beside.
BESIDE = {"has", "with", "without"}
# Lists of cards, each of which may be an article element.
CARDS = {"comments", "advert", "sidebar"}
CONTROLS = {"input", "select", "textarea", "button", "label"}
CONTENT_HINTS = set("article content post entry story main maincontent articlebody body text".split())
HINT_OF = {word: kind for kind, words in HINTS.items() for word in words.split()}


# Text outside of paragraphs, lists and tables is long from this many words on.
LONG_WORDS = 20
# A form is prose from this many words of paragraphs on, for itself and for each control.
FORM_WORDS = 40


@dataclass
class Block:
    """Text between two block boundaries: where it stands, and how many words lie in links."""

    kind: str
    place: str
    words: list[str]
    linked: int
    kept: bool
    article: Frame | None = None  # the outermost article, else main, that it lies in

    def features(self) -> list[tuple[tuple[str, str, bool], int]]:
        plain = len(self.words) - self.linked
        return [((self.kind, self.place, False), plain), ((self.kind, self.place, True), self.linked)]


@dataclass
class Weights:
    words: dict[tuple[str, str, bool], float]
    tags: dict[str, float]

    def of(self, block: Block) -> float:
        return sum(n * self.words.get(f, -0.1 if f[2] else 0.1) for f, n in block.features() if n)


class Frame:
    """An element that says what it holds, and what was counted in it and its descendants."""

    def __init__(self, parent: Frame | None, name: str, hinted: str | None, strong: bool, content: bool):
        self.parent, self.name, self.hinted, self.strong, self.content = parent, name, hinted, strong, content
        self.named = BY_NAME.get(name)
        self.words = self.plain = self.spoken = self.prose = self.controls = self.signals = 0
        self.commented = hinted == "comments" or parent is not None and parent.commented
        self.kind: str | None = None
        self.inside = False
        self.article: Frame | None = None

    def add(self, block: Block) -> None:
        plain = len(block.words) - block.linked
        self.words += len(block.words)
        self.plain += plain
        self.spoken += 0 if self.commented else plain
        self.prose += plain if block.place in ("paragraph", "long") else 0

    def give(self) -> None:
        """Add the counts to the parent."""
        for c in ("words", "plain", "spoken", "prose", "controls", "signals"):
            setattr(self.parent, c, getattr(self.parent, c) + getattr(self, c))

    def linky(self) -> bool:
        return 4 * (self.words - self.plain) >= self.words

    def wraps(self, page: Frame, free: int) -> bool:
        """Whether it has most of the page's words, comments aside; ``free`` words stand in no marked element."""
        own, all_ = (self.plain, page.plain) if self.commented or 10 * page.spoken < page.plain else (self.spoken, page.spoken)
        if 2 * own <= all_:
            return False
        if not self.strong:
            return True
        if page.signals > self.signals:
            return False  # the article or headline is elsewhere
        return self.signals > 0 or self.content or self.named is None and 10 * free < page.plain

    def drops(self, page: Frame, free: int, inside: bool) -> str | None:
        """Kind of boilerplate that the element is."""
        named = None if self.named == "header" and inside else self.named  # the head of the article itself
        kind = named or (self.hinted if self.name not in HEADINGS else None)
        if kind is None or self.wraps(page, free):
            return None
        if self.strong:
            return kind
        if named or kind == "form" and self.controls:
            prose = self.prose >= FORM_WORDS * (self.controls + bool(named)) and not self.linky()
            return None if prose and kind == "form" else kind
        return kind if self.linky() or not inside and self.plain < LONG_WORDS else None

    def settle(self, page: Frame, free: int, lonely: bool) -> None:
        """Kind and place by those of the parent. ``lonely``: no article is outside boilerplate."""
        up = self.parent
        self.kind, self.inside, self.article = up.kind, up.inside, up.article
        if self.name in ("article", "main"):
            if self.hinted in CARDS and not self.wraps(page, free):
                self.kind = self.kind or self.hinted
            elif self.kind not in CARDS:
                if self.kind not in ("menu", "footer", "notice") or lonely and 2 * self.spoken > page.spoken:
                    self.kind = None
            self.inside = self.inside or self.kind is None
            if self.kind is None and (self.article is None or self.name == "article" != self.article.name):
                self.article = self
        elif self.kind is None:
            self.kind = self.drops(page, free, self.inside)
            if self.kind is None and self.content and self.name in ("div", "section", "td"):
                self.inside = True
        elif self.content and self.hinted is None and self.kind not in CARDS and self.name in ("div", "section", "td"):
            if 3 * self.spoken >= page.spoken > 0:
                self.kind, self.inside = None, True


def hints(attributes: str) -> tuple[str | None, bool, bool]:
    """Kind of boilerplate, whether a word without other meanings says so, and whether content
    is meant, by words of class, id and role."""
    kind, strong, content = None, False, False
    for values in ATTRIBUTE.findall(attributes):
        for value in "".join(values).split():
            said = [word.lower() for word in HINT.findall(value)]
            content = content or any(word in CONTENT_HINTS for word in said)
            if said and said[0] in BESIDE:
                continue
            for word in said:
                found = HINT_OF.get(word)
                if found and not strong and (kind is None or word not in WEAK_HINTS):
                    kind, strong = found, word not in WEAK_HINTS
    return kind, strong, content


def scan(page: str) -> list[Block | str]:
    """Blocks and names of tags in page order. Tags inside boilerplate are left out."""
    root = Frame(None, "", None, False, False)
    frames = [root]
    found: list[tuple[Block | str, Frame, bool]] = []  # with its element, and whether it goes on a line
    stack: list[tuple[str, Frame]] = []
    counts: Counter = Counter()  # open elements by name
    pieces: list[tuple[str, bool]] = []
    kept = [0]
    runs_on = [False]

    def flush(inline: bool = False) -> None:
        goes_on, runs_on[0] = runs_on[0], inline and (runs_on[0] or bool(pieces))
        if not pieces:
            return
        words: list[str] = []
        linked = 0
        text = "".join(t for t, _ in pieces)
        if any(link for _, link in pieces):
            linked = sum(len(entities.unescape(t).split()) for t, link in pieces if link)
        words = entities.unescape(text).split()
        pieces.clear()
        if not words:
            return
        frame = stack[-1][1] if stack else root
        place = "other"
        if any(counts[h] for h in HEADINGS):
            place = "heading"
        elif counts["li"] or counts["dd"] or counts["dt"]:
            place = "list"
        elif counts["table"]:
            place = "table"
        elif counts["p"] or counts["blockquote"] or counts["pre"]:
            place = "paragraph"
        elif len(words) >= LONG_WORDS:
            place = "long"
        block = Block("", place, words, min(linked, len(words)), bool(kept[0]))
        frame.add(block)
        found.append((block, frame, goes_on))

    def pop() -> None:
        name = stack.pop()[0]
        counts[name] -= 1
        if name.endswith("+"):
            kept[0] -= 1

    def ends_frame(name: str) -> bool:
        """Whether closing ``name`` leaves an element with a frame of its own."""
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][1] is not (stack[i - 1][1] if i else root):
                return True
            if stack[i][0] == name:
                return False
        return False

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            pieces.append((page[at : token.start()], counts["a"] > 0))
        at = token.end()
        name = (token["name"] or token["name2"] or "").lower()
        if not name:
            opaque = (token["opaque"] or "").lower()
            if opaque in CONTROLS:
                (stack[-1][1] if stack else root).controls += 1
            if opaque and opaque not in INLINE:
                pieces.append((" ", False))
            continue
        if name == "br":
            pieces.append((" ", False))
        closes = token["close"] or token["close2"]
        attributes = token["attributes"] or token["attributes2"] or ""
        hinted, strong, content = hints(attributes) if attributes and not closes else (None, False, False)
        # boilerplate inside a line is a block of its own
        if name not in INLINE:
            flush()
        elif hinted or closes and counts[name] > 0 and ends_frame(name):
            flush(inline=True)
        if name in CONTROLS and not closes and "hidden" not in attributes:
            (stack[-1][1] if stack else root).controls += 1
        if closes:
            if counts[name] > 0:
                while stack:
                    top = stack[-1][0]
                    pop()
                    if top == name:
                        break
        elif name not in VOID:
            if name in ("p", "li", "dt", "dd") and counts[name] and stack[-1][0] in (name, "b", "i", "em", "strong", "span", "a"):
                # a new paragraph or item ends the open one, with what was left open in it
                while stack and stack[-1][0] in (name, "b", "i", "em", "strong", "span", "a"):
                    pop()
            frame = stack[-1][1] if stack else root
            if name == "h1" or name in ("article", "main") and hinted not in CARDS:
                frame.signals += 1
            if name not in ("html", "body") and (hinted or content or name in BY_NAME or name in ("article", "main")):
                strong = strong or name in ("nav", "menu", "footer", "aside", "button")
                frame = Frame(frame, name, hinted, strong, content)
                frames.append(frame)
            stack.append((name, frame))
            counts[name] += 1
            if attributes and "data-keep" in attributes:
                kept[0] += 1
                stack.append((name + "+", frame))
        found.append((name, stack[-1][1] if stack else root, False))
    if at < len(page):
        pieces.append((page[at:], counts["a"] > 0))
    flush()
    return _settled(found, frames)


def _settled(found: list[tuple[Block | str, Frame, bool]], frames: list[Frame]) -> list[Block | str]:
    """Blocks with their kinds, now that all of the page was counted."""
    root = frames[0]
    marked = {id(root): False}
    for f in frames[1:]:
        marked[id(f)] = marked[id(f.parent)] or bool(f.named or f.hinted)
    free = sum(len(x.words) - x.linked for x, f, _ in found if isinstance(x, Block) and not marked[id(f)])
    for f in reversed(frames[1:]):
        f.give()
    for lonely in (False, True):
        for f in frames[1:]:
            f.settle(root, free, lonely)
        if any(f.name in ("article", "main") and f.kind is None for f in frames):
            break
    out: list[Block | str] = []
    last: Block | None = None
    for x, f, goes_on in found:
        if isinstance(x, Block):
            x.kind = f.kind or ("main" if f.inside else "plain")
            x.article = f.article if f.kind is None else None
            if goes_on and last is not None and last.kind == x.kind:
                last.words += x.words
                last.linked += x.linked
                continue
            last = x
            out.append(x)
        elif f.kind is None:
            out.append(x)
    if any(isinstance(x, Block) and x.kind == "main" for x in out):
        for x in out:
            if isinstance(x, Block) and x.kind == "plain":
                x.kind = "outside"
    return out


def fit(pages: Iterable[str]) -> Weights:
    """Log odds from labelled pages; elements of the main text carry ``data-keep``.

    A tag counts as content when the block next to it is kept.
    """
    words: tuple[Counter, Counter] = (Counter(), Counter())
    tags: tuple[Counter, Counter] = (Counter(), Counter())
    for page in pages:
        kept = False
        for item in scan(page):
            if isinstance(item, Block):
                kept = item.kept
                if item.kind in ("main", "outside", "plain"):
                    for feature, n in item.features():
                        words[kept][feature] += n
            else:
                tags[kept][item] += 1
    totals = [sum(c.values()) for c in words]
    odds = {}
    for feature in words[0] | words[1]:
        share = [(words[k][feature] + 0.5) / (totals[k] + 1) for k in (0, 1)]
        odds[feature] = math.log(share[1] / share[0])
    totals = [sum(c.values()) for c in tags]
    costs = {}
    for name in tags[0] | tags[1]:
        share = [(tags[k][name] + 0.5) / (totals[k] + 1) for k in (0, 1)]
        costs[name] = min(-0.1, math.log(share[1] / share[0]))
    return Weights(odds, costs)


def belongs(block: Block, weights: Weights) -> bool:
    """Whether a block inside the region is text of the article: all of it where the page
    says so, else what is not boilerplate and not mostly links."""
    if block.kind == "main":
        return True
    prose = 2 * block.linked < len(block.words)
    return prose and (block.kind == "plain" or block.kind == "outside" and weights.of(block) > 0)


def of_articles(items: list[Block | str], span: tuple[int, int]) -> set[int]:
    """The articles that the region lies in, all of whose text is kept; without a region the longest.

    A main element may hold more than the article, so it counts only where no article does.
    """
    words: Counter = Counter()
    by_id = {}
    for x in items[slice(*span)] if span[1] else items:
        if isinstance(x, Block) and x.article is not None:
            words[id(x.article)] += len(x.words)
            by_id[id(x.article)] = x.article.name
    narrow = {k: n for k, n in words.items() if by_id[k] == "article"} or words
    return set(narrow) if span[1] or not narrow else {max(narrow, key=narrow.get)}


def extract(page: str | None, weights: Weights) -> str:
    """Blocks of the best region and of the articles it lies in, joined by line ends; empty if
    no region scores above zero and the page has no article."""
    items = scan(page or "")
    best, span = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, item in enumerate(items):
        if isinstance(item, Block):
            score = weights.of(item) if item.kind in ("main", "outside", "plain") else 0.0
        else:
            score = weights.tags.get(item, -0.5)
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i + 1)
    whole = of_articles(items, span)
    own = [
        x for i, x in enumerate(items)
        if isinstance(x, Block) and (id(x.article) in whole or span[0] <= i < span[1] and belongs(x, weights))
    ]
    return "\n".join(" ".join(x.words) for x in own)


def main_text(html: Column, weights: Weights | None = None) -> Column:
    """Main text of a html column. Null, empty and textless pages give an empty text.

    The whole page is read, however long; equal pages give equal texts. Without ``weights``
    those of the labelled pages that come with the library are used.
    """
    weights = weights or default_weights()

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([extract(p.as_py(), weights) for p in pages], pa.string())

    return F.arrow_udf(run, "string")(html.cast("string"))


def default_weights() -> Weights:
    from filingloom.llm.labelled_pages import pages

    return fit(pages())
