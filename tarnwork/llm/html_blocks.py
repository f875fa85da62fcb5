"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is read once, tag by tag, into blocks of text that block-level tags separate. A
block's features are the word count and link density of itself and of the blocks before and
after it, and what it stands in: the article element, or a container that by tag, role,
class or id holds menus, notices, adverts, forms or comments. Such a container around the
page's main or article element is a wrapper and counts for nothing. On pages without these
elements, and inside them, the number of words outside the container is a feature too, as a
form or widget may hold the article. A decision tree says which blocks are text. It is
grown, by Gini impurity, on the labelled blocks of ``EXAMPLES`` and of ``made_examples``, pages
of six layouts; in one of them nothing but a block and its neighbours tells text from the
rest, in another names mislead.

Reading takes time in proportion to a page's length, whatever is left open in it.

Defined results. Null and empty html give an empty text. Tags that are never closed end
with their container; an unclosed script, style, title or textarea runs to the end of the
page. What stands in a button, a picture or a player is no text; if one of these is not closed
within its container, the text after it is read as if its tag were not there. Formulas keep
their text, a blank between their parts. A lone ``<`` is text; so is all from a tag on that
no ``>`` follows. White space of any kind, no-break spaces included, is one space. Repeated
rows get the same result each.
"""

from __future__ import annotations

import functools
import html as references
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What HTML tags and common class names mean.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q "
    "s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content has no tags, and the head.
RAW = ("script", "style", "title", "textarea", "head")
SKIPPED = frozenset(
    "noscript template svg select button iframe object canvas audio video annotation-xml".split()
)
MATH = frozenset(
    "math maction maligngroup malignmark menclose merror mfenced mfrac mglyph mi mlabeledtr "
    "mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub "
    "msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
CONTAINERS = frozenset(
    "article main nav header footer aside form div section ul ol dl table dialog menu "
    "details fieldset".split()
)
BOILERPLATE = frozenset("nav footer aside form dialog menu fieldset".split())
#: Those of them that never hold a page's article, unless by an article or main element.
FIRM = BOILERPLATE - {"form", "fieldset"}
HINTS = frozenset(
    "ad ads adbox adsbygoogle adsense adslot adunit adv advert advertisement advertising banner "
    "breadcrumb breadcrumbs ccpa comment commentform commentlist comments consent cookie cookies copyright "
    "discuss discussion discussions disqus footer form gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice pager pagination popup promo promoted promotion recommended related replies "
    "reply respond share sharing sidebar signup social sponsor sponsored subscribe taboola toolbar widget".split()
)
#: Beginnings and ends of names written as one word, and words that only look like these.
STEMS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "sidebar", "sponsor")
ALIKE = frozenset("commentary commentaries commented commenting commentator".split())
#: Words that turn a hint beside them into a remark about the page.
REMARKS = frozenset("has have hide hidden is js no non not show with without".split())
#: Hints that name an article's own head too, and the words beside which they do not.
HEADS, OF_SITE = frozenset("header masthead".split()), frozenset("global main page site top".split())
#: Unlinked words outside a container that are counted at most.
ENOUGH = 40
#: Elements that end where the next of their kind, or for p any block, begins.
LOOSE = frozenset("dd dt li p td th tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

TAG = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
#: The end of a tag, or the start of a quoted value in it.
STOP = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
ANNOTATION = re.compile(r"[^<]*</annotation\s*>", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
WORD = re.compile(r"[^\W_]+")
LABEL = re.compile(r"<!--(keep|drop)-->")

#: Names of a block's features, in order.
FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after",
    "in_article", "in_boilerplate", "words_outside",
)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: tuple[int, int]  # 1 in an article, 2 in main; container around that
    container: int  # the innermost that holds something other than text, or 0
    keep: bool | None = None
    in_article: bool = False
    in_boilerplate: bool = False
    words_outside: int = 0  # of the container: ``ENOUGH`` if it cannot hold the article

    @property
    def links(self) -> float:
        return self.linked / self.words if self.words else 0.0


@functools.lru_cache(10_000)
def _hint(name: str, in_article: bool) -> bool:
    """Whether a class, id or role names something other than text."""
    parts = {part for part in re.split(r"[_\W]+", CAMEL.sub("-", name).lower()) if part}
    hints = {x for x in parts if x in HINTS or (x.startswith(STEMS) or x.endswith(STEMS)) and x not in ALIKE}
    if not hints or parts & REMARKS:
        return False
    if hints <= HEADS:
        return not in_article and parts <= HEADS | OF_SITE
    return True


def _names(rest: str) -> list[str]:
    """The names in a tag's class, id and role."""
    if "=" not in rest:
        return []
    found = ATTRIBUTE.finditer(rest)
    return [name for f in found for name in (f[2] or f[3] or f[4] or "").split()]


class Scanner:
    """A page's tags and the text between them, in one pass."""

    def __init__(self, page: str):
        self.page, self.size = page, len(page)
        self.last = page.rfind(">")
        self.plain = False  # a quote is left open: every tag ends with the next ``>``
        self.endless: set[str] = set()  # elements whose end tag is not found any more

    def end_of_tag(self, at: int) -> int:
        """Where the tag that goes on at ``at`` ends; ``at`` is before ``last``."""
        page = self.page
        first = page.find(">", at)
        if self.plain:
            return first + 1
        inside = page[at:first]
        if inside.count('"') % 2 == 0 and inside.count("'") % 2 == 0:
            return first + 1
        i = at
        while found := STOP.search(page, i):
            if not found[1]:
                return found.end()
            close = page.find(found[1], found.end())
            if close < 0:
                break
            i = close + 1
        self.plain = True
        return first + 1

    def after(self, tag: str, at: int) -> int:
        """Where the next end tag of a raw element ends, or -1."""
        if tag in self.endless:
            return -1
        found = ENDS[tag].search(self.page, at)
        if not found:
            self.endless.add(tag)
            return -1
        return found.end()

    def skip(self, at: int) -> int:
        """Where the comment or declaration at ``at`` ends."""
        for opens, closes in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<", ">")):
            if self.page.startswith(opens, at):
                end = self.page.find(closes, at + len(opens))
                return self.size if end < 0 else end + len(closes)
        raise ValueError("no comment or declaration")


def _marked(tag: str, names: list[str], in_article: bool) -> bool:
    """Whether an element is a container of something other than text."""
    if tag in BOILERPLATE or (tag == "header" and not in_article):
        return True
    return tag != "main" and any(_hint(name, in_article) for name in names)


def _place(found: list[Block], around: list[int], firm: list[bool]) -> None:
    """Say of each block whether it is in the article, or in a container that is not.

    ``around`` has, for each container, the one around it, ``firm`` whether it is ``FIRM``.
    """
    bare = sum(b.words - b.linked for b in found if not b.container)
    depth = [0] * len(around)
    for i in range(1, len(around)):
        depth[i] = depth[around[i]] + 1
    kind = max((b.article[0] for b in found), default=0)
    homes: dict[int, int] = {}
    for b in found:
        if b.article[0] == kind > 0:
            homes[b.article[1]] = homes.get(b.article[1], 0) + b.words - b.linked
    wrappers = set()
    if homes and 0 not in homes:
        home = min(homes, key=lambda i: (depth[i], -homes[i]))
        if kind == 2 or homes[home] > bare:
            while home:
                wrappers.add(home)
                home = around[home]
    for i in range(1, len(around)):
        depth[i] = depth[around[i]] + (i not in wrappers)
        firm[i] = firm[around[i]] or (firm[i] and i not in wrappers)
    for b in found:
        b.in_article = b.article[0] > 0 and depth[b.article[1]] == 0
    articles = any(b.in_article for b in found)
    words: dict[int, int] = {}
    for b in found:
        if b.in_article or not articles:
            words[depth[b.container]] = words.get(depth[b.container], 0) + b.words - b.linked
    outside, total = {}, 0
    for level in sorted({depth[b.container] for b in found}):
        outside[level] = total
        total += words.get(level, 0)
    for b in found:
        if level := depth[b.container]:
            b.in_boilerplate = True
            never = firm[b.container] or (articles and not b.in_article)
            b.words_outside = ENOUGH if never else min(outside[level], ENOUGH)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; those without any text are left out."""
    out: list[Block] = []
    pieces: list[tuple[str, bool]] = []
    # Containers and skipped elements: tag, article, container, link, blocks before it.
    open_: list[tuple[str, tuple[int, int], int, bool, int]] = []
    n_open: Counter[str] = Counter()
    scan = Scanner(page)
    around, firm = [0], [False]
    article, container, link = (0, 0), 0, False
    label: bool | None = None

    def end_block() -> None:
        if not pieces:
            return
        joined = "".join(text for text, _ in pieces)
        text = " ".join(references.unescape(joined).split())
        if text:
            words = len(WORD.findall(text))
            linked = sum(len(WORD.findall(t)) for t, is_link in pieces if is_link)
            out.append(Block(text, words, min(linked, words), article, container, label))
        pieces.clear()

    def close(k: int, tag: str) -> None:
        """End the open elements from number ``k``, which is of kind ``tag``, on."""
        nonlocal article, container, link
        _, article, container, link, before = open_[k]
        n_open.subtract(entry[0] for entry in open_[k:])
        del open_[k:]
        if tag in SKIPPED:
            del out[before:]

    at, size = 0, len(page)
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            pieces.append((page[at:end], link))
            at = end
            continue
        found = TAG.match(page, at + 1)
        if not found and page[at + 1 : at + 2] in ("!", "?"):
            end = scan.skip(at)
            if mark := LABEL.fullmatch(page, at, end):
                end_block()
                label = mark[1] == "keep"
            at = end
            continue
        if not found or at > scan.last:
            pieces.append(("<", link))
            at += 1
            continue
        end = scan.end_of_tag(found.end())
        tag, closes, rest = found[1].lower(), page[at + 1] == "/", page[found.end() : end - 1]
        at = end
        if tag in ENDS:
            if tag != "title":
                end_block()
            if not closes and not rest.endswith("/"):
                stop = scan.after(tag, at)
                at = stop if stop >= 0 else (size if tag != "head" else at)
            continue
        if tag == "annotation":  # a formula once more, as source text
            if not closes and (stop := ANNOTATION.match(page, at)):
                at = stop.end()
            continue
        if tag in MATH:
            pieces.append((" ", link))
            continue
        if tag == "a":
            link = not closes
        if tag in INLINE:
            continue
        end_block()
        if not closes and open_ and (top := open_[-1][0]) in LOOSE and top in ("p", tag):
            close(len(open_) - 1, top)
        if tag in VOID:
            continue
        if tag in SKIPPED and not closes:
            if not rest.endswith("/"):
                open_.append((tag, article, container, link, len(out)))
                n_open[tag] += 1
        elif tag in CONTAINERS or tag in SKIPPED or (tag in LOOSE and (closes or "=" in rest)):
            if not closes:
                marked = _marked(tag, _names(rest), article[0] > 0)
                if tag in LOOSE and not marked:
                    continue
                open_.append((tag, article, container, False, 0))
                n_open[tag] += 1
                if marked:
                    around.append(container)
                    firm.append(tag in FIRM)
                    container = len(around) - 1
                kind = 2 if tag == "main" else int(tag == "article")
                if kind > article[0] and not marked:
                    article = (kind, container)
                link = False
            elif n_open[tag]:
                k = len(open_) - 1
                while open_[k][0] != tag:
                    k -= 1
                close(k, tag)
    end_block()
    _place(out, around, firm)
    return out


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """A row of ``FEATURES`` for each block of a page."""
    none = Block("", 0, 0, (0, 0), 0)
    padded = [none, *found, none]
    return [
        (
            b.words, b.links, before.words, before.links, after.words, after.links,
            float(b.in_article), float(b.in_boilerplate), float(b.words_outside),
        )
        for before, b, after in zip(padded, found, padded[2:], strict=False)
    ]


#: A tree: a label, or feature, threshold, tree for values up to it, tree for those above.
Tree = bool | tuple[int, float, "Tree", "Tree"]


def grow(rows: list[tuple[float, ...]], labels: list[bool], depth: int = 5, least: int = 1) -> Tree:
    """A decision tree by Gini impurity; ties go to the first feature and threshold.

    Each side of a cut has ``least`` rows or more.
    """
    return _grown(np.array(rows, float), np.array(labels, bool), depth, least)


def _grown(x: np.ndarray, y: np.ndarray, depth: int, least: int) -> Tree:
    n, kept = len(y), int(y.sum())
    if depth == 0 or kept in (0, n):
        return 2 * kept >= n
    best, lowest = None, 2 * kept * (n - kept) / n - 1e-9
    sizes = np.arange(1, n)
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        values, below = x[order, feature], np.cumsum(y[order])[:-1]
        gini = 2 * below * (sizes - below) / sizes
        rest = kept - below
        gini = gini + 2 * rest * (n - sizes - rest) / (n - sizes)
        cut = (values[1:] > values[:-1]) & (sizes >= least) & (n - sizes >= least)
        gini = np.where(cut, gini, np.inf)
        at = int(gini.argmin()) if len(gini) else 0
        if len(gini) and gini[at] < lowest:
            lowest, best = gini[at], (feature, float(values[at] + values[at + 1]) / 2)
    if best is None:
        return 2 * kept >= n
    above = x[:, best[0]] > best[1]
    low, high = (_grown(x[side], y[side], depth - 1, least) for side in (~above, above))
    return low if isinstance(low, bool) and low is high else (*best, low, high)


def decide(tree: Tree, row: tuple[float, ...]) -> bool:
    while not isinstance(tree, bool):
        feature, threshold, low, high = tree
        tree = high if row[feature] > threshold else low
    return tree


def _text(n: int) -> str:
    return " ".join(["word"] * n)


def _links(n: int) -> str:
    return " ".join(["<a href='/x'>word</a>"] * n)


# Small pages whose blocks are labelled by the comment before them.
EXAMPLES = (
    f"<nav><!--drop--><ul><li>{_links(1)}<li>{_links(2)}<li>{_links(1)}</ul></nav>"
    f"<div class=ad><!--drop-->{_text(12)}</div>"
    f"<article><!--keep--><h1>{_text(6)}</h1><p>{_text(40)}<p>{_text(2)}<p>{_text(1)}"
    f"<p>{_text(90)} {_links(3)}<p>{_text(3)}</article>"
    f"<footer><!--drop-->{_text(9)}</footer>",
    f"<header><!--drop--><h1>{_text(3)}</h1><p>{_links(5)}</header>"
    f"<main><!--keep--><h2>{_text(5)}</h2><p>{_text(60)}<p>{_text(25)}<ul><li>{_text(4)}<li>{_text(7)}</ul>"
    f"<aside><!--drop--><p>{_text(30)}</aside><!--keep--><p>{_text(35)}"
    f"<div class=comments><!--drop--><p>{_text(22)}<p>{_text(45)}<p>{_text(3)}</div></main>",
    f"<div id=cookie-notice><!--drop-->{_text(28)} {_links(2)}</div>"
    f"<div><!--drop-->{_links(8)}</div><div><!--drop-->{_links(1)} {_links(1)}</div>"
    f"<div><!--keep--><h1>{_text(7)}</h1><p>{_text(55)}<p>{_text(70)}<p>{_text(12)}<p>{_text(48)}</div>"
    f"<form><!--drop-->{_text(6)}</form><div><!--drop-->{_links(6)}</div>",
    f"<div class=sidebar><!--drop--><p>{_text(33)}<p>{_links(9)}</div>"
    f"<article><!--keep--><p>{_text(4)}<p>{_links(4)} {_text(5)}<p>{_text(120)}<p>{_links(3)}</article>"
    f"<div class=related><!--drop-->{_links(10)} {_text(15)}</div><footer><!--drop--><p>{_text(50)}</footer>",
    f"<div><!--drop-->{_links(3)}</div><div><!--drop-->{_text(2)}</div><div><!--drop-->{_links(4)}</div>"
    f"<div><!--keep--><p>{_text(80)}<p>{_text(65)}</div><div><!--drop-->{_text(3)} {_links(3)}</div>",
    f"<div><!--drop-->{_links(5)}</div><div><!--keep--><p>{_text(14)}</div><div><!--drop-->{_links(7)}</div>"
    f"<div><!--drop-->{_text(3)}</div><div><!--drop-->{_links(2)}</div>",
    f"<nav><!--drop-->{_links(6)}</nav><article><!--keep--><h1>{_text(2)}</h1><p>{_text(3)}<p>{_text(30)}"
    f"<p>{_links(2)}<p>{_text(1)}</article><nav><!--drop-->{_links(3)}</nav>",
    f"<div><!--keep--><p>{_text(100)}<p>{_text(20)}</div><div><!--drop-->{_links(12)}</div>"
    f"<div><!--keep--><p>{_text(130)}</div><div><!--drop-->{_links(6)}</div><div><!--drop-->{_links(9)}</div>",
    f"<main class='has-sidebar'><!--keep--><div class='article-header'><h1>{_text(4)}</h1></div><p>{_text(50)}"
    f"<div class=widget><!--drop--><p>{_text(18)}<p>{_links(3)}</div><!--keep--><p>{_text(28)}<p>{_text(3)}</main>"
    f"<div class=sidebar><!--drop--><p>{_text(26)}<p>{_links(4)}</div>",
    f"<form><nav><!--drop-->{_links(5)}</nav><div><!--keep--><h1>{_text(6)}</h1><p>{_text(64)}<p>{_text(24)}"
    f"<p>{_text(75)} {_links(2)}</div><div class=comments><!--drop--><p>{_text(40)}<p>{_text(21)}</div>"
    f"<footer><!--drop-->{_text(23)}</footer></form>",
    f"<div><!--drop-->{_text(2)}</div><form><div><!--drop-->{_links(6)}</div><div><!--keep--><p>{_text(58)}"
    f"<p>{_text(19)}<p>{_text(81)}</div><div><!--drop-->{_links(8)}</div><div><!--drop-->{_text(2)}</div>"
    f"<div><!--drop-->{_links(4)}</div></form>",
    f"<article><!--keep--><h1>{_text(9)}</h1><p>{_text(4)}<p>{_text(8)}<div class=widget><p>{_text(52)}<p>{_text(31)}<p>{_text(66)}</div></article>"
    f"<div class=comments><!--drop--><p>{_text(38)}<p>{_text(62)}</div>",
    f"<div><!--drop-->{_links(4)}</div><article><!--keep--><h1>{_text(8)}</h1><p>{_text(13)}<form><p>{_text(47)}<p>{_text(73)}"
    f"<p>{_text(22)} {_links(2)}</form></article><footer><!--drop-->{_text(41)} {_links(3)}</footer>",
    f"<article><!--keep--><h1>{_text(3)}</h1><p>{_text(10)}</article><div class=comments><!--drop--><p>{_text(37)}"
    f"<p>{_text(54)}</div><footer><!--drop--><p>{_text(43)}<p>{_text(16)}</footer>",
    f"<div><!--drop-->{_text(2)}</div><div><!--keep--><p>{_text(13)}</div><div><!--drop-->{_text(3)}</div><aside><!--drop--><p>{_text(34)}<p>{_text(12)}</aside>"
    f"<footer><!--drop--><p>{_text(47)}<p>{_text(20)}</footer>",
)


def made_examples(n: int, seed: int = 0) -> list[str]:
    """Labelled pages of six layouts, in turn, with blocks of usual lengths.

    Three layouts have semantic elements, one has names only, in one names mislead, and one
    has neither: there a block's own and its neighbours' words and links are all there is.
    """
    rng = random.Random(seed)

    def some(low: int, high: int) -> str:
        return _text(rng.randint(low, high))

    def links(low: int, high: int, words: int = 2) -> str:
        return " ".join(f"<a href=/x>{some(1, words)}</a>" for _ in range(rng.randint(low, high)))

    def listed(low: int, high: int) -> str:
        return "<ul>" + "".join(f"<li>{links(1, 1, 3)}" for _ in range(rng.randint(low, high))) + "</ul>"

    def paragraph() -> str:
        kind = rng.random()
        if kind < 0.12:
            return f"<p>{some(1, 4)}</p>"
        if kind < 0.25:
            return f"<p>{some(5, 15)}</p>"
        if kind < 0.4:
            return f"<p>{some(15, 60)} {links(1, 3)} {some(5, 20)}</p>"
        if kind < 0.5:
            return f"<h2>{some(1, 8)}</h2><p>{some(20, 90)}</p>"
        if kind < 0.56:
            return f"<ul><li>{some(3, 12)}<li>{some(2, 15)}<li>{some(4, 20)}</ul>"
        return f"<p>{some(16, 130)}</p>"

    def body() -> str:
        count = rng.choice((1, 2, 4, 6, 9, 14))
        return f"<h1>{some(2, 12)}</h1>" * (rng.random() < 0.8) + "".join(paragraph() for _ in range(count))

    def menu(box: str = "div") -> str:
        inner = rng.choice((listed(3, 9), links(4, 10), links(5, 15, 5), f"{links(3, 6)} {some(1, 2)}"))
        return f"<{box}><!--drop-->{inner}</{box.split()[0]}>"

    def beside(box: str) -> str:
        inner = rng.choice(
            (f"<p>{some(4, 40)}", f"{some(2, 12)} {links(1, 5)}", listed(2, 8), f"<h3>{some(1, 4)}</h3>{listed(2, 6)}")
        )
        return f"<{box}><!--drop-->{inner}</{box.split()[0]}>"

    def comments(box: str) -> str:
        inner = "".join(f"<div>{links(1, 1)} {some(1, 4)}<p>{some(3, 70)}</div>" for _ in range(rng.randint(1, 5)))
        return f"<{box}><!--drop--><h3>{some(1, 3)}</h3>{inner}</{box.split()[0]}>"

    def foot(box: str) -> str:
        inner = rng.choice((some(3, 40), f"{some(2, 9)} {links(2, 6)}", f"<p>{some(3, 12)}<p>{links(3, 7)}"))
        return f"<{box}><!--drop-->{inner}</{box.split()[0]}>"

    def named(*names: str) -> str:
        return f"div class={rng.choice(names)}"

    def maybe(share: float, part: str) -> str:
        return part if rng.random() < share else ""

    def semantic() -> str:
        inner = maybe(0.3, beside("aside")) + "<!--keep-->" + body() + maybe(0.3, comments(named("comments", "replies")))
        return (
            maybe(0.5, f"<header><!--drop--><h1>{some(1, 4)}</h1>{links(2, 6)}</header>") + menu("nav")
            + maybe(0.5, beside(named("ad", "banner", "cookie-notice"))) + f"<article>{inner}</article>"
            + maybe(0.4, beside("aside")) + maybe(0.3, comments(named("comments"))) + foot("footer")
        )

    def with_main() -> str:
        inner = "<!--keep-->" + body() + maybe(0.5, beside(named("related-posts", "promo", "share-buttons")))
        return menu(named("navbar", "top-menu")) + f"<main>{inner}{maybe(0.4, comments('section id=discussion'))}</main>" + foot("footer")

    def only_names() -> str:
        return (
            maybe(0.6, foot(named("site-header", "masthead"))) + menu(named("nav", "main-menu"))
            + maybe(0.5, beside(named("ad-slot", "cookie-bar", "promo"))) + f"<div class=c1><!--keep-->{body()}</div>"
            + maybe(0.5, beside(named("sidebar", "widget"))) + maybe(0.4, comments(named("comments", "commentlist")))
            + foot(named("footer", "copyright"))
        )

    def misleading() -> str:
        box = rng.choice(("form", "div class=widget", "div class=notice", "div id=form-wrapper"))
        inner = f"<div><!--keep-->{body()}<p>{some(50, 120)}<p>{some(30, 90)}{maybe(0.5, f'<p>{some(1, 6)}')}</div>"
        if rng.random() < 0.4:
            head = f"<article><!--keep--><h1>{some(2, 12)}</h1>{maybe(0.3, f'<p>{some(2, 9)}')}"
            return menu("nav") + f"{head}<{box}>{inner}</{box.split()[0]}></article>" + foot("footer")
        inside = maybe(0.5, menu()) + inner + maybe(0.4, comments(named("comments")))
        return maybe(0.5, menu("nav")) + f"<{box}>{inside}</{box.split()[0]}>" + foot("footer")

    def bare() -> str:
        return (
            maybe(0.5, f"<div><!--drop-->{some(1, 4)}</div>") + menu() + maybe(0.4, menu())
            + maybe(0.6, f"<div><!--drop-->{some(1, 6)}</div>{menu()}")
            + f"<div><!--keep--><h1>{some(2, 12)}</h1><p>{some(16, 110)}</p>{body()}"
            + maybe(0.6, f"<p>{some(16, 110)}</p>") + "</div>" + maybe(0.6, menu()) + maybe(0.5, f"<div><!--drop-->{some(1, 5)} {links(2, 5)}</div>") + menu()
            + maybe(0.6, f"<div><!--drop-->{some(2, 9)}</div>")
        )

    def short() -> str:
        """An article of a few short blocks, links among them, with little or nothing else."""
        lines = (f"<p>{some(1, 6)}</p>", f"<p>{links(1, 4)}</p>", f"<h1>{some(1, 9)}</h1>", listed(1, 4), f"<p>{some(9, 60)}</p>")
        inner = "".join(rng.choice(lines) for _ in range(rng.choice((1, 1, 2, 3, 5))))
        box = rng.choice(("article", "article", "main"))
        return maybe(0.4, menu("nav")) + f"<{box}><!--keep-->{inner}</{box}>" + maybe(0.4, foot("footer"))

    layouts = (semantic, with_main, only_names, misleading, bare, short)
    return [layouts[i % len(layouts)]() for i in range(n)]


#: Pages of ``made_examples`` that the tree is grown on, and the least rows of a cut's side.
MADE, LEAST = 600, 3


@functools.cache
def trained(examples: tuple[str, ...] | None = None, depth: int = 10, least: int = LEAST) -> Tree:
    """The tree of the labelled blocks of example pages."""
    rows: list[tuple[float, ...]] = []
    labels: list[bool] = []
    for page in (*EXAMPLES, *made_examples(MADE)) if examples is None else examples:
        found = blocks(page)
        rows += features(found)
        labels += [bool(b.keep) for b in found]
    return grow(rows, labels, depth, least)


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    kept = (b.text for b, row in zip(found, features(found), strict=True) if decide(tree, row))
    return " ".join(kept)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py(), tree) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
