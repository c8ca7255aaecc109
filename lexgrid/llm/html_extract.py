"""HTML extraction: boosted trees judge every DOM node, and a hierarchical decoding picks the nodes of the main text.

A lenient parser builds the element tree; each element gets features of its own and of its subtree, parents and siblings:
tag, attribute tokens, depth, subtree text and link density, place among siblings. Gradient-boosted trees give the odds that
the element belongs to the main text. The decoding then takes the best labelling in which no element is main text under a
rejected ancestor. Texts of accepted elements are cut into blocks.

The trees are trained here, in the driver, on pages of a seeded generator of layouts (LAYOUTS of them) with known roles: a
fixed cost, independent of the data. Pages are then extracted in Arrow batches without a shuffle.

Defined cases: a null or empty page has an empty text; text outside any element counts as main text of the root. A tag that never
ends is text. Whole pages are read, in time that grows with their length only, however deep or broken they are; blocks are never
capped. Repeated rows are extracted one by one, an empty table gives no rows. Extra columns pass through, but for those named as a
result (`text`, `n_chars`), which it replaces, and the html.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is text up to their closing tag, whatever it looks like. Within FOREIGN they may be empty, and a title is an element.
RAW, FOREIGN = frozenset("script style textarea title".split()), frozenset("svg math".split())
#: Elements that part the words around them where they are left out.
APART = VOID | frozenset("noscript template iframe svg math select button object canvas video audio".split())
BLOCK = frozenset("html body address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split())
#: An opening tag of the key closes an open element of these tags, up to the nearest of SCOPE.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = frozenset("html body article aside section main nav div table ul ol dl form header footer blockquote figure fieldset".split())
CLOSABLE = frozenset(t for ts in CLOSES.values() for t in ts)
#: Elements that an open paragraph does not reach out of.
BOUNDS = SCOPE | {"li", "td", "th"}
OPENING = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|[!?])")
DELIMITER = re.compile(r"[>\"']")
ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label|name|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
WORDY = re.compile(r"[a-z]+")

TAGS = ("html", "body", "main", "article", "section", "div", "p", "h1", "h", "ul", "li", "a", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "inline", "head", "other")
GOOD = frozenset("article content entry post story main body text hentry blog page".split())
LISTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip".split(),
    "edge": "header footer masthead banner topbar sidebar aside side rail column widget foot copyright legal".split(),
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion promoted outbrain taboola teaser".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay subscribe newsletter signup login message dialog".split(),
    "talk": "comment comments respond reply replies disqus discussion feedback review reviews thread commentlist".split(),
    "share": "share sharing social related recommend recommended tags meta byline author rating print hidden".split(),
}
OF = {w: k for k, ws in enumerate(LISTS.values()) for w in ws}


class Node:
    __slots__ = ("tag", "parent", "parts", "good", "bad", "index", "depth", "siblings", "paragraph", "closable", "foreign")

    def __init__(self, tag: str, parent: Node | None, index: int, good: int, bad: tuple[int, ...]):
        self.tag, self.parent, self.index, self.good, self.bad = tag, parent, index, good, bad
        self.depth = parent.depth + 1 if parent else 0
        self.parts: list[str | Node] = []
        self.siblings = 0  # how many child elements it has
        # The nearest open paragraph and the nearest element that another may close, itself included, and whether it is foreign.
        self.paragraph = self if tag == "p" else None if tag in BOUNDS or not parent else parent.paragraph
        self.closable = self if tag in CLOSABLE else None if tag in SCOPE or not parent else parent.closable
        self.foreign = tag in FOREIGN or bool(parent and parent.foreign)


def marks(attributes: str) -> tuple[int, tuple[int, ...]]:
    """Counts of telling tokens among the attributes: of main text, and by list of others."""
    good, bad = 0, [0] * len(LISTS)
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name = name.lower()
        value = (a or b or c).lower()
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            bad[5] += 2
        elif name != "style":
            for w in WORDY.findall(value):
                k = OF.get(w)
                if k is not None:
                    bad[k] += 1
                elif w in GOOD:
                    good += 1
    return good, tuple(bad)


NONE = 0, (0,) * len(LISTS)


def tag_end(page: str, at: int, quotes: bool) -> int:
    """Where the `>` of a tag stands, from a place within it; one in a quoted value is passed over. -1 if there is none."""
    while found := DELIMITER.search(page, at):
        k = found.start()
        if page[k] == ">":
            return k
        at = k + 1
        if quotes:
            before = k - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=":
                at = page.find(page[k], k + 1) + 1
                if not at:
                    return -1
    return -1


def parse(page: str) -> list[Node]:
    """The elements in page order; the first is a root that holds all."""
    root = Node("html", None, 0, *NONE)
    nodes, top, at, n = [root], root, 0, len(page)
    open_: Counter[str] = Counter()
    quotes = True  # until a quoted value never ends

    def leave(x: Node) -> Node:
        """Close x and all that is open in it."""
        y = top
        while y is not x.parent:
            open_[y.tag] -= 1
            y = y.parent
        return y

    while at < n:
        found = OPENING.search(page, at)
        start = found.start() if found else n
        if not found:
            top.parts.append(page[at:])
            break
        name = found[2]
        if not name:
            comment = page.startswith("<!--", start)
            end = page.find("-->" if comment else ">", start + 4 if comment else start)
            if end < 0 and not comment:
                top.parts.append(page[at:])
                break
            if start > at:
                top.parts.append(page[at:start])
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        end = tag_end(page, found.end(), quotes)
        if end < 0 and quotes:
            quotes = False
            end = tag_end(page, found.end(), quotes)
        if end < 0:
            top.parts.append(page[at:])
            break
        if start > at:
            top.parts.append(page[at:start])
        at = end + 1
        tag = name.lower()
        if found[1]:
            if open_[tag] > 0:
                x = top
                while x.tag != tag:
                    x = x.parent
                top = leave(x)
            continue
        if tag == "html":
            continue
        if tag in BLOCK and top.paragraph:  # a block ends an open paragraph
            top = leave(top.paragraph)
        if tag in CLOSES:
            x = top.closable
            while x and x.tag not in CLOSES[tag]:
                x = x.parent.closable
            if x:
                top = leave(x)
        text = page[found.end() : end]
        closed = text.rstrip().endswith("/")
        if tag in RAW and not ((closed or tag == "title") and top.foreign):
            close = ENDS[tag].search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else n
            top.parts.append(" ")
            continue
        node = Node(tag, top, len(nodes), *(marks(text) if text else NONE))
        top.siblings += 1
        top.parts.append(node)
        nodes.append(node)
        if tag not in VOID and not closed:
            top = node
            open_[tag] += 1
    return nodes


def kind(tag: str) -> int:
    if tag in TAGS:
        return TAGS.index(tag)
    if len(tag) == 2 and tag[0] == "h":
        return TAGS.index("h")
    if tag in ("b", "i", "em", "strong", "span", "br", "small", "u", "code", "font", "sup", "sub", "img", "mark", "time", "abbr", "cite", "q"):
        return TAGS.index("inline")
    if tag in ("ol", "dl", "menu"):
        return TAGS.index("ul")
    if tag in ("th", "tr", "tbody", "thead", "dd", "dt"):
        return TAGS.index("td")
    return TAGS.index("other")


KIND = {t: kind(t) for t in [*BLOCK, *VOID, "a", "b", "i", "em", "strong", "span", "small", "u", "code", "font", "time", "abbr", "label", "option", "input", "legend", "center"]}


CHROME = [TAGS.index(t) for t in ("nav", "header", "footer", "aside", "form")]


def describe(trees: list[list[Node]]) -> np.ndarray:
    """A row of numbers for each element of all trees, computed level by level over all of them at once."""
    flat = [x for t in trees for x in t]
    base = np.cumsum([0, *map(len, trees)])
    parent = np.array([x.parent.index if x.parent else 0 for x in flat], dtype=np.int64) + np.repeat(base[:-1], np.diff(base))
    tag = np.array([KIND[x.tag] if x.tag in KIND else kind(x.tag) for x in flat], dtype=np.int64)
    depth = np.array([x.depth for x in flat], dtype=np.int64)
    siblings = np.array([x.siblings for x in flat], dtype=float)
    good = np.array([x.good for x in flat], dtype=float)
    bad = np.array([x.bad for x in flat], dtype=float)
    own = np.array([sum([len(p) for p in x.parts if type(p) is str and not p.isspace()]) for x in flat], dtype=float)
    size, tags, linked, link = own.copy(), np.ones(len(flat)), np.zeros(len(flat)), tag == TAGS.index("a")
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 1)))[1:]
    for rows in reversed(levels):
        to = parent[rows]
        linked[rows[link[rows]]] = size[rows[link[rows]]]
        for total in (size, tags, linked):
            np.add.at(total, to, total[rows])
    above, within, chrome = np.zeros_like(bad), np.zeros(len(flat)), np.zeros(len(flat))
    heart = np.maximum(good, np.isin(tag, (TAGS.index("main"), TAGS.index("article"))))
    frame = np.isin(tag, CHROME).astype(float)
    for rows in levels:
        to = parent[rows]
        above[rows] = np.maximum(above[to], bad[to])
        within[rows] = np.maximum(within[to], heart[to])
        chrome[rows] = np.maximum(chrome[to], frame[to])
    whole = np.maximum(size[base[:-1]], 1).repeat(np.diff(base)) if len(trees) else size
    before = np.cumsum(own) - own
    before -= before[base[:-1]].repeat(np.diff(base)) if len(trees) else 0
    up = np.maximum(size[parent], 1)
    return np.column_stack([
        np.eye(len(TAGS))[tag], good, bad, above, within, depth, size / whole, linked / np.maximum(size, 1), size / tags, size / up, siblings[parent],
        tags, frame, chrome, before / whole, linked[parent] / up, np.log1p(size), np.log1p(size[parent]),
    ]).astype(np.float32)


class Boosted:
    """Gradient-boosted regression trees on the logistic loss: histogram splits, complete trees of fixed depth."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32):
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])  # bin b: x <= edges[b]
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.bias)
        self.feature, self.cut, self.value = [], [], []
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
            at = np.zeros(len(y), dtype=np.int64)
            for node in range(inner):
                rows = np.flatnonzero(at == node)
                best, where = 1e-3, None
                if len(rows) > 10:
                    G, H = g[rows].sum(), h[rows].sum()
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        gs = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
                        hs = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
                        gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
                        gain[(hs < 0.5) | (H - hs < 0.5)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, where = gain[k], (j, k)
                if where is not None:
                    feature[node], cut[node] = where[0], edges[where[0]][where[1]]
                right = rows[x[rows, feature[node]] > cut[node]]
                at[rows] = 2 * node + 1
                at[right] = 2 * node + 2
            leaf = at - inner
            value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
            f += value[leaf]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        f = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            f += value[at - len(feature)]
        return f


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The labelling of greatest likelihood in which every main element's parent is main as well."""
    gain = odds.astype(float).copy()  # of labelling the element main with the best below it, over rejecting all of it
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[nodes[i].parent.index] += gain[i]
    main = np.zeros(len(nodes), dtype=bool)
    main[0] = True
    for i in range(1, len(nodes)):
        main[i] = gain[i] > 0 and main[nodes[i].parent.index]
    return main


def blocks(nodes: list[Node], main: np.ndarray) -> str:
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(now)).split())
        if text:
            out.append(text)
        now.clear()

    stack: list[tuple[Node, int]] = [(nodes[0], 0)]
    while stack:
        node, k = stack.pop()
        if k == 0 and node.tag in BLOCK:
            flush()
        while k < len(node.parts):
            part = node.parts[k]
            k += 1
            if type(part) is str:
                now.append(part)
            elif main[part.index]:
                stack.append((node, k))
                stack.append((part, 0))
                break
            elif part.tag in BLOCK:
                flush()
            elif part.tag in APART:
                now.append(" ")
        else:
            if node.tag in BLOCK:
                flush()
            elif node.tag in VOID:
                now.append(" ")
    flush()
    return "\n".join(out)


LAYOUTS, SEED = 400, 3
#: Elements within a paragraph's text.
INLINE = ("em", "strong", "code", "span", "math", "sup", "abbr", "q", "time")


def layout(rng: random.Random) -> tuple[str, set[int]]:
    """A made-up page, and which of its elements are main text, by the order of their opening tags."""
    parts: list[str] = []
    main: set[int] = set()
    count = 0

    def word() -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 9)))

    def say(n: int) -> str:
        return " ".join(word() for _ in range(max(1, n))).capitalize() + rng.choice((".", ".", ".", "!", "?", ""))

    def tag(name: str, inner, is_main: bool, attributes: str = "", close: bool = True) -> None:
        nonlocal count
        count += 1
        if is_main:
            main.add(count)
        parts.append(f"<{name}{' ' + attributes if attributes else ''}>")
        if callable(inner):
            inner()
        else:
            parts.append(inner)
        if close:
            parts.append(f"</{name}>")

    def marked(words: list[str]) -> str:
        w = rng.choice(words) + rng.choice(("", "", f"-{rng.choice(['box', 'area', 'wrap', 'list', 'inner'])}", f" {word()}"))
        return rng.choice((f'class="{w}"', f'id="{w}"', f'class="{word()} {w}"'))

    def links(n: int) -> None:
        for _ in range(n):
            tag("li", lambda: tag("a", say(rng.randint(1, 3)), False, f'href="/{word()}"'), False)

    def menu() -> None:
        tag("ul", lambda: links(rng.randint(3, 9)), False)

    def chrome(name: str, words: list[str], prose: bool) -> None:
        semantic = rng.random() < 0.5
        attributes = marked(words) if not semantic or rng.random() < 0.5 else ""

        def inner() -> None:
            if rng.random() < 0.25:  # a line of text and no element
                parts.append(say(rng.randint(2, 30)))
                return
            if rng.random() < 0.4:
                tag("h3", say(2), False)
            for _ in range(rng.randint(1, 3)):
                r = rng.random()
                if prose and r < 0.6:
                    tag("p", say(rng.randint(4, 40)), False)
                elif r < 0.8:
                    menu()
                else:
                    parts.append(say(rng.randint(2, 12)))

        tag(name if semantic else rng.choice(("div", "section", "div")), inner, False, attributes)

    def advert() -> None:
        tag(rng.choice(("div", "aside", "section", "ins", "p")), say(rng.randint(3, 25)), False, marked(LISTS["advert"]))

    def notice() -> None:
        tag(rng.choice(("div", "section", "p", "dialog")), lambda: (parts.append(say(rng.randint(4, 30))), tag("a", say(2), False, 'href="#"')), False, marked(LISTS["notice"]))

    def form() -> None:
        tag("form", lambda: (tag("label", say(2), False), tag("input", "", False, 'type="text"', False), tag("p", say(5), False)), False, rng.choice(("", marked(["search", "contact"]))))

    def talk() -> None:
        def inner() -> None:
            tag(rng.choice(("h2", "h3")), say(2), False)
            for _ in range(rng.randint(1, 6)):
                tag(rng.choice(("div", "li", "article")), lambda: tag("p", say(rng.randint(3, 50)), False), False, rng.choice(('class="comment"', 'class="comment-body"', 'class="reply"', f'class="{word()}"')))

        tag(rng.choice(("div", "section", "ul", "aside")), inner, False, marked(LISTS["talk"]))

    def paragraph() -> None:
        r = rng.random()
        if r < 0.7:
            if rng.random() < 0.2:
                tag("p", lambda: (tag("b", say(rng.randint(2, 40)), True), tag("br", "", True, "", False)), True, "", rng.random() < 0.5)
            else:
                tag("p", lambda: (parts.append(say(rng.randint(1, 90)) + " "), tag("a", say(2), True, 'href="/x"') if rng.random() < 0.3 else None, tag(rng.choice(INLINE), say(rng.randint(1, 2)), True) if rng.random() < 0.3 else None, parts.append(" " + say(rng.randint(1, 20))) if rng.random() < 0.3 else None), True, "", rng.random() < 0.9)
        elif r < 0.78:
            tag(rng.choice(("h2", "h3")), say(rng.randint(1, 6)), True)
        elif r < 0.86:
            tag(rng.choice(("ul", "ol")), lambda: [tag("li", say(rng.randint(2, 20)), True) for _ in range(rng.randint(2, 5))], True)
        elif r < 0.9:
            tag("blockquote", lambda: tag("p", say(rng.randint(5, 40)), True), True)
        elif r < 0.93:
            tag("pre", say(20), True)
        elif r < 0.96:
            tag("table", lambda: [tag("tr", lambda: [tag("td", say(2), True) for _ in range(3)], True) for _ in range(2)], True)
        elif r < 0.98:
            tag("figure", lambda: tag("figcaption", say(6), True), True)
        else:
            tag("div", say(rng.randint(5, 60)), True)

    def brief() -> None:
        """An article of less text than what stands around it."""
        if rng.random() < 0.8:
            tag("h1", say(rng.randint(1, 6)), True)
        for _ in range(rng.choice((0, 1, 1, 1, 2))):
            tag("p", lambda: tag("b", say(rng.randint(1, 6)), True) if rng.random() < 0.2 else parts.append(say(rng.randint(1, 8))), True, "", rng.random() < 0.9)

    def body_text() -> None:
        if rng.random() < 0.3:
            brief()
            return
        r = rng.random()
        if r < 0.7:
            tag("h1", say(rng.randint(2, 12)), True)
        elif r < 0.8:
            tag("header", lambda: tag("h1", say(rng.randint(2, 12)), True), True)
        for _ in range(rng.choice((1, 2, 4, 8, 16))):
            paragraph()
            r = rng.random()
            if r < 0.06:
                advert()
            elif r < 0.09:
                notice()
            elif r < 0.11:
                form()
        if rng.random() < 0.2:
            chrome("footer", ["share", "related", "tags", "social"], False)
        if rng.random() < 0.1:
            talk()

    def article() -> None:
        r = rng.random()
        if r < 0.6:
            tag("article", body_text, True, rng.choice(("", "", 'class="post"', f'id="{word()}"')))
        elif r < 0.75:
            tag("main", body_text, True)
        elif r < 0.93:
            tag("div", body_text, True, rng.choice(('class="content"', 'id="main-content"', 'class="entry-content"', 'class="post-body"', 'class="article-text"', 'class="story"')))
        else:
            tag("section", body_text, True, rng.choice(('class="content"', "")))

    def middle() -> None:
        if rng.random() < 0.4:
            chrome("aside", LISTS["edge"], True)
        article()
        if rng.random() < 0.3:
            talk()
        if rng.random() < 0.3:
            chrome("aside", ["sidebar", "related", "widget", "recommended"], True)

    def page() -> None:
        if rng.random() < 0.3:
            notice()
        if rng.random() < 0.4:
            chrome("header", ["header", "masthead", "banner", "topbar"], True)
        if rng.random() < 0.8:
            chrome("nav", LISTS["menu"], False)
        if rng.random() < 0.4:
            advert()
        r = rng.random()
        if r < 0.5:
            middle()
        elif r < 0.8:
            tag("div", middle, True, rng.choice(('class="wrapper"', 'id="page"', 'class="container"', "")))
        else:
            tag("main", middle, True)
        if rng.random() < 0.3:
            form()
        if rng.random() < 0.8:
            chrome("footer", ["footer", "copyright", "legal"], True)

    def head() -> None:
        tag("meta", "", False, 'charset="utf-8"', False)

    parts.append("<!DOCTYPE html><html>")
    tag("head", head, False)
    tag("body", page, True)
    return "".join(parts), main


def train() -> Boosted:
    rng = random.Random(SEED)
    made = [layout(rng) for _ in range(LAYOUTS)]
    trees = [parse(page) for page, _ in made]
    y = np.concatenate([[i == 0 or i in main for i in range(len(t))] for t, (_, main) in zip(trees, made)])
    return Boosted().fit(describe(trees), y.astype(float))


def extract(pages: list[str | None], model: Boosted) -> list[str]:
    trees = [parse(p or "") for p in pages]
    odds = model.odds(describe(trees))
    out, at = [], 0
    for t in trees:
        out.append(blocks(t, decode(t, odds[at : at + len(t)])))
        at += len(t)
    return out


def extract_text(pages: DataFrame, html: str = "html", model: Boosted | None = None) -> DataFrame:
    """All columns of pages but the html, plus `text` and `n_chars`."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    schema = T.StructType([pages.schema[c] for c in kept] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    model = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                texts = extract(part.column(html).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in kept] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.select(*kept, html).mapInArrow(run, schema)
