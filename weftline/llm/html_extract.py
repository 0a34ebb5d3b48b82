"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and text of a page is a variable, content or not. A node's own evidence (tag, words of class
and id, lengths, link share, marks) and potentials between parent and child are log-linear; messages upward
and downward give exact marginals, and fitting maximises the likelihood of labelled pages with gradients from
the same messages. Levels of the trees of many pages are passed at once, as arrays.
"""

from __future__ import annotations

import dataclasses
import functools
import html
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import table

# -- pages to trees

#: A tag whose quoted values hold no angle brackets; most tags are read by this alone.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^\"'<>]|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
BEGINS, NAME = re.compile(r"<(?=[a-zA-Z/!?])"), re.compile(r"</?([a-zA-Z][^\s/<>]*+)")
#: One attribute after the other, so that words inside quoted values are not taken for names; those that are looked at.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
ATTRIBUTES = frozenset(("class", "id", "role", "aria-label", "hidden", "style"))
GAP, KEY, EQUALS, BARE = re.compile(r"[\s/]*+"), re.compile(r"=?[^\s/>=<]*+"), re.compile(r"\s*+=\s*+"), re.compile(r"[^\s>]*+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements inside one another at most, as in browsers; deeper ones are children of the last.
DEEPEST = 512
# Fixed values of HTML: elements without content, elements whose content is no text of the page (the second
# row: up to their end tag it holds no elements), what may stand in a head, inline elements, and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("template head object svg annotation annotation-xml select button datalist canvas audio video".split())
RAW = frozenset("script style textarea title iframe noscript noframes noembed xmp".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

P_SCOPE = frozenset("table button article aside section main div td li footer header nav form blockquote figure".split())
SCOPE = CLOSES_P | {"li", "td", "th"}
#: Names that begin a tag even where its bracket is missing.
BREAKS = CLOSES_P | frozenset("html head body title noframes li dt dd tr td th tbody thead tfoot caption option optgroup summary legend br".split())  # end a block; others flow
KNOWN = VOID | DROPPED | RAW | INLINE | BREAKS | {"math"}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}

TAGS = "article main section div p heading list item a nav header footer aside form table cell quote inline body text other".split()
TAG_OF = {"html": "body", "body": "body", "ul": "list", "ol": "list", "dl": "list", "menu": "list", "li": "item", "dt": "item", "dd": "item", "tbody": "table", "tr": "table", "td": "cell", "th": "cell", "blockquote": "quote", "pre": "quote", "figure": "quote", "figcaption": "quote", "fieldset": "form", "input": "form", **{f"h{k}": "heading" for k in range(1, 7)}, **dict.fromkeys(INLINE - {"a"}, "inline")}
TAG_OF |= {name: name for name in TAGS if name not in ("heading", "list", "item", "cell", "quote", "inline", "text", "other")}
# Words in class, id and role, by what they hint at.
HINTS = {
    "content": "article content post entry story main body text prose",
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header masthead topbar site-header banner logo branding",
    "footer": "footer copyright legal colophon bottom",
    "side": "sidebar aside widget widgets rail complementary",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup paywall warning",
    "comment": "comment comments reply replies discussion respond disqus reader",
    "share": "share sharing social follow tags",
    "more": "related recommended recommendations more trending popular teaser",
    "form": "form search login contact",
}
HINT_OF = {word: k for k, words in enumerate(HINTS.values()) for word in words.split()}
WORD = re.compile(r"[a-z]+")
MARK = re.compile(r"[.!?,;:]")

N_FEATURES = len(TAGS) + len(HINTS) + 9


@dataclasses.dataclass
class Tree:
    """Nodes in page order, the root first; texts have no children. ``breaks``: whether a text begins a block."""

    parent: list[int]
    tag: list[int]
    hints: list[int]
    text: list[str]
    breaks: list[bool]


class _Open:
    """The open elements of a page. Finding and closing them takes no walk along the stack."""

    def __init__(self) -> None:
        self.names, self.nodes, self.hides = [""], [0], [False]
        self.places: dict[str, list[int]] = {}
        self.hiding = 0

    def push(self, name: str, node: int, hides: bool) -> None:
        self.places.setdefault(name, []).append(len(self.names))
        self.names.append(name), self.nodes.append(node), self.hides.append(hides)
        self.hiding += hides

    def place(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else 0

    def close(self, names: Iterable[str], until: Iterable[str] = ()) -> None:
        """Close the last open one of ``names``, and all in it, unless one of ``until`` is open inside it."""
        at, places = 0, self.places
        for name in names:
            if (held := places.get(name)) and held[-1] > at:
                at = held[-1]
        if at:
            for name in until:
                if (held := places.get(name)) and held[-1] > at:
                    return
            while len(self.names) > at:
                places[self.names.pop()].pop()
                self.nodes.pop()
                self.hiding -= self.hides.pop()


def _odd_attributes(page: str, at: int, find) -> tuple[int, bool, list[tuple[str, str]]]:
    """The end of a tag with brackets in its values or quotes left open, whether it is ended by its bracket, and its attributes.

    A quote is left open if it is never closed, or if a bracket stands before a closing quote that more text
    follows at once; the tag then ends at the first bracket.
    """
    attributes = []
    while True:
        at = GAP.match(page, at).end()
        if at == len(page) or page[at] == "<":
            return at, False, attributes
        if page[at] == ">":
            return at + 1, True, attributes
        key = KEY.match(page, at)
        at, value = key.end(), ""
        if equals := EQUALS.match(page, at):
            at = equals.end()
            if (quote := page[at : at + 1]) in ('"', "'"):
                closed, bracket = find(quote, at + 1), find(">", at + 1)
                whole = closed < len(page) and (closed < bracket or page[closed + 1 : closed + 2] in " \t\r\n\f/>")
                end = closed if whole else bracket
                value, at = page[at + 1 : end], end + whole
            else:
                bare = BARE.match(page, at)
                value, at = bare.group(), bare.end()
        attributes.append((key.group(), value))


def _hints(attributes: Iterable[tuple[str, str]]) -> tuple[int, bool]:
    """What words of names and roles hint at, and whether the element is hidden."""
    hints, hidden = 0, False
    for key, value in attributes:
        key = key.lower()
        if key not in ATTRIBUTES:
            continue
        if key == "hidden" or key == "style" and HIDDEN.search(value):
            hidden = True
        elif key != "style":
            for word in WORD.findall(value.lower()):
                if word in HINT_OF:
                    hints |= 1 << HINT_OF[word]
    return hints, hidden


def parse(page: str) -> Tree:
    """The tree of a page, as browsers nest it in the cases that matter for text; never fails, in linear time.

    What is hidden, or no text of the page, is on the stack of open elements until it is closed like any
    other, so elements nest in it, and texts and elements in it are left out.
    """
    tree = Tree([-1], [TAGS.index("body")], [0], [""], [True])
    stack = _Open()
    fresh = True  # a block begins with the next text
    text_tag = TAGS.index("text")
    near: dict[str, int] = {}

    def find(mark: str, start: int) -> int:
        """The next place of a mark, the page's end for none; a place found is kept, as tags may ask for it again."""
        if near.get(mark, -1) < start:
            found = page.find(mark, start)
            near[mark] = found if found >= 0 else len(page)
        return near[mark]

    def add_text(raw: str) -> None:
        nonlocal fresh
        if not raw:
            return
        if stack.names[-1] == "head" and not raw.isspace():
            stack.close(("head",))
        if stack.hiding:
            return
        if "&" in raw:
            raw = html.unescape(raw)
        tree.parent.append(stack.nodes[-1]), tree.tag.append(text_tag), tree.hints.append(0), tree.text.append(raw), tree.breaks.append(fresh)
        if not raw.isspace():
            fresh = False

    at = mark = 0  # text that is not added yet begins at ``at``
    while begins := BEGINS.search(page, mark):
        mark, kind = begins.start(), page[begins.end()]
        if kind in ("!", "?"):
            add_text(page[at:mark])
            if page.startswith("<!--", mark):
                end = page.find("-->", mark + 2)  # "<!-->" is a comment too
                at = mark = end + 3 if end >= 0 else len(page)
            else:
                at = mark = min(find(">", mark) + 1, len(page))
            continue
        found = TAG.match(page, mark)
        if found:
            closing, name, end = found.group(1), found.group(2).lower(), found.end()
            written = found.group(3)
            attributes = ((k, a or b or c) for k, a, b, c in ATTRIBUTE.findall(written)) if "=" in written or "idden" in written.lower() else ()
            alone = written.rstrip().endswith("/")
        else:
            begun = NAME.match(page, mark)
            if not begun:  # an end tag of nothing
                add_text(page[at:mark])
                at = mark = min(find(">", mark) + 1, len(page))
                continue
            closing, name = kind == "/", begun.group(1).lower()
            end, ended, attributes = _odd_attributes(page, begun.end(), find)
            if not ended and name not in KNOWN:
                mark += 1
                continue
            alone = ended and page[end - 2] == "/"
        add_text(page[at:mark])
        at = mark = end
        fresh |= name in BREAKS
        if name not in IN_HEAD and name != "head" and stack.place("head"):
            stack.close(("head",))
        if closing:
            if name not in VOID:
                stack.close((name,), () if name not in INLINE else SCOPE)  # an inline end tag stays inside its block
            continue
        if name in RAW:
            if not (alone and stack.place("svg")):
                ends = RAW_END[name].search(page, at)
                at = mark = ends.end() if ends else len(page)
            continue
        if name in VOID:
            continue
        if name in CLOSES_P:
            if stack.place("svg"):  # such elements end a drawing that was left open
                stack.close(("svg",), ("foreignobject",))
            stack.close(("p",), P_SCOPE)
        if name in CLOSES:
            stack.close(*CLOSES[name])
        hints, hidden = _hints(attributes)
        hidden |= name in DROPPED
        if alone and (name in ("svg", "math") or stack.place("svg") or stack.place("math")):
            continue
        if hidden or stack.hiding or len(stack.nodes) > DEEPEST:
            stack.push(name, stack.nodes[-1], hidden)
            continue
        tree.parent.append(stack.nodes[-1]), tree.tag.append(TAGS.index(TAG_OF.get(name, "other"))), tree.hints.append(hints), tree.text.append(""), tree.breaks.append(False)
        stack.push(name, len(tree.parent) - 1, False)
    add_text(page[at:])
    return tree


@dataclasses.dataclass
class Forest:
    """Trees of several pages as arrays: features, parents and levels."""

    features: np.ndarray
    parent: np.ndarray
    kind: np.ndarray  # which potentials join a node to its parent
    levels: list[np.ndarray]  # nodes by depth
    roots: np.ndarray


def forest(trees: list[Tree]) -> Forest:
    sizes = [len(t.parent) for t in trees]
    starts = np.cumsum([0, *sizes])[:-1]
    parent = np.concatenate([np.array(t.parent) + s for t, s in zip(trees, starts)])
    parent[starts] = -1
    tag = np.concatenate([t.tag for t in trees])
    hints = np.concatenate([t.hints for t in trees])
    length = np.array([len(" ".join(x.split())) if x else 0 for t in trees for x in t.text], dtype=np.float64)
    marks = np.array([len(MARK.findall(x)) if x else 0 for t in trees for x in t.text], dtype=np.float64)
    sign = np.array([("©" in x or "(c)" in x) if x else False for t in trees for x in t.text], dtype=np.float64)
    depth = np.zeros(len(parent), dtype=np.int64)
    level, levels = starts, []
    order = np.argsort(parent, kind="stable")
    first = np.searchsorted(parent[order], np.arange(len(parent)))
    last = np.searchsorted(parent[order], np.arange(len(parent)), side="right")
    while len(level):
        depth[level] = len(levels)
        levels.append(level)
        counts = last[level] - first[level]
        level = order[np.repeat(first[level] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
    links = np.where(tag == TAGS.index("a"), 1, 0)
    in_link = links.copy()
    for nodes in levels[1:]:
        in_link[nodes] |= in_link[parent[nodes]]
    total, linked, marked, texts = length.copy(), length * in_link, marks.copy(), (length > 0).astype(np.float64)
    for nodes in reversed(levels[1:]):
        for values in (total, linked, marked, texts):
            np.add.at(values, parent[nodes], values[nodes])
    page = np.repeat(np.arange(len(trees)), sizes)
    x = np.zeros((len(parent), N_FEATURES))
    x[np.arange(len(parent)), tag] = 1
    for k in range(len(HINTS)):
        x[:, len(TAGS) + k] = (hints >> k) & 1
    at = len(TAGS) + len(HINTS)
    x[:, at] = 1
    x[:, at + 1] = np.log1p(total) / 5
    x[:, at + 2] = linked / np.maximum(total, 1)
    x[:, at + 3] = np.minimum(marked / np.maximum(total, 1) * 20, 2)
    x[:, at + 4] = total / np.maximum(total[starts][page], 1)
    x[:, at + 5] = np.log1p(total / np.maximum(texts, 1)) / 5
    x[:, at + 6] = np.minimum(depth, 12) / 12
    x[:, at + 7] = in_link
    x[:, at + 8] = sign
    kind = np.select([tag == TAGS.index("text"), np.isin(tag, [TAGS.index(n) for n in ("inline", "a")]), np.isin(tag, [TAGS.index(n) for n in ("p", "heading", "quote", "item")])], [0, 1, 2], 3)
    return Forest(x, parent, kind, levels, starts)


# -- the model

KINDS = 4


@dataclasses.dataclass
class TreeModel:
    weights: np.ndarray  # evidence for content, by feature
    potentials: np.ndarray  # KINDS by label of the parent by label of the child

    def messages(self, f: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log marginals of nodes, log marginals of (parent, child) labels, and log partition values of pages.

        Upward, a child tells its parent what its subtree holds for each label of the parent; downward, a parent
        tells a child what all else holds. Both sums are exact, as a tree has no cycles.
        """
        own = np.zeros((len(f.parent), 2))
        own[:, 1] = f.features @ self.weights
        below = own.copy()  # evidence of the subtree
        up = np.zeros_like(own)
        for nodes in reversed(f.levels[1:]):
            up[nodes] = np.logaddexp.reduce(self.potentials[f.kind[nodes]] + below[nodes][:, None, :], axis=2)
            np.add.at(below, f.parent[nodes], up[nodes])
        partition = np.logaddexp.reduce(below[f.roots], axis=1)
        belief = below.copy()
        pair = np.full((len(f.parent), 2, 2), -np.inf)
        for nodes in f.levels[1:]:
            above = belief[f.parent[nodes]] - up[nodes]
            joint = above[:, :, None] + self.potentials[f.kind[nodes]] + below[nodes][:, None, :]
            belief[nodes] = np.logaddexp.reduce(joint, axis=1)
            pair[nodes] = joint - np.logaddexp.reduce(joint.reshape(len(nodes), 4), axis=1)[:, None, None]
        return belief - np.logaddexp.reduce(belief, axis=1)[:, None], pair, partition

    def content(self, f: Forest) -> np.ndarray:
        """Marginal probability of content, by node."""
        return np.exp(self.messages(f)[0][:, 1])


def fit(pages: list[tuple[Tree, np.ndarray]], steps: int = 200, decay: float = 0.004) -> TreeModel:
    """Potentials that maximise the likelihood of labelled pages: (tree, label of each node), by gradient ascent."""
    f = forest([tree for tree, _ in pages])
    y = np.concatenate([labels for _, labels in pages]).astype(np.int64)
    model = TreeModel(np.zeros(N_FEATURES), np.zeros((KINDS, 2, 2)))
    inner = f.parent >= 0
    true_pairs = np.zeros_like(model.potentials)
    np.add.at(true_pairs, (f.kind[inner], y[f.parent[inner]], y[inner]), 1)
    true_features = f.features.T @ y
    moments = [np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.zeros_like(true_pairs), np.zeros_like(true_pairs)]
    for step in range(1, steps + 1):
        marginal, pair, _ = model.messages(f)
        pairs = np.zeros_like(true_pairs)
        np.add.at(pairs, f.kind[inner], np.exp(pair[inner]))
        for k, (value, gradient) in enumerate(((model.weights, (true_features - f.features.T @ np.exp(marginal[:, 1])) / len(pages) - decay * model.weights), (model.potentials, (true_pairs - pairs) / len(pages) - decay * model.potentials))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * gradient
            moments[2 * k + 1] = 0.999 * moments[2 * k + 1] + 0.001 * gradient**2
            value += 0.1 * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.999**step)) + 1e-8)
    return model


# -- labelled pages


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, list[str]]]:
    """``n`` made-up pages with the texts of their content, in order: layouts, names and wordings vary freely."""
    rng = random.Random(seed)
    letters, marks = "etaoinshrdlucmfwypvbgkjqxz", "!#$%()*+,-./:;=?@[]^_{|}~"

    def word() -> str:
        w = "".join(rng.choice(letters[: rng.choice((8, 16, 26))]) for _ in range(rng.randint(1, 11)))
        return w + rng.choice(marks) * rng.randint(1, 4) if rng.random() < noise else w.upper() if rng.random() < noise / 2 else w

    def prose(low: int, high: int) -> str:
        out = []
        for _ in range(rng.randint(low, high)):
            w = word()
            out.append(w + rng.choice((".", ".", ",", "!", "?", ";", f" {rng.choice(marks)}")) if rng.random() < 0.15 else w)
        return " ".join(out).capitalize() + rng.choice((".", ".", ".", "", "!"))

    def name(kind: str) -> str:
        words = HINTS[kind].split()
        style = rng.random()
        if style < 0.25:
            return ""
        value = rng.choice(words) if style < 0.7 else f"{rng.choice(('site', 'page', 'x', 'block', 'js'))}-{rng.choice(words)}"
        return f' {rng.choice(("class", "class", "id"))}="{value}"'

    def links(n_low: int, n_high: int) -> str:
        items = [f'<a href="/{word()}">{prose(1, 5)}</a>' for _ in range(rng.randint(n_low, n_high))]
        return f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>" if rng.random() < 0.7 else " | ".join(items)

    def boiler(kind: str) -> str:
        tag = {"nav": ("nav", "nav", "div"), "header": ("header", "header", "div"), "footer": ("footer", "footer", "div"), "side": ("aside", "aside", "div")}.get(kind, ("div", "div", "section", "aside"))
        tag = rng.choice(tag)
        label = name(kind)
        while not label and tag in ("div", "section"):
            label = name(kind)
        if kind == "nav":
            inside = links(3, 12)
        elif kind == "header":
            inside = rng.choice((f"<h1>{prose(1, 4)}</h1>", f"<a href='/'>{prose(1, 3)}</a>", f"<p>{prose(2, 9)}</p>")) + (links(2, 6) if rng.random() < 0.5 else "")
        elif kind == "footer":
            inside = rng.choice((f"&copy; {word()} &middot; {prose(2, 14)}", f"<p>&copy; {prose(3, 12)}</p>", links(3, 8) + f"<p>{prose(3, 20)}</p>", f"<small>{prose(4, 20)}</small>"))
        elif kind == "comment":
            inside = f"<h3>{prose(1, 3)}</h3>" + "".join(f'<{rng.choice(("div", "li", "article"))} class="comment"><b>{word()}</b><p>{prose(3, 60)}</p>' + "</div>" for _ in range(rng.randint(1, 5)))
        elif kind == "form":
            inside = f'<form><label>{prose(1, 4)}</label><input name="q"><button>{word()}</button></form>'
        elif kind in ("side", "more"):
            inside = f"<h3>{prose(1, 3)}</h3>" + rng.choice((links(2, 8), f"<p>{prose(5, 40)}</p>", f"<p>{prose(5, 25)}</p>" + links(1, 4)))
        elif kind == "share":
            inside = links(2, 5)
        else:  # ad, notice
            inside = rng.choice((prose(2, 25), f"<p>{prose(3, 30)}</p>", f'<p>{prose(3, 20)} <a href="#">{prose(1, 3)}</a></p>', f"<b>{prose(1, 4)}</b> {prose(3, 20)}"))
        return f"<{tag}{label}>{inside}</{tag}>"

    for _ in range(n):
        noise = rng.choice((0.0, 0.0, 0.1, 0.9))
        kept: list[str] = []

        def content(text: str) -> str:
            kept.append(text)
            return text

        parts = [f"<h1>{content(prose(2, 14))}</h1>"] if rng.random() < 0.8 else []
        brief = rng.random() < 0.3
        for _ in range(rng.choice((1, 1, 2)) if brief else rng.choice((1, 2, 4, 8, 15))):
            size = rng.choice(((1, 3), (3, 15)) if brief else ((1, 3), (3, 15), (15, 70), (60, 200)))
            form = rng.random()
            if form < 0.55:
                parts.append(f"<p>{content(prose(*size))}</p>")
            elif form < 0.65:
                parts.append(f"<p><b>{content(prose(*size))}<br>")  # left open, as some pages leave it
            elif form < 0.75:
                parts.append(f'<p>{content(prose(*size))} <a href="/{word()}">{content(prose(1, 4))}</a> {content(prose(2, 30))}</p>')
            elif form < 0.8:
                parts.append(f"<h2>{content(prose(1, 8))}</h2>")
            elif form < 0.86:
                parts.append("<ul>" + "".join(f"<li>{content(prose(2, 25))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
            elif form < 0.9:
                parts.append(f"<blockquote><p>{content(prose(5, 40))}</p></blockquote>")
            elif form < 0.93:
                parts.append("<table>" + "".join(f"<tr><td>{content(prose(1, 4))}</td><td>{content(prose(1, 9))}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            else:
                parts.append(boiler(rng.choice(("ad", "share", "more", "notice"))))
        if rng.random() < 0.15:
            parts.append(boiler("comment"))
        if parts and rng.random() < 0.15:  # sections of the article
            cuts = sorted(rng.sample(range(1, len(parts)), min(len(parts) - 1, rng.randint(1, 3))))
            parts = [f"<{(t := rng.choice(('section', 'section', 'div')))}>{''.join(parts[a:b])}</{t}>" for a, b in zip([0, *cuts], [*cuts, len(parts)])]
        elif parts[0].startswith("<h1>") and rng.random() < 0.2:
            parts[0] = f"<header>{parts[0]}</header>"
        tag = rng.choice(("article", "article", "article", "main", "div", "section"))
        label = name("content")
        while not label and tag in ("div", "section"):
            label = name("content")
        middle = f"<{tag}{label}>{''.join(parts)}</{tag}>"
        if rng.random() < 0.3:
            middle = f"<{rng.choice(('main', 'div'))}{name('content')}>{middle}</div>"
        before = [boiler(k) for k, chance in (("header", 0.5), ("nav", 0.7), ("ad", 0.5), ("notice", 0.3), ("form", 0.2), ("side", 0.2)) if rng.random() < chance]
        after = [boiler(k) for k, chance in (("comment", 0.35), ("more", 0.3), ("side", 0.3), ("ad", 0.3), ("share", 0.2), ("notice", 0.2), ("footer", 0.8)) if rng.random() < chance]
        head = f'<!DOCTYPE html><html><head><title>{prose(2, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>' if rng.random() < 0.8 else ""
        yield f"{head}<body>{''.join(before)}{middle}{''.join(after)}" + ("</body></html>" if rng.random() < 0.8 else ""), kept


def labelled_tree(page: str, kept: list[str]) -> tuple[Tree, np.ndarray]:
    """Labels of the nodes of a page: texts of its content, in order, its body, and elements that are mostly content."""
    tree = parse(page)
    labels = np.zeros(len(tree.parent), dtype=np.int64)
    wanted = iter(kept)
    following = next(wanted, None)
    good, total = np.zeros(len(labels)), np.zeros(len(labels))
    for k, text in enumerate(tree.text):
        clean = " ".join(text.split())
        if clean:
            total[k] = len(clean)
            if following is not None and clean == " ".join(html.unescape(following).split()):
                labels[k], good[k] = 1, len(clean)
                following = next(wanted, None)
    for k in range(len(labels) - 1, 0, -1):
        good[tree.parent[k]] += good[k]
        total[tree.parent[k]] += total[k]
    body = np.array(tree.tag) == TAGS.index("body")  # whatever else the page holds
    return tree, np.where(body | ((total > 0) & (good > 0.5 * total)), 1, labels)


PAGES, SEED = 300, 29
#: Pages, and bytes of them, whose trees are held at a time.
ROWS, BYTES = 100, 1 << 22


@functools.lru_cache(maxsize=2)
def default_model(pages: int = PAGES, seed: int = SEED) -> TreeModel:
    return fit([labelled_tree(*page) for page in labelled_pages(pages, seed)])


# -- extraction


def extract(pages: list[str], model: TreeModel) -> list[list[str]]:
    """Blocks of main text, page by page."""
    trees = [parse(page) for page in pages]
    content = model.content(forest(trees)) if trees else np.zeros(0)
    out, at = [], 0
    for tree in trees:
        blocks: list[list[str]] = []
        chosen = content[at : at + len(tree.parent)] >= 0.5
        begins = True
        for text, breaks, good in zip(tree.text, tree.breaks, chosen):
            begins |= breaks
            if text and (good or text.isspace()):
                if begins or not blocks:
                    blocks.append([])
                blocks[-1].append(text)
                begins = False
        out.append([clean for block in blocks if (clean := " ".join("".join(block).split()))])
        at += len(tree.parent)
    return out


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of at most ROWS pages and, unless one page is longer, BYTES of them."""
    sizes = [len(page) if page is not None else 0 for page in batch.column(2).cast(pa.binary()).to_pylist()]
    first = size = 0
    for k, more in enumerate(sizes):
        if k > first and (k - first == ROWS or size + more > BYTES):
            yield batch.slice(first, k - first)
            first, size = k, 0
        size += more
    if len(sizes):
        yield batch.slice(first)


def main_text(pages: DataFrame, model: TreeModel | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars, n_blocks.

    The whole page is read, in time and memory that grow with its length alone, however broken it is. Null and
    empty pages, and pages without main text, give an empty text. Ids and addresses may be null or repeat; each
    row gives one. An empty table gives an empty table. Other columns of ``pages`` are not read, so their names
    cannot clash. Rows are independent: nothing is shuffled; the model has some hundred numbers.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch):
                blocks = extract([page or "" for page in some.column(2).to_pylist()], shared.value)
                texts = [" ".join(b) for b in blocks]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, blocks), pa.int64())], names=["page_id", "url", "text", "n_chars", "n_blocks"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(of_partition, "page_id long, url string, text string, n_chars long, n_blocks long")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
