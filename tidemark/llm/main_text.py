"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

Every element of a page that isn't inline is a node with features: its tag,
the words of its class, id and role (hashed to ``BUCKETS`` columns, so that
what they tell is learned), depth, place among its siblings, amounts and
densities of text, links and tags in its subtree, and its ancestors' kinds.
Boosted trees give each node the odds of being on the way to or inside the
main text. Decoding picks the labels of highest total likelihood under which
no node is main text below one that isn't, from the leaves up.

The pages come without labels, so the trees are trained on pages made here by
a seeded generator (``TRAINING_PAGES`` of them): articles between menus,
headers, adverts, notices, forms, comments and footers in varying mark-up and
under usual, other or no names. Tasks get the trained trees, a few thousand
numbers, by closure. A page is read once from front to end, in time
proportional to its length however it is nested or broken.

Defined results: null and empty pages and pages without main text give an
empty text; unclosed and stray tags are taken as browsers do; scripts, styles
and comments never count.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

TRAINING_PAGES, TREES, DEPTH, RATE, BINS, SEED = 400, 60, 3, 0.25, 16, 3
BUCKETS = 96
#: Nodes that are scored together, if no single page has more.
NODES = 8192

#: A tag from behind its name on; a quote counts behind an equals sign only.
REST = re.compile(r"((?:[^>=\"']++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?|[\"'])*+)>")
NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
WORDS = re.compile(r"[a-z]+")
#: Fixed values of the mark-up language.
RAW = {"script", "style", "textarea", "title"}
#: Elements whose text is ignored.
QUIET = {"noscript", "template", "iframe", "svg", "head"}
#: What a head can hold; any other element, and text, ends it.
HEAD = {"base", "link", "meta", "noscript", "script", "style", "template", "title"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"a", "b", "i", "u", "em", "strong", "span", "small", "sub", "sup", "code", "kbd", "abbr", "cite", "q", "mark", "font", "time", "label", "s", "del", "ins", "tt", "var", "samp", "big", "bdi", "bdo", "data", "dfn"}
KINDS = {"nav": 1, "menu": 1, "header": 2, "footer": 3, "aside": 4, "form": 5, "button": 5, "select": 5, "article": 6, "main": 6, "section": 7, "div": 8, "p": 9, "blockquote": 9, "pre": 9, "h1": 10, "h2": 10, "h3": 10, "h4": 10, "h5": 10, "h6": 10, "ul": 11, "ol": 11, "dl": 11, "li": 12, "dt": 12, "dd": 12, "table": 13, "tr": 13, "td": 13, "th": 13, "figure": 14, "body": 15, "html": 15}
#: An open element of the first kind ends where one of the second begins.
CLOSES = {"p": {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "aside", "nav", "header", "footer", "form", "blockquote", "pre", "figure", "main"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
CLOSED_BY = {tag: [name for name, ends in CLOSES.items() if tag in ends] for tag in set().union(*CLOSES.values())}
#: Elements that end a drawing, and those in which they don't.
BREAKS = {"b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5", "h6", "head", "hr", "i", "img", "li", "menu", "meta", "nobr", "ol", "p", "pre", "s", "small", "span", "strong", "strike", "sub", "sup", "table", "tt", "u", "ul", "var", "article", "aside", "footer", "header", "main", "nav", "section"}
HOSTS = {"foreignobject", "desc"}


class Node:
    __slots__ = ("children", "depth", "kids", "links", "order", "parent", "tag", "tags", "text", "words")

    def __init__(self, tag: str, parent: "Node | None", attributes: str):
        self.tag, self.parent, self.depth = tag, parent, parent.depth + 1 if parent else 0
        self.words = set(WORDS.findall(" ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)).lower())) if attributes else set()
        self.children: list = []  # nodes, and texts of which a None ends the block
        self.kids: list[Node] = []
        self.order = self.links = self.tags = 0
        self.text = 0


class _Open:
    """The open elements, innermost last, with counts of their names."""

    def __init__(self, root: Node):
        self.stack, self.blocks, self.count, self.links = [("html", root)], [0], Counter(), 0

    def push(self, tag: str, node: Node) -> None:
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))
        self.count[tag] += 1
        self.links += tag == "a"

    def cut(self, k: int) -> bool:
        """Close all from place ``k`` on; whether one of them was a block."""
        block = False
        while len(self.stack) > k:
            tag, _ = self.stack.pop()
            self.count[tag] -= 1
            self.links -= tag == "a"
            if tag not in INLINE:
                self.blocks.pop()
                block = True
        return block

    def find(self, tag: str) -> int:
        """The place of the innermost open ``tag``, 0 if there is none."""
        if not self.count[tag]:
            return 0
        k = len(self.stack) - 1
        while self.stack[k][0] != tag:
            k -= 1
        return k


def _pieces(page: str) -> Iterator[tuple[str, bool, str, str, int]]:
    """The text before each tag, whether that is an end tag, its name (empty: none), attributes and end."""
    at, size = 0, len(page)
    while at < size:
        begin = at
        mark = page.find("<", at)
        while mark >= 0 and not (page[mark + 1 : mark + 2] in ("!", "?") or NAME.match(page, mark + 1 + (page[mark + 1 : mark + 2] == "/"))):
            mark = page.find("<", mark + 1)
        if mark < 0:
            yield page[begin:], False, "", "", size
            return
        text = page[begin:mark]
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = end + 3 if end >= 0 else size
            yield text, False, "", "", at
        elif page[mark + 1] in "!?":
            end = page.find(">", mark)
            at = end + 1 if end >= 0 else size
            yield text, False, "", "", at
        else:
            closing = page[mark + 1] == "/"
            name = NAME.match(page, mark + 1 + closing)
            rest = REST.match(page, name.end())
            # A tag that never ends takes the rest of the page.
            at = rest.end() if rest else size
            moved = yield text, closing, name[0].lower() if rest else "", rest[1] if rest else "", at
            at = moved or at


def parse(page: str) -> list[Node]:
    """The nodes of a page, parents first."""
    root = Node("html", None, "")
    # ``quiet``: the place on the stack of the outermost open element of QUIET.
    nodes, open_, quiet = [root], _Open(root), 0
    stack = open_.stack
    pieces, moved = _pieces(page), None
    while True:
        try:
            piece, closing, tag, attributes, at = pieces.send(moved)
        except StopIteration:
            return nodes
        moved = None
        if quiet and len(stack) == quiet + 1 and stack[quiet][0] == "head" and piece.strip():
            open_.cut(quiet)
            quiet = 0
        if piece and not quiet:
            node = stack[-1][1]
            own = entities.unescape(piece)
            node.children.append(own)
            size = len(own.strip())
            node.text += size
            node.links += size if open_.links else 0
        if not tag:
            continue
        if closing:
            k = open_.find(tag)
            if quiet and k >= quiet:
                open_.cut(k)
                quiet = quiet if k > quiet else 0
            elif k:
                quiet = 0
                if open_.cut(k):
                    stack[-1][1].children.append(None)
            continue
        if quiet:
            opened = stack[quiet][0]
            ends = tag == "body" or tag not in HEAD and len(stack) == quiet + 1 if opened == "head" else opened == "svg" and tag in BREAKS and not any(open_.count[t] for t in HOSTS)
            if ends:
                open_.cut(quiet)
                quiet = 0
        if tag in RAW and not (quiet and attributes.endswith("/")):
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            moved = close.end() if close else len(page)
            continue
        node = stack[-1][1]
        if quiet or tag in QUIET:
            if tag in VOID or attributes.endswith("/") or tag == "head" and (root.kids or root.text):
                continue
            quiet = quiet or len(stack)
            open_.push(tag, node)
            continue
        node.tags += 1
        if tag in VOID:
            node.children.append(None)
            continue
        if any(open_.count[name] for name in CLOSED_BY.get(tag, ())):
            for k in reversed(open_.blocks):
                if k and tag in CLOSES.get(stack[k][0], ()):
                    open_.cut(k)
                    break
                if stack[k][0] not in CLOSES:
                    break
        parent = stack[-1][1]
        if tag in INLINE:
            open_.push(tag, parent)
        elif tag in ("html", "body") and parent is root and not parent.kids:
            continue
        else:
            child = Node(tag, parent, attributes)
            child.order = len(parent.kids)
            parent.kids.append(child)
            parent.children.append(child)
            nodes.append(child)
            open_.push(tag, child)


def features(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """For each node its words as marks in ``BUCKETS`` columns of a byte, and its numbers."""
    n = len(nodes)
    index = {id(x): k for k, x in enumerate(nodes)}
    parents = [index[id(x.parent)] if x.parent else 0 for x in nodes]
    kinds = [KINDS.get(x.tag, 0) for x in nodes]
    words = np.zeros((n, BUCKETS), np.uint8)
    for k, x in enumerate(nodes):
        for word in x.words:
            words[k, crc32(word.encode()) % BUCKETS] = 1
    sums = [[x.text for x in nodes], [x.links for x in nodes], [x.tags for x in nodes], [x.tag == "p" for x in nodes], [1] * n]
    before = np.zeros(n)
    before[1:] = np.cumsum(sums[0])[:-1]
    for values in sums:
        for k in range(n - 1, 0, -1):
            values[parents[k]] += values[k]
    up_bad, up_good = [0] * n, [0] * n
    for k in range(1, n):
        p = parents[k]
        up_bad[k], up_good[k] = up_bad[p] + (0 < kinds[p] < 6), up_good[p] + (kinds[p] == 6)
    text, links, tags, paragraphs, count = (np.array(values, dtype=float) for values in sums)
    siblings = np.array([len(x.parent.kids) if x.parent else 1 for x in nodes], dtype=float)
    order = np.array([x.order for x in nodes], dtype=float)
    kind = np.array(kinds, dtype=float)
    whole = max(text[0], 1)
    return words, np.column_stack([
        kind, up_bad, up_good, np.array([x.depth for x in nodes]), np.log1p(text), links / np.maximum(text, 1), tags / np.maximum(text, 1),
        text / whole, np.log1p(count), paragraphs, siblings, order / np.maximum(siblings - 1, 1), before / whole, kind[parents], text / np.maximum(text[parents], 1), text / count,
    ])


def _made(rng: random.Random) -> tuple[str, str]:
    """A page and a mark for its main text: words of the article begin with ``z``."""

    def prose(n: int, first: str) -> str:
        return " ".join(first + "".join(rng.choices("aeinorst", k=rng.randint(1, 9))) for _ in range(n)) + rng.choice((".", ".", ""))

    def other() -> str:
        """A name that tells nothing."""
        return "".join(rng.choices("bcdfghklp", k=rng.randint(2, 6)))

    def named(tag: str, names: list[str], body: str) -> str:
        style = rng.random()
        name = rng.choice(names) if rng.random() < 0.8 else other()
        return f'<{tag} class="{name}">{body}</{tag}>' if style < 0.6 else f'<{tag} id="{name}">{body}</{tag}>' if style < 0.8 else f"<{tag}>{body}</{tag}>"

    def list_of_links() -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{prose(rng.randint(1, 3), "m")}</a></li>' for _ in range(rng.randint(2, 9))) + "</ul>"

    def junk() -> str:
        kind = rng.randrange(8)
        long = prose(rng.randint(2, 60), "m")
        if kind == 0:
            return named(rng.choice(("nav", "div")), ["nav", "menu", "breadcrumb"], list_of_links()) if rng.random() < 0.9 else f"<nav>{list_of_links()}</nav>"
        if kind in (1, 2):
            return f'<div class="{rng.choice(("ad", "ads", "advert", "advertisement", "banner", "promo", "sponsor", "sponsored"))}">{long}</div>'
        if kind == 3:
            return f'<{(t := rng.choice(("div", "section")))} class="{rng.choice(("comments", "comment", "reply", "discussion", "responses"))}">' + "".join(f"<p>{prose(rng.randint(3, 40), 'm')}</p>" for _ in range(rng.randint(1, 5))) + f"</{t}>"
        if kind == 4:
            return f'<aside>{list_of_links() if rng.random() < 0.5 else f"<p>{long}</p>"}</aside>' if rng.random() < 0.6 else f'<div class="sidebar">{long}{list_of_links()}</div>'
        if kind == 5:
            return f'<form action="/s"><label>{prose(2, "m")}</label><input name="q"><button>{prose(1, "m")}</button></form>'
        if kind == 6:
            return f'<div class="{rng.choice(("cookie", "cookies", "consent", "notice", "alert", "newsletter", "subscribe", "popup", "modal"))}"><p>{long}</p></div>'
        return f'<div class="{rng.choice(("share", "social", "related", "widget", "toolbar", "pagination", "login"))}">{list_of_links()}</div>'

    body = []
    for k in range(rng.choice((1, 1, 2, 4, 8, 14))):
        block = rng.random()
        own = prose(rng.choice((1, 2, 8, 30, 90)), "z")
        if block < 0.72:
            body.append(f"<p>{own}</p>" if rng.random() < 0.8 else f"<p><b>{own}<br>")
        elif block < 0.82:
            body.append(f"<h2>{prose(rng.randint(1, 7), 'z')}</h2>")
        elif block < 0.9:
            body.append("<ul>" + "".join(f"<li>{prose(rng.randint(1, 12), 'z')}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
        elif block < 0.95:
            body.append(f"<blockquote>{own}</blockquote>")
        else:
            body.append(f"<table><tr><td>{prose(3, 'z')}</td><td>{prose(2, 'z')}</td></tr></table>")
        if rng.random() < 0.12:
            body.append(junk())
    title = f"<h1>{prose(rng.randint(1, 12), 'z')}</h1>"
    inside = (title if rng.random() < 0.85 else "") + "".join(body)
    style = rng.random()
    main = f"<article>{inside}</article>" if style < 0.5 else f"<main>{inside}</main>" if style < 0.65 else named("div", ["content", "post", "entry", "story", "main-text", "article-body"], inside)
    if rng.random() < 0.3:
        main = named("div", ["wrapper", "container", "page", "row"], "".join(junk() for _ in range(rng.randint(0, 2))) + main + "".join(junk() for _ in range(rng.randint(0, 2))))
    head = "".join(junk() for _ in range(rng.randint(0, 3)))
    if rng.random() < 0.8:
        head = rng.choice((f"<header><p>{prose(3, 'm')}</p>{list_of_links()}</header>", f"<nav>{list_of_links()}</nav>", f'<div class="header">{prose(4, "m")}</div>')) + head
    tail = "".join(junk() for _ in range(rng.randint(0, 3)))
    if rng.random() < 0.8:
        tail += rng.choice((f"<footer>{prose(rng.randint(2, 20), 'm')}</footer>", f'<div class="footer"><p>{prose(9, "m")}</p></div>'))
    return f"<!DOCTYPE html><html><body>{head}{main}{tail}</body></html>", "z"


def _training() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = random.Random(SEED)
    rows, labels = [], []
    for _ in range(TRAINING_PAGES):
        page, mark = _made(rng)
        nodes = parse(page)
        own = {id(x): any(isinstance(c, str) and c.strip().startswith(mark) for c in x.children) for x in nodes}
        for x in reversed(nodes):
            if x.parent is not None and own[id(x)]:
                own[id(x.parent)] = True
        rows.append(features(nodes))
        labels += [own[id(x)] for x in nodes]
    words, numbers = (np.vstack(part) for part in zip(*rows))
    return words, numbers, np.array(labels, dtype=float)


def _binned(words: np.ndarray, numbers: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Columns of a byte: words as they are, numbers by their bin."""
    out = np.empty((len(words), BUCKETS + len(edges)), np.uint8)
    out[:, :BUCKETS] = words
    for f, e in enumerate(edges):
        out[:, BUCKETS + f] = np.searchsorted(e, numbers[:, f], side="right")
    return out


def _grow(binned: np.ndarray, gradient: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """A tree whose nodes of one depth are split in turn: (feature, bin) by heap place, then leaf values."""
    n, width = binned.shape
    words = binned[:, :BUCKETS].astype(float)
    place, splits = np.zeros(n, dtype=np.int64), []
    for level in range(DEPTH):
        for leaf in range(1 << level):
            here = place == (1 << level) - 1 + leaf
            best, chosen = 1e-9, (0, BINS)
            if here.any():
                g, w = gradient[here], weight[here]
                whole = g.sum() ** 2 / (w.sum() + 1)
                # A word is there or not: one split, and all words' sums at once.
                right_g, right_w = (gradient * here) @ words, (weight * here) @ words
                gains = (g.sum() - right_g) ** 2 / (w.sum() - right_w + 1) + right_g**2 / (right_w + 1) - whole
                best, chosen = max((best, chosen), (float(gains.max()), (int(np.argmax(gains)), 0)))
                for f in range(BUCKETS, width):
                    gs = np.cumsum(np.bincount(binned[here, f], g, BINS + 1))
                    ws = np.cumsum(np.bincount(binned[here, f], w, BINS + 1))
                    gain = gs**2 / (ws + 1) + (gs[-1] - gs) ** 2 / (ws[-1] - ws + 1) - whole
                    k = int(np.argmax(gain[:-1]))
                    if gain[k] > best:
                        best, chosen = gain[k], (f, k)
            splits.append(chosen)
            right = binned[:, chosen[0]] > chosen[1]
            place = np.where(here, 2 * place + 1 + right, place)
    return splits, place - ((1 << DEPTH) - 1)


@lru_cache(maxsize=1)
def trained() -> tuple:
    """Bin edges, a base and the trees."""
    words, numbers, y = _training()
    edges = [np.unique(np.quantile(numbers[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(numbers.shape[1])]
    binned = _binned(words, numbers, edges)
    base = math.log(y.mean() / (1 - y.mean()))
    score, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        splits, leaf = _grow(binned, y - p, p * (1 - p))
        values = RATE * np.bincount(leaf, y - p, 1 << DEPTH) / (np.bincount(leaf, p * (1 - p), 1 << DEPTH) + 1)
        score += values[leaf]
        trees.append((splits, values))
    return edges, base, trees


def odds(words: np.ndarray, numbers: np.ndarray, model: tuple) -> np.ndarray:
    edges, base, trees = model
    binned = _binned(words, numbers, edges)
    rows, total = np.arange(len(binned)), np.full(len(binned), base)
    for splits, values in trees:
        place = np.zeros(len(binned), dtype=np.int64)
        split_f, split_k = np.array([s[0] for s in splits]), np.array([s[1] for s in splits])
        for _ in range(DEPTH):
            place = 2 * place + 1 + (binned[rows, split_f[place]] > split_k[place])
        total += values[place - ((1 << DEPTH) - 1)]
    return total


def decode(nodes: list[Node], score: np.ndarray) -> set[int]:
    """Ids of the nodes that are main text: the best labels with no main text below other text."""
    gain = {}
    for node, s in zip(reversed(nodes), score[::-1]):
        gain[id(node)] = s + sum(max(0.0, gain[id(k)]) for k in node.kids)
    kept = set()
    for node in nodes:
        if gain[id(node)] > 0 and (node.parent is None or id(node.parent) in kept):
            kept.add(id(node))
    return kept


def _text(nodes: list[Node], kept: set[int]) -> str:
    parts, stack = [], [nodes[0]] if id(nodes[0]) in kept else []
    while stack:
        node = stack.pop()
        if isinstance(node, Node):
            parts.append(" ")
            if id(node) in kept:
                stack.append(None)
                stack.extend(reversed(node.children))
        else:
            parts.append(" " if node is None else node)
    return " ".join("".join(parts).split())


def main_texts(pages: Iterable[str | None], model: tuple) -> Iterator[str]:
    """The main text of each page; pages are scored together until they hold ``NODES`` nodes."""
    held, count = [], 0
    for page in pages:
        nodes = parse(page or "")
        held.append((nodes, *features(nodes)))
        count += len(nodes)
        if count >= NODES:
            yield from _scored(held, model)
            held, count = [], 0
    yield from _scored(held, model)


def _scored(held: list[tuple], model: tuple) -> Iterator[str]:
    if not held:
        return
    score, at = odds(np.vstack([h[1] for h in held]), np.vstack([h[2] for h in held]), model), 0
    for nodes, *_ in held:
        yield _text(nodes, decode(nodes, score[at : at + len(nodes)]))
        at += len(nodes)


def extract(df: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """Replace ``html`` by the main ``text`` of each page and add its length in code points, ``n_chars``."""
    model = trained()
    rest = df.select(*[c for c in df.columns if c not in (name, "n_chars", html)], html)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = list(main_texts((page.as_py() for page in batch.column(batch.num_columns - 1)), model))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[:-1], name, "n_chars"])

    schema = T.StructType([*rest.schema.fields[:-1], T.StructField(name, T.StringType()), T.StructField("n_chars", T.LongType())])
    return rest.mapInArrow(told, schema)
