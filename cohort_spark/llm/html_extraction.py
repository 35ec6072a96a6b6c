"""Main text of web pages by boosted trees over the nodes of the document tree.

Each page is parsed into a tree (missing end tags are closed as browsers do for paragraphs, list items and the like).
A node is described by its tag, hashed tokens of its class, id and role, depth, position among its siblings and their
likeness, and by its subtree: text, links, punctuation and nodes, absolute and as densities. Tokens are hashed into
BUCKETS; what a bucket tells is learned with the trees, as the smoothed log-odds of the sampled nodes that carry it (without
the node itself), and a node sees its own and those of the elements around it. Gradient-boosted trees give each node the
log-odds that its text is main text. Decoding is hierarchical: along every path from the root the states outside, main and
excluded may only follow one another in this order, and the assignment with the best total, weighted by text, is found
over the whole tree. So nothing inside an excluded node is main, and an article's own notices and comments can still be
cut out.

Training needs no labelled pages. A bounded sample of SAMPLE pages (those of least hash that have an article or main element)
is labelled by structure alone: what is inside such an element is main, but for sectioning elements of another kind in
it. Each sampled page is also taken with its article cut to one paragraph, and several times (MADE_UP in all) with a
block put in that doesn't belong to it, and every second article renamed to a neutral element under a made-up class;
there the label is known because the page was made so, whatever the tokens say. NODES of their nodes are taken at most.
For a quarter of the pages tags and tokens are hidden, so that the trees learn shape as well.

Text: character references decoded; the text of a block (paragraph, heading, item, cell, ...) is joined, white space runs
become one space, ends are trimmed; blocks are joined by an empty line in page order.

Defined results: null and empty pages give an empty text; text without mark-up is one block; repeated rows give repeated
results; an empty table gives no row; ``extract`` replaces a column of the name that it is given and keeps all others. Very
long pages are parsed whole. An element whose text doesn't show (a frame, a drawing, a text field) and that never ends is
taken to end where it begins; an open script or style goes on to the end of the page, as in browsers.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, read

SAMPLE = 400
#: Made-up pages, dealt over the sampled ones.
MADE_UP = 1000
#: Nodes of sampled pages that the trees are fitted on at most, and buckets of attribute tokens.
NODES, BUCKETS = 40_000, 4096
TREES, DEPTH, SHRINK, LEAST = 60, 4, 0.3, 10

#: Fixed: what HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("head iframe noscript object script style svg template textarea title".split())
#: What a head may hold; any other tag, or text, ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NO_PARAGRAPH = BLOCKS - {"body", "html", "option", "legend", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "summary", "figcaption"}
TAGS = ("article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "td", "blockquote", "pre", "figure", "a", "b", "span", "body", "nav", "aside", "header", "footer", "form", "button")
#: Names that made-up training pages give to containers of an article, and to blocks that don't belong to it.
GOOD = frozenset("article body content entry main post story text".split())
BAD = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login menu nav navbar navigation newsletter notice pagination popup promo related reply replies share sharing sidebar social sponsor sponsored subscribe tags toolbar widget".split())
MAIN_TAGS, OTHER_TAGS = frozenset({"article", "main"}), frozenset({"nav", "aside", "header", "footer", "form", "button", "menu", "dialog", "select"})

#: An attribute that only made-up training pages have: "in" for an article's container, "out" for a block put in.
MADE = "data-made-up"

_tokens = re.compile(r"[a-z]+").findall
_space = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "words", "parent", "depth", "index", "children", "text", "made")

    def __init__(self, tag: str, words: frozenset[str], parent: "Node | None", made: str | None = None):
        self.tag, self.words, self.parent, self.made = tag, words, parent, made
        self.depth = parent.depth + 1 if parent else 0
        self.index, self.children, self.text = 0, [], []


class Tree(HTMLParser):
    """The tree of a page: ``nodes`` in page order, and ``parts``, its texts with their nodes and block numbers."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", frozenset(), None)
        self.nodes, self.parts, self.block, self.silent = [self.root], [], 0, []
        low = html.lower()
        self.ends = {t: low.count("</" + t) for t in SILENT if "<" + t in low}  # end tags still to come
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "body" and self.silent[-2:] == ["head", "noscript"]:
            self.silent.pop()
        if self.silent and self.silent[-1] == "head" and tag not in HEAD:
            self.silent.pop()
        if tag in SILENT and (tag in ("head", "script", "style") or self.ends.get(tag, 0) > 0):
            self.silent.append(tag)
        elif tag in SILENT:
            return
        if self.silent:
            return
        if tag == "html":
            return
        if tag in BLOCKS:
            self.block += 1
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            return
        if tag in NO_PARAGRAPH:
            self._leave({"p"}, BLOCKS - {"p"})
        if tag in CLOSES:
            closed, fence = CLOSES[tag]
            while self._leave(closed, fence):
                pass
        words = frozenset(w for k, v in attrs if k in ("class", "id", "role", "itemprop", "aria-label") and v for w in _tokens(v.lower()))
        node = Node(tag, words, self.at, dict(attrs).get(MADE))
        node.index = len(self.nodes)
        self.at.children.append(node)
        self.nodes.append(node)
        self.at = node

    def _leave(self, tags, fence) -> bool:
        """Close the innermost open element of ``tags``, unless one of ``fence`` is in between."""
        x = self.at
        while x is not self.root and x.tag not in tags:
            if x.tag in fence:
                return False
            x = x.parent
        if x is self.root:
            return False
        self.at = x.parent
        return True

    def set_cdata_mode(self, elem, **options):
        if elem in ("script", "style") or self.ends.get(elem, 0) > 0:
            super().set_cdata_mode(elem, **options)

    def handle_endtag(self, tag):
        if tag in self.ends:
            self.ends[tag] -= 1
        if self.silent:
            if tag in self.silent:
                while self.silent.pop() != tag:
                    pass
            elif tag in ("head", "body"):
                self.silent.clear()
            return
        if tag in BLOCKS:
            self.block += 1
        x = self.at
        while x is not self.root and x.tag != tag:
            x = x.parent
        if x is not self.root:
            self.at = x.parent

    def handle_startendtag(self, tag, attrs):
        drawn, deep = tag == "svg" or "svg" in self.silent, len(self.silent)  # only there "/>" closes what HTML leaves open
        self.handle_starttag(tag, attrs)
        if drawn:
            del self.silent[deep:]
            return
        if tag not in VOID and self.at.tag == tag and not self.silent:
            self.at = self.at.parent

    def handle_data(self, data):
        if self.silent and self.silent[-1] == "head" and data.strip(" \t\n\r\f"):
            self.silent.pop()
        if not self.silent:
            self.at.text.append(data)
            self.parts.append((self.at.index, self.block, data))


PLAIN = ["depth", "index", "siblings", "same_tag", "first", "last", "children", "nodes", "chars", "own_chars", "link_chars", "link_share", "chars_per_node", "commas", "stops", "stop_rate", "share_of_page", "before", "digits", "parent_chars"]
GIVEN_AWAY = [*(f"tag_{t}" for t in TAGS), "main_tags", "other_tags", "token_odds", "best_above", "worst_above", "odds_above"]


def bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def features(tree: Tree, odds: np.ndarray | None = None) -> np.ndarray:
    """A row for each node: PLAIN features, then GIVEN_AWAY ones; ``odds`` are those of the token buckets."""
    nodes = tree.nodes
    n = len(nodes)
    own, links, commas, stops, digits = (np.zeros(n) for _ in range(5))
    linked = [False] * n
    for k, x in enumerate(nodes):
        t = "".join(x.text)
        own[k] = len(t) - sum(map(t.count, " \n\t"))
        commas[k], stops[k] = t.count(","), t.count(".") + t.count("!") + t.count("?")
        digits[k] = sum(map(str.isdigit, t))
        linked[k] = x.tag == "a" or x.parent is not None and linked[x.parent.index]
        links[k] = own[k] if linked[k] else 0
    count, chars, below = np.ones(n), own.copy(), [a.copy() for a in (links, commas, stops)]
    for k in range(n - 1, 0, -1):
        p = nodes[k].parent.index
        count[p] += count[k]
        chars[p] += chars[k]
        for a in below:
            a[p] += a[k]
    total = max(chars[0], 1)
    before = np.cumsum(own) - own
    out = np.zeros((n, len(PLAIN) + len(GIVEN_AWAY)))
    place = np.zeros(n)
    tags = [Counter(c.tag for c in x.children) for x in nodes]
    for x in nodes:
        for k, c in enumerate(x.children):
            place[c.index] = k
    main, other = np.zeros(n), np.zeros(n)  # sectioning elements that the node is or is in
    for k, x in enumerate(nodes):
        p = x.parent
        main[k] = (x.tag in MAIN_TAGS) + (main[p.index] if p else 0)
        other[k] = (x.tag in OTHER_TAGS) + (other[p.index] if p else 0)
        same = tags[p.index][x.tag] if p else 1
        m = len(p.children) if p else 1
        out[k, : len(PLAIN)] = (x.depth, place[k], m, same / m, place[k] == 0, place[k] == m - 1, len(x.children), count[k], chars[k], own[k], below[0][k], below[0][k] / max(chars[k], 1), chars[k] / count[k], below[1][k], below[2][k], 100 * below[2][k] / max(chars[k], 1), chars[k] / total, before[k] / total, digits[k], chars[p.index] if p else total)
        if x.tag in TAGS:
            out[k, len(PLAIN) + TAGS.index(x.tag)] = 1
    out[:, -6], out[:, -5] = main, other
    if odds is not None:
        token_features(out[:, -4:], [0 if x.parent is None else x.parent.index for x in nodes], np.array([sum(odds[bucket(w)] for w in x.words) for x in nodes]))
    return out


def token_features(out: np.ndarray, parents: list[int], own: np.ndarray) -> None:
    """Fills own odds, and the best, the worst and the sum of those of the elements around, parents coming first."""
    out[:, 0] = own
    for k in range(1, len(parents)):
        p = parents[k]
        out[k, 1:] = max(out[p, 1], own[p]), min(out[p, 2], own[p]), out[p, 3] + own[p]


def by_structure(tree: Tree) -> np.ndarray:
    """1 for nodes inside an article or main element, or a made-up container, and in no sectioning element of another kind
    or made-up block in it; else 0."""
    state, out = {}, np.zeros(len(tree.nodes))
    for k, x in enumerate(tree.nodes):
        s = state[x.parent.index] if x.parent else "outside"
        if x.made == "out" or x.tag in OTHER_TAGS and (s == "main" and x.tag != "header" or s == "outside"):
            s = "excluded" if s == "main" or x.made == "out" or x.tag != "header" else s
        elif s == "outside" and (x.made == "in" or x.tag in MAIN_TAGS):
            s = "main"
        state[k] = s
        out[k] = s == "main"
    return out


class Trees:
    """Gradient-boosted regression trees for a yes-or-no target, with binned features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, shrink: float = SHRINK, bins: int = 32):
        self.count, self.depth, self.shrink, self.bins = trees, depth, shrink, bins
        self.base, self.trees, self.tokens = 0.0, [], None

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        cuts = np.linspace(0, 1, self.bins + 1)[1:-1]
        # Breaks at quantiles of the rows and of the distinct values, as most features are mostly 0.
        self.edges = [np.unique(np.r_[np.quantile(c, cuts), np.quantile(np.unique(c), cuts)]) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T)], axis=1)
        rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        f = np.full(len(y), self.base)
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-f))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            tree: list[tuple] = []
            self._grow(tree, binned, grad, hess, np.arange(len(y)), 0)
            self.trees.append(tree)
            f += self._walk(tree, x)
        return self

    def _grow(self, tree, binned, grad, hess, rows, level) -> int:
        here, g, h = len(tree), grad[rows].sum(), hess[rows].sum()
        tree.append((-1, 0.0, -1, -1, self.shrink * float(g / (h + 1))))
        if level == self.depth or len(rows) < 2 * LEAST:
            return here
        best = (1e-6, -1, -1)
        for c in range(binned.shape[1]):
            b, size = binned[rows, c], len(self.edges[c]) + 1
            if size == 1:
                continue
            gs, hs, ns = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (grad[rows], hess[rows], None))
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), c, k)
        if best[1] >= 0:
            _, c, k = best
            left = binned[rows, c] <= k
            value = tree[here][4]
            a = self._grow(tree, binned, grad, hess, rows[left], level + 1)
            b = self._grow(tree, binned, grad, hess, rows[~left], level + 1)
            tree[here] = (c, float(self.edges[c][k]), a, b, value)
        return here

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            c, edge, a, b, value = tree[at]
            if c < 0:
                out[rows] = value
            else:
                left = x[rows, c] <= edge
                todo += [(a, rows[left]), (b, rows[~left])]
        return out

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._walk(t, x) for t in self.trees), np.zeros(len(x)))


def decode(tree: Tree, odds: np.ndarray) -> np.ndarray:
    """Whether each node is main text, in the best assignment without contradictions.

    gain[k, s]: best total of the subtree of k if k's state is s (0 outside, 1 main, 2 excluded) or, for a
    child, any state from its parent's on. A node counts by its own text; nodes without any count a little.
    """
    n = len(tree.nodes)
    if n == 1:
        return np.ones(1, bool)  # text without mark-up
    weight = np.array([0.01 + len("".join(x.text).strip()) for x in tree.nodes])
    score = np.clip(odds, -6, 6) * weight
    gain = np.stack([-score, score, -score], axis=1)
    for k in range(n - 1, 0, -1):
        later = np.maximum.accumulate(gain[k][::-1])[::-1]  # best of the states from s on
        gain[tree.nodes[k].parent.index] += later
    state = np.zeros(n, int)
    for k, x in enumerate(tree.nodes):
        least = state[x.parent.index] if x.parent else 0
        state[k] = least + int(np.argmax(gain[k][least:]))
    return state == 1


def text_of(tree: Tree, main: np.ndarray) -> str:
    blocks, last = [], None
    for node, block, data in tree.parts:
        if main[node]:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(data)
    joined = (_space.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n\n".join(b for b in joined if b)


def shortened(html: str) -> str:
    """The page with the first paragraph as its whole article."""
    def first(m: re.Match) -> str:
        text = _space.sub(" ", re.sub(r"<[^>]*>", " ", m[2].partition("</p")[0])).strip()
        return f"{m[1]}<p>{text}</p>{m[3]}"

    return re.sub(r"(?s)(<(?:article|main)\b[^>]*>)(.*?)(</(?:article|main)\s*>)", first, html)


def varied(html: str, k: int) -> str:
    """The page with a block in its article that doesn't belong to it, at the end or start, and another container for every
    second article."""
    bad, good = sorted(BAD)[k % len(BAD)], sorted(GOOD - {"body"})[k % (len(GOOD) - 1)]
    said = _space.sub(" ", re.sub(r"<[^>]*>", " ", html))[-400 - 37 * (k % 9) :]
    tag = ("div", "section", "aside", "ul")[k % 4]
    block = f'<{tag} class="{bad}" {MADE}="out"><p>{said[: 40 + 60 * (k % 7)]}</p></{tag}>'
    before, after = (block, "") if k % 2 else ("", block)
    kept = k // 2 % 2  # half of the articles keep their element
    html = re.sub(r"<(article|main)\b[^>]*>", lambda m: (m[0] if kept else f'<div class="{good}" {MADE}="in">') + before, html)
    return re.sub(r"</(article|main)\s*>", lambda m: after + (m[0] if kept else "</div>"), html)


def token_odds(y: np.ndarray, buckets: list[list[int]], smooth: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(BUCKETS x 2 counts of nodes by label, log-odds of each bucket against the share of main nodes)."""
    seen = np.zeros((BUCKETS, 2))
    for label, own in zip(y, buckets):
        for b in own:
            seen[b, int(label)] += 1
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    return seen, np.log((seen[:, 1] + smooth * rate) / (seen[:, 0] + smooth * (1 - rate)) * (1 - rate) / rate)


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE, most: int = NODES) -> Trees:
    """Trees from the ``sample`` pages of least hash; tasks make pages' nodes into rows, of which those of least hash, ``most``
    at most, are fetched."""
    kind = "y double, page long, at long, hide boolean, x array<double>, own array<int>, above array<array<int>>"

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for h in batch[html]:
                k = zlib.crc32(h.encode("utf-8", "replace"))
                short = shortened(h)
                made = (varied(short if (k + j) % 4 == 0 else h, k // 7 + 11 * j) for j in range(each))
                for number, v in enumerate((h, short, *made)):
                    t = Tree(v)
                    y, own = by_structure(t), [[bucket(w) for w in x.words] for x in t.nodes]
                    above = []
                    for x in t.nodes:
                        above.append([] if x.parent is None else above[x.parent.index] + [own[x.parent.index]])
                    yield pd.DataFrame({"y": y, "page": k * 1024 + number, "at": np.arange(len(y)), "hide": np.full(len(y), (k + number) % 4 == 3), "x": list(features(t)),
                                        "own": own, "above": [[a for a in up if a] for up in above]})

    some = cut(pages.where(F.col(html).rlike(r"(?i)<(article|main)[\s>]")).select(html).orderBy(F.xxhash64(html), html).limit(sample))
    each = -(-MADE_UP // max(some.count(), 1))
    nodes = some.repartition(16).mapInPandas(rows, kind)
    got = nodes.orderBy(F.xxhash64("page", "at"), "page", "at").limit(most).toArrow()
    model = Trees()
    if not got.num_rows:
        model = Trees(0).fit(np.zeros((1, len(PLAIN) + len(GIVEN_AWAY))), np.zeros(1))
        model.tokens = np.zeros(BUCKETS)
        return model
    y, width = got["y"].to_numpy(), len(PLAIN) + len(GIVEN_AWAY)
    x = got["x"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, width).copy()
    own = got["own"].to_pylist()
    seen, odds = token_odds(y, own)
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    for r, (label, mine, above) in enumerate(zip(y, own, got["above"].to_pylist())):
        less = seen[mine].copy()
        less[:, int(label)] -= 1  # a node's own label doesn't count for what its tokens tell
        self_odds = np.log((less[:, 1] + 3 * rate) / (less[:, 0] + 3 * (1 - rate)) * (1 - rate) / rate).sum()
        up = [odds[a].sum() for a in above]
        x[r, -4:] = self_odds, max([0.0, *up]), min([0.0, *up]), sum(up)
    x[got["hide"].to_numpy(zero_copy_only=False), len(PLAIN) :] = 0
    model.fit(x, y)
    model.tokens = odds
    return model


def extract(pages: DataFrame, model: Trees, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html``."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        out = []
        trees = [Tree(h or "") for h in column]
        if not trees:
            return pd.Series([], dtype=object)
        rows = [features(t, model.tokens) for t in trees]
        odds = np.split(model.odds(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
        for t, o in zip(trees, odds):
            out.append(text_of(t, decode(t, o)))
        return pd.Series(out, dtype=object)

    return pages.withColumn(into, run(F.col(html)))


def query(spark, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
