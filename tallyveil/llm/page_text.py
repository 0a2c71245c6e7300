"""Main text of web pages by a tree-structured graphical model over the DOM.

Nodes are block elements and the runs of text in them; inline markup belongs to its run. Each node is one of OTHER (no
text below it belongs to the article), ARTICLE (all does) or MIXED. A potential ties every node to its parent, chosen by the
kind of node, and another ties the node to what is seen of it: tag, words of its class, id and role, length, share of
linked text, sentence marks. Messages pass from the leaves to the root and back (sum-product), which gives
the exact marginal of every node; runs of text that are ARTICLE with a probability over one half are the main text.

Training climbs the likelihood of labelled trees: the gradient of a potential is its observed count less its expected
count, which the same messages give. Labelled pages are fixed layouts with marked articles (``page_seeds``), and a bounded
sample of the corpus' own pages (``labelled_pages`` of them, by hash of the id) whose markup names its article: pages
with one ``article`` element, less the navigation, forms, asides and the like inside it.

All pages of a piece are one array of nodes; the messages of one depth are passed together.

Defined results: null and empty html give an empty text; a page without article text gives an empty text; broken markup is
read as browsers do in the common cases (unclosed paragraphs, stray end tags, raw script text); character references
are decoded, also without their semicolon where HTML allows it; repeated rows are extracted row by row; a null id is kept;
extra columns are left out.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.common import by_bytes, table
from tallyveil.llm.page_seeds import seed_pages

OTHER, ARTICLE, MIXED = 0, 1, 2
NAME = re.compile(r"/?([a-zA-Z][^\s/>]*+)")
TAG_STOP = re.compile("""[>"']""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-part)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup, up to their end tag or the page's end.
RAW = frozenset("script style textarea title iframe".split())
#: Subtrees without text of the page; nested ones are counted, and an open svg ends where an element begins that cannot be in one.
SKIPPED = frozenset("svg template".split())
#: Elements that end foreign content.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "math annotation maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: Elements nested deeper hang on the last of these levels, as in browsers; their text stays.
DEEPEST = 512
#: Elements that end where another of the group begins.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements inside a named article that are none of its text.
NEVER = frozenset("nav aside form footer button select dialog noscript".split())


class Tags:
    """Tags, comments and declarations of a page, one after the other, in time linear in the page's length."""

    def __init__(self, html: str):
        self.html, self.at, self.balanced = html, 0, True

    def _tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag, quoted ones left out; once a tag finds none that way, the first ``>`` counts."""
        html, pos = self.html, at
        while self.balanced:
            stop = TAG_STOP.search(html, pos)
            if stop and stop[0] == ">":
                return stop.start()
            pos = html.find(stop[0], stop.end()) + 1 if stop else 0
            self.balanced = pos > 0
        return html.find(">", at)

    def next(self) -> tuple[int, int, bool, str | None, str] | None:
        """(start, end, is an end tag, name, what follows the name) of the next one from ``at`` on; name is None for other markup."""
        html, at = self.html, self.at
        while True:
            start = html.find("<", at)
            if start < 0:
                return None
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), False, None, ""
            name = NAME.match(html, start + 1)
            if not name and html[start + 1 : start + 2] not in ("!", "?"):
                at = start + 1
                continue
            end = self._tag_end(name.end()) if name else html.find(">", start)
            if end < 0:  # no tag ends any more; what is left is text, or an open comment
                start = html.find("<!--", start)
                return (start, len(html), False, None, "") if start >= 0 else None
            return (start, end + 1, html[start + 1] == "/", name[1], html[name.end() : end]) if name else (start, end + 1, False, None, "")


def read_nodes(html: str) -> list[list]:
    """Nodes in page order: [parent, tag, words, label mark, text, linked characters]; text is None for elements."""
    nodes: list[list] = [[-1, "#root", (), None, None, 0]]
    stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and their nodes; inline elements share their block's
    opened: Counter = Counter()
    run: list[str] = []
    linked = links = 0
    skipped, within = "", 0
    tags = Tags(html)

    def end_run() -> None:
        nonlocal linked
        if run:
            text = " ".join(html_module.unescape("".join(run)).split())
            if text:
                nodes.append([stack[min(len(stack) - 1, DEEPEST)][1], "#text", (), None, text, linked])
            run.clear()
        linked = 0

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    while True:
        found = tags.next()
        if not skipped and (found[0] if found else len(html)) > tags.at:
            piece = html[tags.at : found[0] if found else None]
            run.append(piece)
            if links:
                linked += len(piece)
        if not found:
            break
        _, tags.at, close, name, rest = found
        if not name:
            continue
        if skipped:
            name = name.lower()
            if name == skipped:
                within += -1 if close else not rest.endswith("/")
                if not within:
                    skipped = ""
                continue
            if skipped == "template" or close or name not in BREAKS_OUT:
                continue
            skipped, within = "", 0
        name = name.lower()
        if close:
            if name == "a":
                links = max(0, links - 1)
            if name in INLINE:
                continue
            if opened[name] > 0:
                end_run()
                links = 0
                while pop() != name:
                    pass
            continue
        if name in RAW:
            ending = re.compile(f"</{name}", re.I).search(html, tags.at)
            end = html.find(">", ending.start()) if ending else -1
            tags.at = end + 1 if end >= 0 else len(html)
            continue
        if name in SKIPPED:
            if not rest.endswith("/"):
                skipped, within = name, 1
            continue
        if name in INLINE:
            if name == "br":
                run.append(" ")
            links += name == "a"
            continue
        end_run()
        links = 0
        if name in VOID:
            continue
        # A paragraph ends at the next block; list items, cells and the like at their next sibling.
        while stack[-1][0] == "p" or stack[-1][0] in SIBLINGS.get(name, ()):
            pop()
        words, mark = set(), None
        if rest:
            for a in ATTRIBUTE.finditer(rest):
                value = a[2] or a[3] or a[4] or ""
                if a[1].lower() == "data-part":
                    mark = value
                else:
                    words.update(w.lower() for w in PART.findall(value))
        nodes.append([stack[min(len(stack) - 1, DEEPEST)][1], name, tuple(sorted(words)), mark, None, 0])
        stack.append((name, len(nodes) - 1))
        opened[name] += 1
    end_run()
    return nodes


def features(nodes: list[list]) -> list[list[str]]:
    """What is seen of each node: markup, and length, linked share and sentence marks of all its text."""
    size, link, stops = [0] * len(nodes), [0] * len(nodes), [0] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        parent, _, _, _, text, linked = nodes[i]
        if text is not None:
            size[i], link[i] = len(text), min(linked, len(text))
            stops[i] = text.count(". ") + text.count(", ") + text.endswith((".", "!", "?", ":", "…"))
        if parent >= 0:
            size[parent] += size[i]
            link[parent] += link[i]
            stops[parent] += stops[i]
    out = []
    for (_, tag, words, _, _, _), n, l, s in zip(nodes, size, link, stops):
        kind = "t" if tag == "#text" else "e"
        seen = [f"tag {tag}", f"{kind} size {min(n, 4000).bit_length() // 2}", f"{kind} link {0 if not l else 1 + 4 * l // max(n, 1)}", f"{kind} stops {min(s, 4).bit_length()}"]
        out.append(seen + [f"word {w}" for w in words])
    return out


def marked_labels(nodes: list[list], named: bool = False) -> list[int] | None:
    """Labels from ``data-part`` marks, or, for ``named``, from the one article element; None without either."""
    inside = [False] * len(nodes)
    if named and sum(n[1] == "article" for n in nodes) != 1:
        return None
    for i, (parent, tag, _, mark, _, _) in enumerate(nodes):
        inside[i] = inside[parent] if parent >= 0 else False
        if named:
            inside[i] = (inside[i] or tag == "article") and tag not in NEVER
        elif mark:
            inside[i] = mark == "article"
    labels = [None] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        if nodes[i][4] is not None:
            labels[i] = ARTICLE if inside[i] else OTHER
        elif labels[i] is None:  # no text below
            labels[i] = ARTICLE if inside[i] else OTHER
        parent = nodes[i][0]
        if parent >= 0:
            labels[parent] = labels[i] if labels[parent] in (None, labels[i]) else MIXED
    return labels


def kind_of(tag: str) -> str:
    """Nodes of one kind share their parent potential."""
    return tag if tag in ("#text", "div", "section", "p", "li", "ul") else "heading" if re.fullmatch(r"h[1-6]", tag) else "block"


class Forest:
    """Many trees as one set of arrays."""

    def __init__(self, trees: list[list[list]], index: dict[str, int], kinds: dict[str, int]):
        parents, depth, unary, own = [], [], [], []
        none = len(index)
        for nodes in trees:
            base = len(parents)
            for node, seen in zip(nodes, features(nodes)):
                root = node[0] < 0
                parents.append(-1 if root else base + node[0])
                depth.append(0 if root else depth[base + node[0]] + 1)
                unary.append([index.get(f, none) for f in seen])
                own.append(kinds.get(kind_of(node[1]), kinds["block"]))
        self.parent, self.kind = np.array(parents), np.array(own)
        self.seen = np.array([f for u in unary for f in u])
        self.owner = np.repeat(np.arange(len(unary)), [len(u) for u in unary])
        self.starts = np.searchsorted(self.owner, np.arange(len(unary)))
        self.text = np.array([n[4] is not None for nodes in trees for n in nodes])
        level = np.array(depth)
        order = np.argsort(level, kind="stable")
        self.levels = np.split(order, np.searchsorted(level[order], np.arange(1, level.max() + 1)))


def sum_product(forest: Forest, seen: np.ndarray, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact marginals: (nodes, label), and (nodes, parent's label, label) for every node with a parent."""
    belief = np.add.reduceat(seen[forest.seen], forest.starts, axis=0)
    belief[forest.text, MIXED] = -1e3  # a text is one thing or the other
    tie = ties[forest.kind]
    upward, outside, pair = np.zeros_like(belief), np.zeros_like(belief), np.full_like(tie, -np.inf)
    for at in reversed(forest.levels[1:]):
        upward[at] = np.logaddexp.reduce(tie[at] + belief[at][:, None, :], axis=2)
        np.add.at(belief, forest.parent[at], upward[at])
    for at in forest.levels[1:]:
        up = forest.parent[at]
        pair[at] = tie[at] + (outside[up] + belief[up] - upward[at])[:, :, None] + belief[at][:, None, :]
        outside[at] = np.logaddexp.reduce(pair[at] - belief[at][:, None, :], axis=1)
    total = belief + outside
    total = np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True))
    inner = forest.parent >= 0
    flat = pair[inner].reshape(-1, 9)
    joint = np.zeros_like(tie)
    joint[inner] = np.exp(flat - np.logaddexp.reduce(flat, axis=1, keepdims=True)).reshape(-1, 3, 3)
    return total, joint


class Model:
    """Potentials fitted to labelled trees."""

    def __init__(self, trees: list[list[list]], labels: list[list[int]], weights: list[float], rounds: int = 150, penalty: float = 0.02):
        seen = Counter(f for nodes in trees for fs in features(nodes) for f in fs)
        self.index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
        self.kinds = {k: i for i, k in enumerate(sorted({kind_of(n[1]) for nodes in trees for n in nodes} | {"block"}))}
        forest = Forest(trees, self.index, self.kinds)
        truth = np.array([y for own in labels for y in own])
        weight = np.repeat(weights, [len(own) for own in labels])
        self.seen, self.ties = np.zeros((len(self.index) + 1, 3)), np.zeros((len(self.kinds), 3, 3))
        # All text below an ARTICLE node is article, none below an OTHER node.
        barred = np.zeros((3, 3), bool)
        barred[ARTICLE, [OTHER, MIXED]] = barred[OTHER, [ARTICLE, MIXED]] = True
        inner = np.flatnonzero(forest.parent >= 0)
        speed_seen, speed_ties = np.full_like(self.seen, 1e-3), np.full_like(self.ties, 1e-3)
        for _ in range(rounds):
            node, joint = sum_product(forest, self.seen, np.where(barred, -30.0, self.ties))
            off = -node
            off[np.arange(len(truth)), truth] += 1
            step_seen = np.zeros_like(self.seen)
            np.add.at(step_seen, forest.seen, (off * weight[:, None])[forest.owner])
            joint = -joint[inner]
            joint[np.arange(len(inner)), truth[forest.parent[inner]], truth[inner]] += 1
            step_ties = np.zeros_like(self.ties)
            np.add.at(step_ties, forest.kind[inner], joint * weight[inner][:, None, None])
            step_seen[-1] = 0.0  # what was not seen in training says nothing
            for value, step, speed in ((self.seen, step_seen, speed_seen), (self.ties, step_ties, speed_ties)):
                step = step - penalty * value
                speed += step**2
                value += 0.5 * step / np.sqrt(speed)
        self.ties = np.where(barred, -30.0, self.ties)

    def marginals(self, trees: list[list[list]]) -> np.ndarray:
        """P(label) of every node of the trees, one after the other."""
        return sum_product(Forest(trees, self.index, self.kinds), self.seen, self.ties)[0]

    def texts(self, pages: list[str]) -> list[str]:
        trees = [read_nodes(p) for p in pages]
        article = self.marginals(trees)[:, ARTICLE] > 0.5 if trees else []
        out, base = [], 0
        for nodes in trees:
            out.append(" ".join(n[4] for n, ok in zip(nodes, article[base : base + len(nodes)]) if ok and n[4] is not None))
            base += len(nodes)
        return out


def fit(named_pages: list[str]) -> Model:
    """The model from the fixed layouts and pages whose markup names their article."""
    trees, labels, weights = [], [], []
    for pages, named in ((seed_pages(), False), (named_pages, True)):
        read = [(nodes, marked_labels(nodes, named)) for nodes in map(read_nodes, pages)]
        read = [(nodes, own) for nodes, own in read if own is not None]
        trees += [nodes for nodes, _ in read]
        labels += [own for _, own in read]
        weights += [1.0] * len(read)
    return Model(trees, labels, weights)


def train(pages: DataFrame, labelled_pages: int = 150, page_id: str = "page_id", html: str = "html") -> Model:
    """The model from the fixed layouts and at most ``labelled_pages`` pages of the table, which come to the driver."""
    chosen = pages.select(page_id).distinct().orderBy(F.xxhash64(page_id), page_id).limit(labelled_pages)
    own = pages.join(F.broadcast(chosen), page_id).select(F.col(html).cast("string").alias("html")).limit(labelled_pages).toArrow().column("html").to_pylist()
    return fit([h for h in own if h])


def main_text(pages: DataFrame, model: Model, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = [h or "" for h in batch.column(2).to_pylist()]
            for a, b in by_bytes(list(map(len, whole)), 1 << 20):
                texts = model.texts(whole[a:b])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")


def op6_main_text(spark, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return main_text(pages, train(pages))


QUERIES = {"op6_main_text": op6_main_text}
