"""Main text of web pages by a tree-structured graphical model over their elements.

Every element and every block of text is a variable, content or not. A weight for each of
its features speaks for content; a table of potentials for every kind of child ties it to
its parent. Messages passed from the leaves to the root and back give each block the
probability that it is content, given the whole page. Weights and potentials are fitted by
the likelihood of labelled pages.

Labelled pages are made from a bounded sample of the corpus: the page itself where it marks
its article, and the same blocks set into layouts whose parts are known to be content or
not, so that other ways of naming and nesting these parts are learned too.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from revtables.llm.html_tree import Node, parse

FEATURES = 1 << 13
#: Pages that the model is fitted on at most, those of the smallest hash, and layouts made of each.
TRAINING_PAGES, LAYOUTS = 400, 2
ROUNDS = 160
CONTENT_FROM = 0.5
KINDS = ("#text", "block", "list", "other")
_KIND_OF = {"#text": 0} | dict.fromkeys("div section article main body html".split(), 1) | dict.fromkeys("ul ol li dl dt dd table tr td th tbody".split(), 2)
WORD = re.compile(r"[a-z]+")

# What pages call their parts: tags with class names, for layouts of labelled pages.
CONTENT = ["article", "main", "section class=\"article-body\"", "div class=\"content\"", "div class=\"post-content\"", "div id=\"main\"", "div class=\"entry\"", "div class=\"story text\"", "div itemprop=\"articleBody\" class=\"article\"", "div id=\"content\" role=\"main\"", "div class=\"page\"", "div"]
PARTS = {
    "menu": ["nav", "ul class=\"menu\"", "div class=\"navbar nav\"", "div id=\"navigation\"", "div class=\"breadcrumbs\"", "div role=\"navigation\"", "ul id=\"top-menu\"", "div class=\"toc links\""],
    "header": ["header", "div class=\"header\"", "div id=\"masthead\"", "div class=\"site-header top banner\"", "div role=\"banner\""],
    "footer": ["footer", "div class=\"footer\"", "div id=\"footer\"", "div class=\"copyright legal\"", "div role=\"contentinfo\"", "div class=\"site-info bottom\""],
    "sidebar": ["aside", "div class=\"sidebar\"", "div id=\"side\"", "div class=\"widget related\"", "div role=\"complementary\"", "section class=\"related-posts recommended\"", "div class=\"share social\"", "div class=\"tags meta\""],
    "notice": ["div class=\"notice\"", "div class=\"cookie-banner\"", "div id=\"cookie-consent\"", "div role=\"alert\" class=\"alert\"", "div class=\"popup modal\"", "section class=\"disclaimer message\"", "p class=\"notice warning\"", "dialog"],
    "advert": ["div class=\"ad\"", "div class=\"ads advert\"", "aside class=\"advertisement\"", "div id=\"ad-slot\"", "div class=\"promo sponsored\"", "section class=\"sponsor banner-ad\"", "ins class=\"adsbygoogle\""],
    "form": ["form", "div class=\"newsletter signup subscribe\"", "form class=\"search\"", "div class=\"login form\"", "fieldset", "div id=\"search\""],
    "comments": ["section id=\"comments\"", "div class=\"comments\"", "ol class=\"comment-list\"", "div class=\"comment reply\"", "div id=\"disqus_thread\"", "section class=\"responses discussion\"", "div class=\"reader-comments\""],
}


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    #: By kind of child, then label of the parent, then label of the child.
    ties: np.ndarray


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


_known: dict[str, int] = {}


def _id(name: str) -> int:
    if name not in _known:
        if len(_known) > 100_000:
            _known.clear()
        _known[name] = _slot(name)
    return _known[name]


def features(nodes: list[Node]) -> list[list[int]]:
    """The features of each node: its names, its place and, for text, its length and links."""
    out = []
    for node in nodes:
        found = [_id(f"tag {node.tag}")]
        if node.tag == "#text":
            n = len(node.text)
            parent = nodes[node.parent]
            found += [
                _id(f"in {parent.tag} in {nodes[max(0, parent.parent)].tag}"),
                _id(f"long {min(8, n.bit_length())}"), _id(f"linked {min(4, 4 * node.linked // max(1, n))}"),
                _id(f"in {parent.tag}"), _id(f"stop {node.text[-1] in '.!?:;…'}"),
            ]
        else:
            for word in set(WORD.findall(node.names)):
                found.append(_id(f"name {word}"))
            if node.names:
                found.append(_id("named"))
            if node.parent >= 0:
                found.append(_id(f"{node.tag} under {nodes[node.parent].tag}"))
        out.append(found)
    return out


class Forest:
    """The nodes of many pages as arrays, level by level, for messages of all pages at once."""

    def __init__(self, pages: list[list[Node]]) -> None:
        parents, depths, kinds, flat, sizes, labels, base = [], [], [], [], [], [], 0
        for nodes in pages:
            for node, found in zip(nodes, features(nodes)):
                parents.append(node.parent + base if node.parent >= 0 else -1)
                depths.append(node.depth)
                kinds.append(_KIND_OF.get(node.tag, 3))
                flat += found
                sizes.append(len(found))
                labels.append(node.label)
            base += len(nodes)
        self.parent, depth, self.kind = np.array(parents, np.int64), np.array(depths, np.int64), np.array(kinds, np.int64)
        self.row, self.feature = np.repeat(np.arange(base), sizes), np.array(flat, np.int64)
        self.label = np.array(labels, np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, (depth.max() if base else 0) + 2))
        self.levels = [order[a:z] for a, z in zip(cuts, cuts[1:])]

    def beliefs(self, model: Model) -> tuple[np.ndarray, np.ndarray]:
        """By sum-product: the probability of content of each node, and of each pair with its parent."""
        n = len(self.parent)
        score = np.bincount(self.row, model.weights[self.feature], n)
        own = np.stack([np.zeros(n), score], axis=1)
        below, up = own.copy(), np.zeros((n, 2))
        for level in reversed(self.levels):
            joint = model.ties[self.kind[level]] + below[level][:, None, :]
            up[level] = np.logaddexp(joint[:, :, 0], joint[:, :, 1])
            for y in (0, 1):
                below[:, y] += np.bincount(self.parent[level], up[level, y], n)
        total = below.copy()
        pair = np.zeros((n, 2, 2))
        for level in self.levels:
            above = total[self.parent[level]] - up[level]
            joint = model.ties[self.kind[level]] + above[:, :, None] + below[level][:, None, :]
            total[level] = np.logaddexp(joint[:, 0, :], joint[:, 1, :])
            total[level] -= total[level].max(axis=1, keepdims=True)
            joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
            pair[level] = joint / joint.sum(axis=(1, 2), keepdims=True)
        with np.errstate(over="ignore"):
            content = 1 / (1 + np.exp(total[:, 0] - total[:, 1]))
        return content, pair


def _piece(tag: str, label: int, body: str) -> str:
    return f'<{tag} data-y="{label}">{body}</{tag.split()[0]}>'


def layouts(page: str, seed: int, number: int) -> list[list[Node]]:
    """The page as it labels itself, if it does, and ``number`` layouts of its blocks."""
    nodes = parse(page)
    out = []
    marked = [n for n in nodes if n.tag in ("article", "main")]
    if marked:
        for node in nodes:
            above = nodes[node.parent].label == 1 if node.parent >= 0 else False
            node.label = int(above and node.tag not in ("nav", "aside", "footer", "form", "button", "select", "datalist") or node.tag in ("article", "main"))
        out.append(nodes)
    blocks = [n.text for n in nodes if n.tag == "#text" and (n.label == 1 if marked else len(n.text) >= 60)]
    if not blocks:
        return out
    dice = random.Random(seed)
    snippet = lambda a, z: _safe(" ".join(dice.choice(blocks).split(" ")[: dice.randint(a, z)]))
    for _ in range(number):
        chosen = dice.sample(blocks, min(len(blocks), dice.randint(1, 14)))
        bodies = [snippet(1, 5) if dice.random() < 0.2 else _safe(b) for b in chosen]
        body = "".join(_piece(dice.choice(["p"] * 5 + ["div", "blockquote", "li", "pre", "h3", "td"]), 1, b) for b in bodies)
        body = (_piece(dice.choice(["h1", "h2"]), 1, snippet(3, 9)) if dice.random() < 0.7 else "") + body
        before, after = "", ""
        for name, tags in PARTS.items():
            for _ in range(dice.choice([0, 1, 1, 2])):
                link = name == "menu" or dice.random() < 0.3
                rows = []
                for _ in range(dice.randint(1, 6)):
                    text = snippet(1, 4) if link or name == "header" else snippet(2, 30 if name in ("comments", "advert", "notice", "sidebar") else 10)
                    rows.append(_piece(dice.choice(["li", "li", "p", "p", "div", "div", "span", "h1", "h3", "td"]), 0, f'<a href="/x">{text}</a>' if link else text))
                part = _piece(dice.choice(tags), 0, "".join(rows))
                if name in ("advert", "notice", "form", "sidebar") and dice.random() < 0.3:
                    body += part
                elif name in ("menu", "header", "notice") or (name in ("advert", "sidebar") and dice.random() < 0.5):
                    before += part
                else:
                    after += part
        content = _piece(dice.choice(CONTENT), 1, body)
        for _ in range(dice.randint(0, 2)):
            content = f'<div class="{dice.choice(["wrap", "container", "row", "layout", "site"])}">{content}</div>'
        out.append(parse(f"<body>{before}{content}{after}</body>"))
    for nodes in out:
        _label_rest(nodes)
    return out


def _safe(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;")


def _label_rest(nodes: list[Node]) -> None:
    """Elements without a label are content if most of the text in them is."""
    inside = [[0, 0] for _ in nodes]
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        if node.tag == "#text":
            inside[i][max(0, node.label)] += len(node.text)
        if node.label < 0:
            node.label = int(inside[i][1] > inside[i][0])
        if node.parent >= 0:
            inside[node.parent][0] += inside[i][0]
            inside[node.parent][1] += inside[i][1]


def fit(pages: list[tuple[int, str]], rounds: int = ROUNDS, penalty: float = 0.3) -> Model:
    """Weights and potentials of the largest likelihood of the labelled pages."""
    forest = Forest([nodes for seed, page in pages for nodes in layouts(page, seed, LAYOUTS)])
    ties = np.zeros((len(KINDS), 2, 2))
    ties[:, 0, 0] = ties[:, 1, 1] = 1.0
    weights = np.zeros(FEATURES)
    if not len(forest.parent):
        return Model(weights, ties)
    n, child = len(forest.parent), forest.parent >= 0
    slot = forest.kind[child] * 4 + forest.label[forest.parent[child]] * 2 + forest.label[child]
    seen = np.bincount(slot, minlength=4 * len(KINDS)).reshape(-1, 2, 2)
    state = np.concatenate([weights, ties.ravel()])
    first, second = np.zeros_like(state), np.zeros_like(state)
    for t in range(1, rounds + 1):
        content, pair = forest.beliefs(Model(state[:FEATURES], state[FEATURES:].reshape(ties.shape)))
        miss = content - forest.label
        of_weights = np.bincount(forest.feature, miss[forest.row], FEATURES) + penalty * state[:FEATURES]
        expected = np.stack([np.bincount(forest.kind[child], pair[child, a, b], len(KINDS)) for a in (0, 1) for b in (0, 1)], axis=1)
        gradient = np.concatenate([of_weights, (expected.reshape(-1, 2, 2) - seen).ravel() + penalty * (state[FEATURES:] - ties.ravel())]) / n
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        state = state - 0.08 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return Model(state[:FEATURES], state[FEATURES:].reshape(ties.shape))


def training_pages(pages: DataFrame, number: int = TRAINING_PAGES) -> list[tuple[int, str]]:
    """(seed, html) of at most ``number`` pages, those with the smallest hash; nulls are left out, and equal rows count as one.

    Tasks first send the smallest hashes alone, then only the pages that are within them.
    """
    rows = pages.where("html IS NOT NULL").select(F.xxhash64("page_id", "html").alias("seed"), "html")
    seeds = [r["seed"] for r in rows.select("seed").orderBy("seed").limit(number).collect()]
    if not seeds:
        return []
    few = rows.where(F.col("seed") <= seeds[-1]).groupBy("seed").agg(F.first("html").alias("html")).orderBy("seed")
    return [(r["seed"], r["html"]) for r in few.collect()]


def with_text(pages: DataFrame, model: Model) -> DataFrame:
    """``pages`` (with a column html) and the main text of each, blocks joined by a line break.

    A null html counts as empty; a page without content has an empty text. Equal pages have
    equal texts. A column called text is replaced.
    """
    pages = pages.drop("text")

    def run(batches):
        for batch in batches:
            out, held, size = [], [], 0

            def solve():
                content, _ = Forest(held).beliefs(model) if held else (np.zeros(0), None)
                at = 0
                for nodes in held:
                    keep = content[at : at + len(nodes)] >= CONTENT_FROM
                    out.append("\n".join(n.text for n, k in zip(nodes, keep.tolist()) if k and n.tag == "#text"))
                    at += len(nodes)
                held.clear()

            for page in batch.column("html"):
                held.append(parse(page.as_py() or ""))
                size += len(held[-1])
                if size >= 20_000:
                    solve()
                    size = 0
            solve()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "text"])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())]))
