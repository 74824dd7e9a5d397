"""Main text of web pages by a tree-structured graphical model over the DOM."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.dom import Page, parse
from corvane.llm.page_samples import labelled_pages

TAGS = ("html", "body", "head", "main", "article", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer address", "aside", "form fieldset select option", "button", "table thead tbody tfoot tr td th caption", "blockquote pre figure figcaption details summary")
MARKS = (r"nav|menu|breadcrumb|topbar", r"\bads?\b|advert|banner|promo|sponsor", r"comment|repl(y|ies)|discussion|respon[sd]", r"cookie|consent|notice|popup|modal|gdpr|alert|overlay", r"side|widget|related|recommend", r"share|social|tags?\b", r"foot|copyright|bottom|legal", r"header|masthead|logo", r"content|article|post|story|entry|\bmain\b|\btext\b", r"login|search|subscribe|newsletter|signup|form")
_TAG_OF = {t: k for k, names in enumerate(TAGS) for t in names.split()}
_MARKS = [re.compile(m) for m in MARKS]
_CLAIM = re.compile(r"\s*(©|\(c\)|copyright\b)", re.I)
_CELLS = [_TAG_OF["tr"]]
#: Training pages, all made up.
SAMPLES = 450


@lru_cache(maxsize=4096)
def _mark_row(marks: str) -> tuple[bool, ...]:
    return tuple(bool(m.search(marks)) for m in _MARKS)


@dataclass
class Forest:
    """The blocks of many pages as arrays; parents come before their children."""

    parent: np.ndarray
    depth: np.ndarray
    x: np.ndarray
    levels: list[np.ndarray]
    trunk: np.ndarray  # 1 where the parent is the page's root or body, else 0

    @classmethod
    def of(cls, pages: list[Page]) -> Forest:
        sizes = [len(p.tag) for p in pages]
        base = np.concatenate([[0], np.cumsum(sizes)])
        n = int(base[-1])
        parent = np.concatenate([np.where((a := np.array(p.parent)) < 0, -1, a + b) for p, b in zip(pages, base, strict=False)]) if pages else np.zeros(0, int)
        depth = np.concatenate([np.array(p.depth) for p in pages]) if pages else np.zeros(0, int)
        sums = np.zeros((n, 5))  # letters, letters in links, marks, runs, runs that claim a copyright
        for p, b in zip(pages, base.tolist(), strict=False):
            for block, text, linked in p.runs:
                sums[b + block] += (len(text), min(linked, len(text)), text.count(",") + text.count(".") + text.count(";"), 1, bool(_CLAIM.match(text)))
        below = sums.copy()
        levels = _levels(depth)
        for idx in levels[:0:-1]:
            np.add.at(below, parent[idx], below[idx])
        kind = np.zeros((n, len(TAGS)))
        kind[np.arange(n), [_TAG_OF.get(t, 6) for p in pages for t in p.tag]] = 1
        marks = np.array([_mark_row(m) for p in pages for m in p.marks], float).reshape(n, len(MARKS))
        rate = lambda a, b: a / np.maximum(b, 1)
        largest = np.zeros(n)  # of a block's children, the letters of the one with most
        np.maximum.at(largest, parent[parent >= 0], below[parent >= 0, 0])
        beside = np.where(parent >= 0, rate(largest[parent] - below[:, 0], largest[parent]), 0)
        numbers = [sums[:, 4] > 0, beside, (beside > 0.9) & np.isin(kind.argmax(axis=1), _CELLS), np.ones(n), np.log1p(np.minimum(sums[:, 0], 1000)) / 5, np.log1p(np.minimum(below[:, 0], 1000)) / 5, rate(sums[:, 1], sums[:, 0]), rate(below[:, 1], below[:, 0]), np.minimum(rate(20 * below[:, 2], below[:, 0]), 2), below[:, 0] == 0, np.minimum(below[:, 3], 20) / 20, rate(sums[:, 0], below[:, 0])]
        return cls(parent, depth, np.concatenate([np.stack(numbers, axis=1).reshape(n, len(numbers)), kind, marks], axis=1), levels, np.where(parent >= 0, kind[parent, :2].sum(axis=1), 1).astype(int))


def _levels(depth: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(depth) else [order]


@dataclass(frozen=True)
class Model:
    """weights: of a block's features, for content against not.

    pair[t][a][b]: log potential of a parent with label a and a child with label
    b; t is 1 for children of the root or the body, which hold all sorts of blocks.
    """

    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, forest: Forest) -> np.ndarray:
        """Probability of content of each block."""
        return self.messages(forest)[0]

    def messages(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of blocks, and the expected number of edges by kind, parent's and child's label.

        Sum-product on each page's tree. Upward, level by level from the deepest:
        each child tells its parent how likely its subtree is under either label
        of the parent. Downward from the roots: each parent tells its child the
        same of all the rest. Both passes are exact on a tree and touch each edge
        once.
        """
        n = len(forest.parent)
        unary = np.zeros((n, 2))
        unary[:, 1] = forest.x @ self.weights
        levels = forest.levels
        inward, up = np.zeros((n, 2)), np.zeros((n, 2))
        for idx in levels[:0:-1]:
            belief, pair = unary[idx] + inward[idx], self.pair[forest.trunk[idx]]
            up[idx] = np.logaddexp(pair[:, :, 0] + belief[:, :1], pair[:, :, 1] + belief[:, 1:])
            np.add.at(inward, forest.parent[idx], up[idx])
        down, edges = np.zeros((n, 2)), np.zeros((2, 2, 2))
        for idx in levels[1:]:
            mother, pair = forest.parent[idx], self.pair[forest.trunk[idx]]
            rest = unary[mother] + inward[mother] - up[idx] + down[mother]
            both = pair + rest[:, :, None] + (unary[idx] + inward[idx])[:, None, :]
            both = np.exp(both - both.max(axis=(1, 2), keepdims=True))
            both /= both.sum(axis=(1, 2), keepdims=True)
            for t in (0, 1):
                edges[t] += both[forest.trunk[idx] == t].sum(axis=0)
            down[idx] = np.logaddexp(pair[:, 0] + rest[:, :1], pair[:, 1] + rest[:, 1:])
            down[idx] -= down[idx].max(axis=1, keepdims=True)
        belief = unary + inward + down
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -60, 60))), edges


def trained(pages: list[str], flag: str = "data-c", ridge: float = 1.0, steps: int = 160, rate: float = 0.15) -> Model:
    """The model of labelled pages: their content blocks' start tags hold `flag`.

    Feature weights and pair potentials are fitted together by ridge-penalised
    maximum likelihood of whole trees. The gradient is what the labels show less
    what message passing expects, of features and of edges; steps are Adam's.
    """
    parsed = [parse(p, flag) for p in pages]
    forest, y = Forest.of(parsed), np.array([f for p in parsed for f in p.flagged], float)
    child = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2, 2))
    np.add.at(seen, (forest.trunk[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    n = forest.x.shape[1]
    w, mean, square = np.zeros(n + 8), np.zeros(n + 8), np.zeros(n + 8)
    for k in range(1, steps + 1):
        p, edges = Model(w[:n], w[n:].reshape(2, 2, 2)).messages(forest)
        gradient = np.concatenate([forest.x.T @ (y - p), (seen - edges).ravel()]) - ridge * w
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient**2 - square)
        w += rate * (1 - k / (steps + 1)) * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return Model(w[:n], w[n:].reshape(2, 2, 2))


@lru_cache(maxsize=1)
def default_model() -> Model:
    """The model trained on made-up labelled pages; the same on every call."""
    return trained(labelled_pages(SAMPLES))


def texts(htmls: list[str | None], model: Model, least: float = 0.5) -> list[str]:
    """Main text of each page: content blocks in page order, one line each."""
    pages = [parse(h or "") for h in htmls]
    if not pages:
        return []
    p = model.marginals(Forest.of(pages))
    out, base = [], 0
    for page in pages:
        kept = (" ".join(text.split()) for block, text, _ in page.runs if p[base + block] >= least)
        out.append("\n".join(x for x in kept if x))
        base += len(page.tag)
    return out


def _extracted(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                found = texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    text is the main text of the whole html: references decoded, white space in a
    block made one space and trimmed, blocks joined by a line break. Null html, or
    html without content, gives an empty text. Every row gives one row; nothing is
    shuffled.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(_extracted(model or default_model()), "page_id long, url string, text string, n_chars long")
