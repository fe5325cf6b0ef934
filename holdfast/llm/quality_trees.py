"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the bytes of whole texts, batch by batch. The trees are grown from a bounded sample of labelled rows,
kept as complete binary trees in flat arrays, and walked for all rows of a batch at once.

Null texts count as empty and get the score of an empty text; without usable labels the score is 1/2, with labels of one
kind their smoothed share; repeated rows and ties score alike (0.5 counts as 1); a null ``doc_id`` is never trained on and
its ``held_out`` is null; an empty table gives no rows. Statistics are those of whole texts, however
long. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.common import (
    WHITE, blocks, bounded, held_out_rows, labelled_sample, texts, utf8, word_classes, word_hashes,
)

FOLDS, HELD_OUT = 3, 1
#: Most labelled rows that the trees are grown from.
SAMPLE = 20_000
#: Groups of characters; each gives its share of the text's words.
GROUPS = ("#", "*", "$", "%", "&", "|", "<>", "!", ".", ",", "?;:", "\"'`", "()[]{}", "=/\\@_~^+-", "0123456789")
NAMES = ("log_bytes", "log_words", "bytes_per_word", "distinct_words", "upper", "non_ascii", "white", "lines_per_word",
         "repeated_lines", *GROUPS)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``len(NAMES)`` numbers per text; shares of nothing are 0."""
    out = [_block(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in blocks(offsets)]
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=len(first) - 1)


def _block(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    size = np.diff(offsets)
    which = np.repeat(np.arange(rows, dtype=np.int64) * 256, size)
    bytes_of = np.bincount(which + data, minlength=rows * 256).reshape(rows, 256).astype(float)
    words, first = word_hashes(data, offsets, word_classes(WHITE, True))
    lines, line_first = word_hashes(data, offsets, word_classes(b"\n", False))
    n_words, n_lines = np.diff(first).astype(float), np.diff(line_first).astype(float)
    count = lambda chars: bytes_of[:, list(chars)].sum(1)
    white, upper = count(WHITE), bytes_of[:, 65:91].sum(1)
    letters = upper + bytes_of[:, 97:123].sum(1) + bytes_of[:, 128:].sum(1)
    per = lambda x, y: np.divide(x, y, out=np.zeros(rows), where=y > 0)
    columns = [
        np.log1p(size), np.log1p(n_words), per(size - white, n_words), per(_distinct(words, first), n_words),
        per(upper, letters), per(bytes_of[:, 128:].sum(1), size), per(white, size), per(n_lines, n_words),
        1 - per(_distinct(lines, line_first), n_lines) - (n_lines == 0), *(per(count(g.encode()), n_words) for g in GROUPS),
    ]
    return np.stack(columns, 1)


@dataclass
class Trees:
    """``feature``, ``cut`` per inner node and ``value`` per leaf of complete binary trees, one row per tree."""

    start: float
    depth: int
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z, row = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[row, feature[node]] > cut[node])
            z += value[node - len(feature)]
        return 1 / (1 + np.exp(-z))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15,
              ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Boosting on the logistic loss; splits are found on histograms of gradients over quantile bins."""
    inner = 2**depth - 1
    share = (y.sum() + 1) / (len(y) + 2)
    out = Trees(float(np.log(share / (1 - share))), depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)),
                np.zeros((0, inner + 1)))
    if not len(y) or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    z, trees = np.full(len(y), out.start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            at = node - first
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                k, slots = at * (len(e) + 1) + binned[:, f], width * (len(e) + 1)
                gl = np.bincount(k, g, slots).reshape(width, -1).cumsum(1)
                hl = np.bincount(k, h, slots).reshape(width, -1).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gl, hl = gl[:, :-1], hl[:, :-1]
                gain = gl**2 / (hl + ridge) + (gt - gl)**2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0
                s = gain.argmax(1)
                better = gain[np.arange(width), s] > best + 1e-12
                best = np.where(better, gain[np.arange(width), s], best)
                feature[first:first + width][better] = f
                cut[first:first + width][better] = e[s[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        z += value[leaf]
        trees.append((feature, cut, value))
    out.feature, out.cut, out.value = (np.array(a) for a in zip(*trees))
    return out


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, folds: int = FOLDS, held_out: int = HELD_OUT) -> Trees:
    """Grow trees from at most ``bound`` labelled rows outside the held-out fold; only their statistics are collected."""
    names = [f"s{i}" for i in range(len(NAMES))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(*utf8(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), *(pa.array(x[:, i]) for i in range(x.shape[1]))],
                names=["doc_id", "label", *names])

    schema = "doc_id long, label int, " + ", ".join(f"{n} double" for n in names)
    read = labelled_sample(docs, labels, "quality", folds, held_out, bound).mapInArrow(measure, schema)
    found = bounded(read.distinct(), bound, "quality_sample").toPandas().sort_values(["doc_id", *names])
    return fit_trees(found[names].to_numpy(float), found["label"].to_numpy(float))


def score_documents(docs: DataFrame, model: Trees, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(statistics(*utf8(b.column("text"))))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), held_out_rows(b.column("doc_id"), folds, held_out), pa.array(s),
                 pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return texts(docs).mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least 1/2."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(statistics(*utf8(b.column("text")))) >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
