"""Document fingerprints by consistent weighted sampling.

The weight of a term is how often the word occurs. For each of ``SAMPLES`` samples every term draws two gamma variates and
an offset that depend on the term alone; the term with the least arrival time is drawn together with its quantised weight.
Two documents draw the same with a probability equal to their generalised Jaccard similarity (sum of the lesser weights over
sum of the greater), so the share of equal samples estimates it.

Words are runs of bytes other than white space. Null and empty texts, and texts without words, have the empty fingerprint:
likeness 1 to one another, 0 to any other. Rows are ordered by ``doc_id`` (nulls first), then by text; the next document of
the last row is the first; a table of one row is its own next. Repeated rows and equal texts have equal fingerprints. An empty
table gives no rows. Texts are read whole; a very long one is stepped through at word ends. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import WHITE, blocks, mixed, stored, texts, utf8, word_classes, word_hashes
from holdfast.session import written

SAMPLES = 64
STEP = 16
CLASSES = word_classes(WHITE, False)


class Sampler:
    """Samples of many texts at a time; the draws of a block's terms are made once for all its texts."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.seeds = mixed(np.arange(1, 5 * samples + 1, dtype=np.uint64)).astype(np.uint32).reshape(5, 1, -1)

    def _uniform(self, low: np.ndarray, high: np.ndarray, draw: int, first: int) -> np.ndarray:
        x = low ^ self.seeds[draw, :, first:first + STEP]
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x += high
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x27D4EB2F)
        x >>= np.uint32(8)
        u = x.astype(np.float32)
        u += np.float32(0.5)
        u *= np.float32(2.0**-24)
        return u

    def draws(self, terms: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per term and sample from ``first`` on a gamma(2, 1) variate, the logarithm of another, and an offset between 0 and 1."""
        low, high = terms.astype(np.uint32)[:, None], (terms >> np.uint64(32)).astype(np.uint32)[:, None]
        r = self._uniform(low, high, 0, first)
        r *= self._uniform(low, high, 1, first)
        np.log(r, out=r)
        np.negative(r, out=r)
        c = self._uniform(low, high, 2, first)
        c *= self._uniform(low, high, 3, first)
        np.log(c, out=c)
        np.negative(c, out=c)
        np.log(c, out=c)
        return r, c, np.minimum(self._uniform(low, high, 4, first), np.float32(1 - 2.0**-22))

    def fingerprints(self, data: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Sixteen bits per sample in hexadecimal; the empty string for a text without words."""
        out: list[str] = []
        for a, b in blocks(offsets, 1 << 18):
            h, first = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], CLASSES)
            out += self._block(h, first)
        return out

    def _block(self, h: np.ndarray, first: np.ndarray) -> list[str]:
        rows = len(first) - 1
        out = [""] * rows
        if not len(h):
            return out
        terms, column = np.unique(h, return_inverse=True)
        row = np.repeat(np.arange(rows), np.diff(first))
        pair, weight = np.unique(row * len(terms) + column, return_counts=True)
        row, column = pair // len(terms), pair % len(terms)
        start = np.flatnonzero(np.diff(row, prepend=-1))
        group = np.cumsum(np.diff(row, prepend=row[0]) != 0)
        often = np.flatnonzero(weight > 1)
        heavy, log_weight = column[often], np.log(weight[often].astype(np.float32))[:, None]
        place = np.full(len(pair), -1)
        place[often] = np.arange(len(often))
        code = np.empty((len(start), self.samples), np.uint64)
        for s in range(0, self.samples, STEP):  # few samples at a time stay in the processor's cache
            r, log_c, beta = self.draws(terms, s)
            # a word that occurs once is at level 0 in every sample
            arrival = (log_c - r * (1 - beta))[column]
            if len(often):
                high = np.floor(log_weight / r[heavy] + beta[heavy])
                arrival[often] = log_c[heavy] - r[heavy] * (high - beta[heavy] + 1)
            least = np.minimum.reduceat(arrival, start, axis=0)
            at, sample = np.nonzero(arrival == least[group])
            drawn = np.zeros(least.shape, np.int64)
            drawn[group[at[::-1]], sample[::-1]] = at[::-1]  # the first of equals stays
            level = np.zeros(least.shape, np.int64)
            if len(often):
                which = place[drawn]
                level = np.where(which < 0, 0, high[which, np.arange(least.shape[1])].astype(np.int64))
            code[:, s:s + STEP] = mixed(terms[column[drawn]] ^ mixed(level.view(np.uint64)))
        raw = (code >> np.uint64(48)).astype(">u2").tobytes().hex()
        width = 4 * self.samples
        for i, target in enumerate(row[start].tolist()):
            out[target] = raw[i * width:(i + 1) * width]
        return out


def likeness(a: str, b: str, samples: int = SAMPLES) -> float:
    """Share of equal samples."""
    if not a or not b:
        return float(a == b)
    return sum(a[i:i + 4] == b[i:i + 4] for i in range(0, 4 * samples, 4)) / samples


def edited(text: str, following: str) -> str:
    """The last half of the characters (rounded down) replaced by as many first ones of the next text, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _packed(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return utf8(pa.array(found, pa.string()))


def _both(sampler: Sampler, found: list[str], changed: list[str]) -> tuple[list[str], list[str]]:
    """Fingerprints of texts and edited texts, made side by side as they share most of their terms."""
    mix = [(kind, x[i]) for i in range(len(found)) for kind, x in ((0, found), (1, changed)) if i < len(x)]
    out: tuple[list[str], list[str]] = ([], [])
    for (kind, _), made in zip(mix, sampler.fingerprints(*_packed([x for _, x in mix]))):
        out[kind].append(made)
    return out


_DONE = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
         "near_edited double, near_next double")


def _finish(ids: list, found: list[str], changed: list[str], prints: list[str], changed_prints: list[str],
            next_prints: list[str]) -> list[pa.Array]:
    raw = [c.encode("utf-8") for c in changed]
    return [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in found], pa.int64()),
        pa.array([sha256(x).hexdigest() for x in raw], pa.string()), pa.array(prints, pa.string()),
        pa.array(changed_prints, pa.string()),
        pa.array([likeness(a, b) for a, b in zip(prints, changed_prints)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(prints, next_prints)], pa.float64()),
    ]


#: An id with more rows than this is dealt to several tasks, by the first ``HEAD`` characters of its texts.
MANY_ROWS, HEAD = 100, 500
#: Most ids of that kind that every task gets as a table; beyond, they are joined by shuffling.
MANY_IDS = 1_000_000


def _dealt(docs: DataFrame) -> DataFrame:
    """Rows in ranges of ``doc_id``, whose places are told by ids alone: only ids that have many rows add heads of texts."""
    many = written(docs.groupBy(F.col("doc_id").alias("many_id")).count().where(F.col("count") > MANY_ROWS).select(
        "many_id", F.lit(True).alias("many")), "many_rows")
    n = many.count()
    if not n:
        return docs.repartitionByRange("doc_id")
    found = docs.join(F.broadcast(many) if n <= MANY_IDS else many, F.col("doc_id").eqNullSafe(F.col("many_id")), "left")
    head = F.when(F.col("many"), F.substring("text", 1, HEAD)).alias("head")
    return found.select("doc_id", "text", head).repartitionByRange("doc_id", "head").drop("head")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per row.

    Rows are dealt by ranges of ``doc_id``, and those of an id with very many rows by ranges of their texts' heads, and sorted
    once; a task streams through its range, so a row and the next one meet without a window over all rows. Only the first and the last row of each range wait for a second
    step, which joins as many rows as there are ranges.
    """
    ordered = _dealt(texts(docs)).sortWithinPartitions("doc_id", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, part = Sampler(), TaskContext.get().partitionId()
        held: tuple | None = None  # the row whose next one is not known yet

        def row(kind: str, x: tuple) -> pa.RecordBatch:
            names = ["kind", "part", "text", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                     "near_edited", "near_next"]
            empty = [pa.array([None], t) for t in (pa.int64(), pa.string())]
            return pa.RecordBatch.from_arrays(
                [pa.array([kind]), pa.array([part], pa.int32()), pa.array([x[1]], pa.string()), pa.array([x[0]], pa.int64()),
                 empty[0], empty[1], pa.array([x[2]], pa.string()), empty[1],
                 *[pa.array([None], pa.float64())] * 2], names=names)

        for b in batches:
            for first in range(0, b.num_rows, 500):
                piece = b.slice(first, 500)
                ids, found = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
                before = [] if held is None else [held]
                whole = [h[1] for h in before] + found
                changed = [edited(t, n) for t, n in zip(whole, whole[1:])]
                prints, changed_prints = _both(sampler, found, changed)
                if not before:
                    yield row("head", (ids[0], found[0], prints[0]))
                ids, prints = [h[0] for h in before] + ids, [h[2] for h in before] + prints
                held = ids[-1], whole[-1], prints[-1]
                n = len(ids) - 1
                if n:
                    done = _finish(ids[:-1], whole[:-1], changed, prints[:-1], changed_prints, prints[1:])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(["done"] * n), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.string()), *done],
                        names=["kind", "part", "text", "doc_id", "n_chars", "edited_sha256", "fingerprint",
                               "edited_fingerprint", "near_edited", "near_next"])
        if held is not None:
            yield row("tail", held)

    streamed = stored(ordered.mapInArrow(stream, f"kind string, part int, text string, {_DONE}"), "fingerprints")
    heads = streamed.where("kind = 'head'").select(
        F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    # one small row per range: the range that follows, or the first one after the last
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = streamed.where("kind = 'head'").select("part").select(
        "part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(every)).alias("next_part"))
    ends = (
        streamed.where("kind = 'tail'").select("part", "doc_id", "text", "fingerprint")
        .join(follows, "part").join(heads, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_print"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for b in batches:
            ids, found, prints, nexts, next_prints = (c.to_pylist() for c in b.columns)
            changed = [edited(t, n) for t, n in zip(found, nexts)]
            yield pa.RecordBatch.from_arrays(
                _finish(ids, found, changed, prints, sampler.fingerprints(*_packed(changed)), next_prints),
                names=[x.split()[0] for x in _DONE.split(", ")])

    done = streamed.where("kind = 'done'").select(*[x.split()[0] for x in _DONE.split(", ")])
    return done.unionByName(ends.mapInArrow(finish, _DONE))
