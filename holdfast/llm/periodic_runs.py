"""Maximal periodic runs of words: stretches in which every word equals the one a period later, at least four times over.

A run of period q in [l, 2l), l a power of two, holds a block of l words that starts at a multiple of l and recurs q words later.
So at each scale l the blocks whose words all recur within less than 2l words (no other can belong to such a run) are compared
with the window that follows them: the sums of squared differences of word numbers at all l distances at once are one cyclic
convolution, taken by number-theoretic transforms of size 2l modulo as many primes as the greatest possible sum needs, hence
exact. Every distance without mismatch seeds an extension to both sides; what reaches the least length is a run, unless a
shorter period already covers it. Blocks well inside a run of shorter period are not compared again.

Words are runs of bytes other than white space (``[^\\x20\\x09-\\x0D]+``); a null text counts as empty. Documents are read one by
one where they lie, nothing is shuffled, and memory follows the longest single text (texts are taken whole; up to 2^27 words,
longer ones fail). An empty text, or one of white space, has no runs and collapses to the empty text. Runs of equal exponent are
ranked by start, then period; repeated rows give repeated results; a null ``doc_id`` stays null; an empty table gives no rows.
``collapse`` keeps all columns, the others read ``doc_id`` and ``text`` only.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.common import blocks, strings, texts, utf8

#: A run is at least so many periods long, and at least so many words.
LEAST_EXPONENT, LEAST_WORDS = 4, 6
#: Primes with a primitive root; the first ones have roots of unity of order 2^27, 2^26 and 2^25.
PRIMES = ((2013265921, 31), (469762049, 3), (167772161, 3))
#: Numbers in a batch of transforms.
BATCH = 1 << 18

Run = tuple[int, int, int]  # start, length, period
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]

_ROOTS: dict[tuple[int, int, bool], np.ndarray] = {}


def _roots(half: int, prime: int, generator: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. half-1 of a root of unity of order 2 * half."""
    if (half, prime, inverse) not in _ROOTS:
        root = pow(generator, (prime - 1) // (2 * half), prime)
        root, out = pow(root, -1, prime) if inverse else root, np.ones(1, np.uint64)
        while len(out) < half:
            out = np.concatenate([out, out * np.uint64(pow(root, len(out), prime)) % np.uint64(prime)])
        _ROOTS[half, prime, inverse] = out
    return _ROOTS[half, prime, inverse]


def _forward(a: np.ndarray, prime: int, generator: int) -> np.ndarray:
    """Transform of each row; the result stands in bit-reversed order."""
    p, (rows, n) = np.uint64(prime), a.shape
    half = n // 2
    while half:
        pair = a.reshape(rows, n // (2 * half), 2, half)
        total = (pair[:, :, 0] + pair[:, :, 1]) % p
        pair[:, :, 1] = (pair[:, :, 0] + p - pair[:, :, 1]) % p * _roots(half, prime, generator, False) % p
        pair[:, :, 0] = total
        half //= 2
    return a


def _backward(a: np.ndarray, prime: int, generator: int) -> np.ndarray:
    p, (rows, n) = np.uint64(prime), a.shape
    half = 1
    while half < n:
        pair = a.reshape(rows, n // (2 * half), 2, half)
        turned = pair[:, :, 1] * _roots(half, prime, generator, True) % p
        pair[:, :, 1] = (pair[:, :, 0] + p - turned) % p
        pair[:, :, 0] = (pair[:, :, 0] + turned) % p
        half *= 2
    return a * np.uint64(pow(n, -1, prime)) % p


def mismatches(block: np.ndarray, window: np.ndarray, bound: int) -> list[np.ndarray]:
    """Sums of squared differences of each block (rows of l numbers below ``bound``) and the l stretches of its window (rows of
    2l - 1) modulo as many primes as tell the greatest sum: a sum is zero where it is zero modulo each of them."""
    rows, size = block.shape
    out, told = [], 1
    for prime, generator in PRIMES:
        if told > size * bound * bound:
            break
        told *= prime
        p = np.uint64(prime)
        b, w = np.zeros((rows, 2 * size), np.uint64), np.zeros((rows, 2 * size), np.uint64)
        b[:, :size], w[:, :2 * size - 1] = block[:, ::-1] % p, window % p
        own = (b * b % p).sum(1, keepdims=True)
        sums = np.zeros((rows, 2 * size), np.uint64)
        np.cumsum((w * w % p)[:, :-1], axis=1, out=sums[:, 1:])
        passing = sums[:, size:] - sums[:, :size]
        both = _forward(b, prime, generator) * _forward(w, prime, generator) % p
        products = _backward(both, prime, generator)[:, size - 1:2 * size - 1]
        out.append((own + passing + np.uint64(2) * (p - products)) % p)
    else:
        if told <= size * bound * bound:
            raise ValueError("a text of more than 2^27 words")
    return out


def seeds(ids: np.ndarray, ends: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``(start, distance)`` where the block of ``size`` words at a start in ``at`` recurs ``size`` to ``2 * size - 1`` words on,
    inside the text that ends at the block's ``ends``."""
    found, outside = [], int(ids.max()) + 1
    step = max(1, BATCH // (2 * size))
    for i in range(0, len(at), step):
        s, e = at[i:i + step, None], ends[i:i + step, None]
        place = s + size + np.arange(2 * size - 1)
        window = np.where(place < e, ids[np.minimum(place, len(ids) - 1)], outside)
        block = ids[s + np.arange(size)]
        hit = np.logical_and.reduce(
            [m == 0 for m in mismatches(block.astype(np.uint64), window.astype(np.uint64), outside + 1)])
        row, lag = np.nonzero(hit)
        found.append((s[row, 0], size + lag))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _matching(ids: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """How many words from ``i`` and ``j`` on (``step`` 1) or back (-1) are equal, ``most`` at most."""
    done, width = 0, 32
    while done < most:
        k = min(width, most - done)
        if step > 0:
            differ = ids[i + done:i + done + k] != ids[j + done:j + done + k]
        else:
            differ = (ids[i - done - k + 1:i - done + 1] != ids[j - done - k + 1:j - done + 1])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, width = done + k, 2 * width
    return most


def runs_of(ids: np.ndarray, offsets: np.ndarray) -> list[list[Run]]:
    """Runs of each text by start, then period; ``ids`` numbers the words of all texts, each from 0 on, texts start at
    ``offsets`` (one more than texts)."""
    texts_n, n = len(offsets) - 1, len(ids)
    out: list[list[Run]] = [[] for _ in range(texts_n)]
    if not n:
        return out
    length = np.diff(offsets)
    text = np.repeat(np.arange(texts_n), length)
    key = text * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    following = np.full(n, n, np.int64)  # words until the same word comes again
    same = key[order[1:]] == key[order[:-1]]
    following[order[:-1][same]] = order[1:][same] - order[:-1][same]
    covered = np.zeros(n, np.int64)  # end of the run that reaches farthest, of those that hold the word
    size, blocks_of, farthest = 1, length.copy(), following
    first = offsets[:-1].astype(np.int64)
    while True:
        live = np.where(length >= LEAST_EXPONENT * size, blocks_of, 0)
        if not live.any():
            break
        starts = np.concatenate([[0], np.cumsum(blocks_of)])
        owner = np.repeat(np.arange(texts_n), blocks_of)
        able = np.flatnonzero((farthest < 2 * size) & (length[owner] >= LEAST_EXPONENT * size))
        at = first[owner[able]] + (able - starts[owner[able]]) * size
        end = offsets[1:][owner[able]]
        open_ = (covered[at] < np.minimum(at + 3 * size - 1, end)) & (at + 2 * size <= end)
        begin, distance = seeds(ids, end[open_], at[open_], size)
        reached: dict[tuple[int, int], int] = {}
        for s, q in sorted(zip(begin.tolist(), distance.tolist())):
            t = int(text[s])
            if s + size + q <= reached.get((t, q), 0):  # the extension of an earlier seed holds it
                continue
            low, high = int(offsets[t]), int(offsets[t + 1])
            right = s + size + q + _matching(ids, s + size, s + size + q, high - (s + size + q), 1)
            left = s - _matching(ids, s - 1, s - 1 + q, s - low, -1)
            reached[t, q] = right
            if right - left >= max(LEAST_WORDS, LEAST_EXPONENT * q) and covered[left] < right:
                out[t].append((left - low, right - left, q))
                covered[left:right] = np.maximum(covered[left:right], right)
        # blocks twice as long
        halves = blocks_of // 2
        later = np.concatenate([[0], np.cumsum(halves)])
        pair = np.repeat(starts[:-1] - 2 * later[:-1], halves) + 2 * np.arange(later[-1])
        farthest = np.maximum(farthest[pair], farthest[pair + 1])
        size, blocks_of = 2 * size, halves
    return [sorted(found, key=lambda r: (r[0], r[2])) for found in out]


def _studied(column: pa.Array, ids: list, rewrite: Rewrite | None) -> Iterator[tuple[list[bytes], list[Run]]]:
    """Words and runs of each text of a batch."""
    data, offsets = utf8(column)
    for a, b in blocks(offsets):
        of = [x.split() for x in strings(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])]
        if rewrite:
            of = [rewrite(i, words) for i, words in zip(ids[a:b], of)]
        numbers = []
        for words in of:
            known: defaultdict = defaultdict()
            known.default_factory = known.__len__
            numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
        yield from zip(of, runs_of(np.concatenate(numbers), np.concatenate([[0], np.cumsum([len(x) for x in of])])))


def _collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if found:
        keep = np.ones(len(words), bool)
        for start, length, period in found:
            keep[start + period:start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words)


def with_cycles(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the texts, by the hash ``h`` of the id: from word ``a`` on, the first ``p`` words over and over."""
    h = None if doc_id is None else crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def digest(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """Per row: ``doc_id, n_runs``, the run of greatest exponent (``start, length, period, exponent_milli``), hashes of all runs
    and of the collapsed text. ``rewrite`` changes the words that are studied."""

    def study(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for words, found in _studied(b.column("text"), b.column("doc_id").to_pylist(), rewrite):
                best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                rows.append((len(found), *best, 1000 * best[1] // best[2] if found else None,
                             hashlib.sha256(listed.encode()).hexdigest(),
                             hashlib.sha256(_collapsed(words, found)).hexdigest()))
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:5]),
                 *(pa.array(c, pa.string()) for c in columns[5:])], schema=arrow)

    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    kinds = ["long"] * 5 + ["string"] * 2
    arrow = pa.schema([("doc_id", pa.int64()), *((n, pa.int64() if k == "long" else pa.string()) for n, k in zip(names, kinds))])
    return texts(docs).mapInArrow(study, "doc_id long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id, start, length, period`` of every run."""

    def study(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            rows = [(i, *r) for i, (_, found) in zip(ids, _studied(b.column("text"), ids, None)) for r in found]
            yield pa.RecordBatch.from_pydict(
                {n: pa.array([r[k] for r in rows], pa.int64()) for k, n in enumerate(("doc_id", "start", "length", "period"))})

    return texts(docs).mapInArrow(study, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with ``text`` as its words outside the repeats of runs, joined by one space; null stays null."""

    def study(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place, column = b.schema.get_field_index("text"), b.column("text")
            short = [_collapsed(*x).decode() for x in _studied(column, [None] * len(b), None)]
            known = column.is_valid().to_pylist()
            yield b.set_column(place, b.schema.field(place), pa.array([t if k else None for t, k in zip(short, known)], column.type))

    return docs.mapInArrow(study, docs.schema)
