"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A task encodes its texts and packs them a window at a time, so no row moves. Whole sequences are cut off the front of long
documents. The remainders go, longest first, each to the cheapest open sequence with room for it, where a sequence costs
the sum over its pieces of a linear and a quadratic (attention) term; one that fits nowhere is cut at the room of
the cheapest open sequence. What does not fill a last sequence forms sequences of powers of two, which need no padding, so
nothing is padded at all.

Null and empty texts consist of the end token alone; ties of length follow the order of rows, ties of cost the order of
sequences; repeated rows are packed as documents of their own; a null ``doc_id`` stays null; an empty table gives
no rows. Texts are encoded whole; a very long one fills whole sequences of its own. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush
from zlib import crc32

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from holdfast.llm.common import texts

#: Tokens that are packed together; bounds a task's memory.
WINDOW_TOKENS = 8_000_000
#: Weight of the quadratic term against the linear one, per token.
ATTENTION = 1 / 1024


def load_encoding(path: str, pattern: str, special: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={special: len(ranks)})


def capacities(tokens: int, length: int) -> list[int]:
    """Room of the sequences that hold ``tokens`` exactly: full ones, and powers of two for the rest."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class Sequences:
    """Open sequences by room and cost: the cheapest with at least a given room, the first of equal ones.

    Sequences of one room share a heap, and a tree over rooms holds each heap's least cost, so that a look-up costs the depth of
    the tree, however many sequences are open.
    """

    def __init__(self, room: list[int], length: int) -> None:
        self.room = room
        self.used, self.cost = [0] * len(room), [0.0] * len(room)
        self.leaves = 1 << length.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(length + 1)]
        for s, r in enumerate(room):
            self.heaps[r].append((0.0, s))  # in order already
        self.tree = [NONE] * (2 * self.leaves)
        for r, heap in enumerate(self.heaps):
            if heap:
                self.tree[self.leaves + r] = heap[0]
        for i in range(self.leaves - 1, 0, -1):
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def _settle(self, r: int) -> None:
        heap, tree = self.heaps[r], self.tree
        i = self.leaves + r
        tree[i] = heap[0] if heap and r else NONE
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def cheapest(self, least: int) -> int | None:
        """The cheapest sequence with room for ``least`` tokens."""
        best, low, high = NONE, self.leaves + least, 2 * self.leaves
        while low < high:
            if low & 1:
                best = min(best, self.tree[low])
                low += 1
            low, high = low >> 1, high >> 1
        return None if best is NONE else best[1]

    def put(self, s: int, n: int) -> int:
        """Place a piece of ``n`` tokens; its offset."""
        r, offset = self.room[s], self.used[s]
        heappop(self.heaps[r])  # a sequence that was looked up is the first of its room
        self._settle(r)
        self.room[s], self.used[s] = r - n, offset + n
        self.cost[s] += n + ATTENTION * n * n
        heappush(self.heaps[r - n], (self.cost[s], s))
        self._settle(r - n)
        return offset


#: No sequence: dearer than any.
NONE = (float("inf"), -1)


def pack(sizes: np.ndarray, length: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of documents of the given sizes."""
    pieces, sequence = [], 0
    rest = sizes % length
    for d in np.flatnonzero(sizes >= length).tolist():
        for start in range(0, int(sizes[d]) - length + 1, length):
            pieces.append((d, start, length, sequence, 0))
            sequence += 1
    open_ = Sequences(capacities(int(rest.sum()), length), length)
    for d in np.argsort(-rest, kind="stable").tolist():
        left, start = int(rest[d]), int(sizes[d] - rest[d])
        while left:
            s = open_.cheapest(left)
            if s is None:
                s = open_.cheapest(1)
            n = min(left, open_.room[s])
            pieces.append((d, start, n, sequence + s, open_.put(s, n)))
            left, start = left - n, start + n
    return pieces


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, special: str, end: int, length: int = 2048) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``vocabulary`` is a file of byte-pair ranks at a path that every executor has. A sequence's id holds the number of its
    partition of the input above its number within it, so it is the same when a lost task runs again.
    """
    schema = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(vocabulary, pattern, special)
        sequence = TaskContext.get().partitionId() << 33
        tail = np.array([end], "<u4").tobytes()
        ids: list[bytes] = []
        names: list = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            pieces = pack(sizes, length)
            sums = [crc32(memoryview(ids[d])[4 * a:4 * (a + n)]) for d, a, n, _, _ in pieces]
            d, a, n, s, o = (np.array(c, np.int64) for c in zip(*pieces))
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()).take(pa.array(d)), pa.array(a), pa.array(n), pa.array(sums, pa.int64()),
                 pa.array(sizes[d]), pa.array(s + sequence), pa.array(o)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            sequence += int(s.max()) + 1
            ids.clear()
            names.clear()
            held = 0
            return out

        for b in batches:
            for name, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                x = encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes() + tail
                ids.append(x)
                names.append(name)
                held += len(x) // 4
                if held >= WINDOW_TOKENS:
                    yield flush()
        if ids:
            yield flush()

    return texts(docs).mapInArrow(run, schema)
