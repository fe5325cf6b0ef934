"""Exact token counts without encoding: a dynamic programme stores the count at every prefix of every word.

Whole texts are cut into units (a run without white space and the space before it, or white space), which no token crosses.
Each unit's counts are computed once per worker and looked up after that, so the count of a document follows by adding up.
Where a budget runs out, the counts at every prefix of that one unit tell how much of it still fits.

Null and empty texts have no tokens; ``<|endoftext|>`` inside a text is one token, as in the library; repeated rows are
counted alike; a null ``doc_id`` stays null; an empty table gives no rows. Texts are counted
whole, unit by unit, however long. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from holdfast.llm.common import texts
from holdfast.llm.tokens import MergeTable

#: The library's white space: Unicode's, without the four separators that Python's ``\\s`` adds.
SPACE = "\t-\r \x85\xa0  -     　"
WHITE = frozenset(re.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))))
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: Units kept per worker before the memory starts anew.
REMEMBERED = 1_000_000


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary's file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str) -> tuple[MergeTable, str]:
    """Merges of a byte-level tokenizer file, and its special text."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    to_byte = byte_characters()
    vocab = whole["model"]["vocab"]
    special = {t["content"] for t in whole["added_tokens"]}
    pieces = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    order, parts = {i: -1 for i in pieces.values()}, {}
    for rank, pair in enumerate(whole["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        order[vocab[a + b]], parts[vocab[a + b]] = rank, (vocab[a], vocab[b])
    return MergeTable(pieces, order, parts), next(iter(special), "")


class Counter:
    """Counts of units, remembered within one worker."""

    def __init__(self, path: str, pattern: str):
        self.table, self.special = load_vocabulary(path)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def prefix_counts(self, word: str) -> list[int]:
        """Tokens of the first k bytes of a word without inner cuts, for every k."""
        return self.table._one(word.encode("utf-8", "surrogatepass"))[1].tolist()

    def learn(self, units: set[str]) -> None:
        alone = [u for u in units if u.removeprefix(" ").isalpha()]  # letters alone are one piece
        cut = {u: self.pattern.findall(u) for u in units.difference(alone)}
        words = list(set(alone).union(*cut.values()))
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        count = np.zeros(len(raw), np.int64)
        for which, _, counts in self.table.prefix_tokens(raw):
            count[which] = counts[:, -1]
        of = dict(zip(words, count.tolist()))
        if len(self.known) + len(units) > REMEMBERED:
            self.known.clear()
        self.known.update(zip(alone, map(of.__getitem__, alone)))
        for u, found in cut.items():
            self.known[u] = sum(map(of.__getitem__, found))

    def documents(self, found: list[str], budget: int) -> tuple[list[int], list[int]]:
        """Per text its tokens, and the bytes of its longest prefix within ``budget`` tokens (none if the whole text fits)."""
        segments = [t.split(self.special) if self.special in t else [t] for t in found]
        units = [[UNIT.findall(s) for s in parts] for parts in segments]
        totals, fits = [], []
        for first in range(0, len(units), 2000):  # what one learning step must hold at least is what 2000 texts need
            part = units[first:first + 2000]
            needed = set().union(*(u for parts in part for u in parts))
            missing = needed.difference(self.known)
            if missing:
                self.learn(missing)
                if not needed <= self.known.keys():  # the memory was started anew
                    self.learn(needed)
            get = self.known.__getitem__
            for parts in part:
                total = sum(sum(map(get, u)) for u in parts) + len(parts) - 1
                totals.append(total)
                fits.append(None if total <= budget else self._cut(parts, budget))
        return totals, fits

    def _cut(self, parts: list[list[str]], budget: int) -> int:
        left, size = budget, 0
        for k, units in enumerate(parts):
            text, last = "".join(units), k == len(parts) - 1
            spent = sum(map(self.known.__getitem__, units)) + (not last)
            if spent > left:  # a prefix may end inside the special text, which is plain text then
                return size + self._cut_segment(text if last else text + self.special[:-1], left)
            left -= spent
            size += len(text.encode("utf-8", "surrogatepass")) + (0 if last else len(self.special.encode()))
        return size

    def _cut_segment(self, text: str, budget: int) -> int:
        """Bytes of the longest prefix, cut between characters, that has at most ``budget`` tokens as a text of its own."""
        units, spent = [], [0]
        for u in map(re.Match.group, UNIT.finditer(text)):
            if len(spent) > 2 and spent[-2] > budget:
                break
            count = self.known.get(u)
            units.append(u)
            spent.append(spent[-1] + (self._count(u) if count is None else count))
        # the unit in which the prefix ends: the one after those that fit, unless white space of two units is fewer or more
        # tokens where it ends the text, and so is one piece
        for j in range(min(bisect_right(spent, budget), len(units) - 1), -1, -1):
            u, before = units[j], units[j - 1] if j else ""
            k = self._fitting(u, budget - spent[j])
            if k <= 1 and before and before[0] in WHITE and before[-1] in WHITE and u[0] in WHITE:
                run = before + u[0]
                k = int(self._fitting(run, budget - spent[j - 1]) == len(run))
            if k:
                return len(("".join(units[:j]) + u[:k]).encode("utf-8", "surrogatepass"))
        return 0

    def _count(self, unit: str) -> int:
        return sum(self.prefix_counts(p)[-1] for p in self.pattern.findall(unit))

    def _fitting(self, unit: str, budget: int) -> int:
        """Characters of the unit's longest prefix with at most ``budget`` tokens."""
        done = 0
        for found in self.pattern.finditer(unit):
            if budget < 1:
                break
            whole, size = found.group(), 8 * budget
            while True:
                piece = whole[:size]
                counts = self.prefix_counts(piece)
                # past so many bytes in a row of more tokens, every prefix has more
                if size >= len(whole) or min(counts[-self.table.longest:]) > budget:
                    break
                size *= 2
            if len(piece) == len(whole) and counts[-1] <= budget:
                done, budget = done + len(whole), budget - counts[-1]
                continue
            ends = list(accumulate(len(c.encode("utf-8", "surrogatepass")) for c in piece))
            for k in range(len(piece), 0, -1):
                # a prefix of a contraction is two pieces
                if counts[ends[k - 1]] <= budget and (
                        len(cut := self.pattern.findall(piece[:k])) == 1 or sum(map(self._count, cut)) <= budget):
                    return done + k
            break
        return done


_COUNTERS: dict[tuple[str, str], Counter] = {}


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, budget: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, budget_bytes`` per row; ``budget_bytes`` is the size of the longest prefix
    of whole characters that has at most ``budget`` tokens as a text of its own (the whole text, if it fits).

    ``vocabulary`` is the tokenizer's file, at a path that every executor has, and ``pattern`` its splitting pattern.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get((vocabulary, pattern))
        if counter is None:
            counter = _COUNTERS[vocabulary, pattern] = Counter(vocabulary, pattern)
        for b in batches:
            found = b.column("text").to_pylist()
            size = [len(t.encode("utf-8", "surrogatepass")) for t in found]
            totals, fits = counter.documents(found, budget)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(totals, pa.int64()),
                 pa.array([t > budget for t in totals], pa.bool_()),
                 pa.array([s if f is None else f for s, f in zip(size, fits)], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "budget_bytes"])

    return texts(docs).mapInArrow(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, budget_bytes long")
