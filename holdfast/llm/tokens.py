"""Byte-pair merging as a dynamic programme over prefixes.

The tokens of every prefix of a word follow from shorter prefixes: exactly one vocabulary entry that ends a prefix can
follow the tokens of what stands before it, namely the one that, next to the last token there, no merge across their
border would have broken up. ``MergeTable`` answers that for arrays of token pairs; ``prefix_tokens`` advances all words
of one length together, storing for each prefix its last token and its number of tokens.
"""

from __future__ import annotations

import numpy as np

NONE = np.int64(1) << 40
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(44)


def _seen(spread: np.ndarray) -> np.ndarray:
    """Which top 20 bits occur: tells most absent keys at one look."""
    out = np.zeros(1 << 20, bool)
    out[spread >> _SHIFT] = True
    return out


class MergeTable:
    """Vocabulary over symbols (bytes or code points).

    ``pieces`` maps a string of symbols to its id, ``order`` an id to its place among the merges (lower first; single
    symbols are below 0), ``parts`` an id to the two ids whose merge makes it.
    """

    def __init__(self, pieces: dict, order: dict[int, int], parts: dict[int, tuple[int, int]]):
        self.pieces, self.order, self.parts = pieces, order, parts
        n = max(pieces.values()) + 1
        self.n = n
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        for i, (a, b) in parts.items():
            self.left[i], self.right[i], self.rank[i] = a, b, order[i]
        keys = np.array([a * n + b for a, b in parts.values()], np.int64)
        made = np.array([order[i] for i in parts], np.int64)
        by = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[by], made[by]
        self.pair_of = dict(zip(keys.tolist(), made.tolist()))
        self.pair_seen = _seen(self.pair_keys.astype(np.uint64) * _STEP)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        usable: dict[int, list] = {}
        for text, i in pieces.items():
            if i in parts or len(text) == 1:
                usable.setdefault(len(text), []).append((text, i))
        self.longest = max(usable, default=1)
        for length, found in usable.items():
            if length <= 64:
                symbols = np.array([list(self.symbols(t)) for t, _ in found], np.uint64)
                h = np.zeros(len(found), np.uint64)
                for c in range(length):
                    h = h * _STEP + self.value(symbols[:, c])
                by = np.argsort(h)
                self.by_length[length] = h[by], np.array([i for _, i in found], np.int64)[by], _seen(h * _STEP)

    @staticmethod
    def symbols(text) -> list[int]:
        return list(text) if isinstance(text, bytes) else [ord(c) for c in text]

    @staticmethod
    def value(symbol: np.ndarray) -> np.ndarray:
        x = (symbol + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.n + b
        out = np.full(len(key), NONE)
        likely = np.flatnonzero(self.pair_seen[(key.view(np.uint64) * _STEP) >> _SHIFT])
        if len(likely):
            key = key[likely]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            out[likely] = np.where(self.pair_keys[at] == key, self.pair_rank[at], NONE)
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For final neighbours ``a, b``: whether no merge across their border comes before one of their own."""
        out = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), NONE - 1)
        while len(at):
            crossed = self.merge_rank(a, b) < limit
            out[at[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo = ra > rb  # what was merged last; of equal merges the right one
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    def _may_follow(self, a: int, b: int) -> bool:
        limit, rank, pair = int(NONE) - 1, self.order, self.pair_of
        while True:
            if pair.get(a * self.n + b, int(NONE)) < limit:
                return False
            ra = rank[a] if a in self.parts else -1
            rb = rank[b] if b in self.parts else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.parts[a][1]
            else:
                limit, b = rb + 1, self.parts[b][0]

    def prefix_tokens(self, words: list) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For words of any lengths: per length ``(indexes, last, count)``; ``last[i, k]`` is the last token of the first
        ``k`` symbols of word ``indexes[i]`` (-1: a symbol without id), ``count[i, k]`` their number of tokens."""
        lengths: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            lengths.setdefault(len(w), []).append(i)
        out = []
        for n, which in lengths.items():
            if not n:
                continue
            if n > 64 or len(which) * n < 96:
                for i in which:
                    last, count = self._one(words[i])
                    out.append((np.array([i]), last[None], count[None]))
                continue
            for first in range(0, len(which), 8_000):
                part = np.array(which[first:first + 8_000])
                out.append((part, *self._group([words[i] for i in part], n)))
        return out

    def _group(self, words: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(words[0], bytes):
            symbols = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n).astype(np.uint64)
        else:
            symbols = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n).astype(np.uint64)
        rows = len(words)
        prefix = np.zeros((n + 1, rows), np.uint64)
        for c in range(n):
            prefix[c + 1] = prefix[c] * _STEP + self.value(symbols[:, c])
        last, count = np.full((n + 1, rows), -1, np.int64), np.zeros((n + 1, rows), np.int64)
        sizes = sorted((k for k in self.by_length if k <= n), reverse=True)
        power = {k: np.uint64(pow(int(_STEP), k, 2**64)) for k in sizes}
        for end in range(1, n + 1):
            open_, here = np.arange(rows), prefix[end]
            for k in sizes:
                if k > end or not len(open_):
                    continue
                h, ids, seen = self.by_length[k]
                want = here[open_] - prefix[end - k][open_] * power[k]
                hit = np.flatnonzero(seen[(want * _STEP) >> _SHIFT])
                if not len(hit):
                    continue
                want = want[hit]
                at = np.minimum(np.searchsorted(h, want), len(h) - 1)
                sure = h[at] == want
                hit, at = hit[sure], at[sure]
                row, token = open_[hit], ids[at]
                before = last[end - k][row]
                free = (end == k) | (before < 0)
                fits = free.copy()
                fits[~free] = self.may_follow(before[~free], token[~free])
                row = row[fits]
                last[end][row], count[end][row] = token[fits], count[end - k][row] + 1
                left = np.ones(len(open_), bool)
                left[hit[fits]] = False
                open_ = open_[left]
            count[end][open_] = count[end - 1][open_] + 1  # a symbol without id
        return last.T, count.T

    def _one(self, word) -> tuple[np.ndarray, np.ndarray]:
        """The same for a single, possibly very long word."""
        n = len(word)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        longest, pieces, parts = self.longest, self.pieces, self.parts
        for end in range(1, n + 1):
            count[end] = count[end - 1] + 1
            for k in range(min(longest, end), 0, -1):
                token = pieces.get(word[end - k:end])
                if token is None or (k > 1 and token not in parts):
                    continue
                if end == k or last[end - k] < 0 or self._may_follow(last[end - k], token):
                    last[end], count[end] = token, count[end - k] + 1
                    break
        return np.array(last, np.int64), np.array(count, np.int64)

    def spell(self, last: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of whole words, each row filled from its right end, and their numbers; ``size`` maps an id to its
        symbols, -1 stands for a symbol without id."""
        rows, n = len(last), last.shape[1] - 1
        out, counts = np.full((rows, n), -1, np.int32), np.zeros(rows, np.int64)
        at, row = np.full(rows, n), np.arange(rows)
        for c in range(n - 1, -1, -1):
            token = last[row, at[row]]
            out[row, c] = token
            counts[row] += 1
            at[row] -= np.where(token < 0, 1, size[token])
            row = row[at[row] > 0]
            if not len(row):
                break
        return out, counts


def table_from_scores(pieces: dict[str, int], order: dict[int, int]) -> MergeTable:
    """Find the parts of every piece by merging it with the pieces that come before it; a piece that these merges do
    not produce from two parts is never used."""
    parts: dict[int, tuple[int, int]] = {}
    for text, i in sorted(pieces.items(), key=lambda x: order[x[1]]):
        if len(text) == 1:
            continue
        found = merged_pieces(text, pieces, order, order[i])
        if len(found) == 2 and all(f in pieces for f in found):
            parts[i] = pieces[found[0]], pieces[found[1]]
    return MergeTable(pieces, order, parts)


def merged_pieces(text: str, pieces: dict[str, int], order: dict[int, int], below: float = float("inf")) -> list[str]:
    """Plain merging: again and again the neighbours whose join comes first, the leftmost of equals."""
    now = list(text)
    while len(now) > 1:
        best, where = below, -1
        for k in range(len(now) - 1):
            i = pieces.get(now[k] + now[k + 1])
            if i is not None and order[i] < best:
                best, where = order[i], k
        if where < 0:
            break
        now[where:where + 2] = [now[where] + now[where + 1]]
    return now
