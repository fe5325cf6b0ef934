"""Removal of repeated passages by sorting suffixes, shallow and deep.

A byte goes if a string of ``least`` bytes over it also starts anywhere else. Sorting the suffixes at every byte is not
needed: of the ``least - GRAM + 1`` byte grams in such a string one has the least hash, so equal strings share an *anchor*
at the same place. Only suffixes at anchors are sorted, about one in 180 bytes.

1. A pass over the texts finds the anchors. For each it notes the strings whose anchor it is (a run of starts), a hash of
   the gram and one of the text that these strings cover, its *span*.
2. Spans are counted, and the count is joined to the anchors once. Equal spans are repeats as a whole. An anchor whose gram
   occurs nowhere else holds no repeat.
3. For grams that occur in different spans, one text per span goes to the gram's task. There the suffixes from the anchor on
   are sorted by multikey quicksort to a shallow depth, and groups that still agree by a blind trie on
   full depth; neighbours' common prefixes follow. So are the reversed texts before the anchors. Joining neighbours from the
   longest common prefix down, each span meets its nearest ones in the order of the reversed texts, which yields the longest
   match to the left for every length to the right.
4. A gram with more than ``MOST`` different spans is split by halves of the starts: each half has a longer text in common,
   and is keyed by it, until groups are small or single strings.

Positions are judged on the input: what one removal leaves takes no part. Null and empty texts and texts shorter than
``least`` lose nothing; repeated rows are copies of each other; overlaps count; a null ``doc_id`` is a document like any
other; an empty table gives no rows. Texts are taken whole; a very long one is a row of its task and is cut into spans. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import _TABLE, CHUNK_BYTES, mixed, stored, texts, utf8

LEAST = 400
GRAM = 32
#: Different spans of one gram that a task sorts at most.
MOST = 4096
#: Bytes that multikey quicksort looks at in all, and at a time.
SHALLOW, CHUNK = 64, 8


# --- anchors -------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, first start, last start, gram hash)`` of the strings of ``least`` bytes in one stretch of bytes;
    of equal hashes in a string the leftmost is its anchor."""
    grams = least - GRAM + 1
    starts = len(data) - least + 1
    if starts <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h, size, power = _TABLE[data], 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power % 2**64
    h = mixed(h)
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while 2 * size <= grams:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < grams:
        low = np.minimum(low[:len(low) - (grams - size)], low[grams - size:])
    at = (low[:starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    last = np.append(first[1:] - 1, starts - 1)
    return at[first], first, last, h[at[first]]


def _stretches(offsets: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """``(row, from, to)`` of stretches that together hold every string of ``least`` bytes once."""
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for first in range(a, b - least + 1, CHUNK_BYTES):
            yield row, first, min(b, first + CHUNK_BYTES + least - 1)


_ANCHORS = "id long, h long, gram long, span long, at int, before short, after short, times byte"


def _find_anchors(docs: DataFrame, least: int) -> DataFrame:
    """A row per anchor: its place ``at`` in the text, the distance to the first string's start (``before``) and from the
    last one's (``after``); a span that its text holds more often has one row with ``times`` 2."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column("text"))
            raw = memoryview(data)
            ids, hashes = b.column("id"), b.column("h")
            held, size = [], 0
            for row, i, j in _stretches(offsets, least):
                at, first, last, gram = anchors(data[i:j], least)
                span = np.fromiter(map(xxhash.xxh3_64_intdigest, (
                    raw[i + x:i + y + least] for x, y in zip(first.tolist(), last.tolist()))), np.uint64, len(at))
                _, one, times = np.unique(span ^ gram, return_index=True, return_counts=True)
                held.append((np.full(len(one), row), gram[one], span[one], at[one] + (i - offsets[row]), at[one] - first[one],
                             at[one] - last[one], np.minimum(times, 2)))
                if (times > 1).any():  # all places of a span that the text repeats
                    again = np.flatnonzero(~np.isin(np.arange(len(at)), one))
                    held.append((np.full(len(again), row), gram[again], span[again], at[again] + (i - offsets[row]),
                                 at[again] - first[again], at[again] - last[again], np.full(len(again), 0)))
                size += len(at)
                if size > 200_000:
                    yield _anchor_batch(held, ids, hashes)
                    held, size = [], 0
            if held:
                yield _anchor_batch(held, ids, hashes)

    return _keyed(docs).mapInArrow(find, _ANCHORS)


def _anchor_batch(held: list, ids: pa.Array, hashes: pa.Array) -> pa.RecordBatch:
    row, gram, span, at, before, after, times = (np.concatenate(c) for c in zip(*held))
    rows = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [ids.take(rows), hashes.take(rows), pa.array(gram.astype(np.uint64).view(np.int64)),
         pa.array(span.astype(np.uint64).view(np.int64)), pa.array(at.astype(np.int32)), pa.array(before.astype(np.int16)),
         pa.array(after.astype(np.int16)), pa.array(times.astype(np.int8))], names=[x.split()[0] for x in _ANCHORS.split(", ")])


def known_id(doc_id: Column) -> Column:
    """A join key that also finds null ids."""
    return F.coalesce(doc_id, F.lit(-2**63))


def _keyed(docs: DataFrame) -> DataFrame:
    """``id, h, text``: equal rows have equal keys."""
    return texts(docs).select(known_id(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("h"), "text")


# --- sorting -------------------------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Different strings by the bytes where they part: a node knows how deep it branches and on what, not the text
    between."""

    def __init__(self, first: int):
        self.root: list | int = first  # a leaf is an index, a node [depth, {byte: child}]; byte -1 is the end

    def insert(self, item: int, strings: list[bytes]) -> None:
        text = strings[item]
        node = self.root
        while isinstance(node, list):  # blindly to some leaf
            depth, children = node
            byte = text[depth] if depth < len(text) else -1
            node = children.get(byte)
            if node is None:
                node = next(iter(children.values()))
        other = strings[node]
        depth = common_prefix(text, other)  # one look at the text tells where the paths part
        mine, theirs = (x[depth] if depth < len(x) else -1 for x in (text, other))
        above, byte_above, node = None, None, self.root
        while isinstance(node, list) and node[0] < depth:
            above, byte_above = node, text[node[0]] if node[0] < len(text) else -1
            node = node[1][byte_above]
        if isinstance(node, list) and node[0] == depth:
            node[1][mine] = item
            return
        made = [depth, {mine: item, theirs: node}]
        if above is None:
            self.root = made
        else:
            above[1][byte_above] = made

    def ordered(self) -> tuple[list[int], list[int]]:
        """Items in the order of their texts, and the common prefix of each with the one before."""
        items: list[int] = []
        depths: list[int] = []
        stack: list = [(self.root, 0)]
        while stack:
            node, depth = stack.pop()
            if isinstance(node, list):
                children = [node[1][k] for k in sorted(node[1])]
                stack += [(c, node[0]) for c in children[:0:-1]] + [(children[0], depth)]
            else:
                items.append(node)
                depths.append(depth)
        return items, depths


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of the strings, and the common prefix of each with the one before (0 for the first).

    Multikey quicksort parts them by ``CHUNK`` bytes at a time down to ``SHALLOW``; groups that still agree are ordered by
    a blind trie, which looks at each string once.
    """
    if len(strings) == 2:
        a, b = strings
        return ([0, 1] if a <= b else [1, 0]), [0, common_prefix(a, b)]
    order: list[int] = []
    depths: list[int] = []
    stack: list[tuple[list[int], int, bool]] = [(list(range(len(strings))), 0, True)]

    def put(items: list[int], inner: list[int]) -> None:
        depths.append(common_prefix(strings[order[-1]], strings[items[0]]) if order else 0)
        order.extend(items)
        depths.extend(inner)

    while stack:
        items, depth, _ = stack.pop()
        if len(items) == 1:
            put(items, [])
        elif depth >= SHALLOW:
            equal: dict[bytes, list[int]] = {}
            for i in items:
                equal.setdefault(strings[i], []).append(i)
            firsts = [e[0] for e in equal.values()]
            trie = BlindTrie(firsts[0])
            for i in firsts[1:]:
                trie.insert(i, strings)
            found, inner = trie.ordered()
            whole = [equal[strings[i]] for i in found]
            between = [d for e, k in zip(whole, inner) for d in [k] + [len(strings[e[0]])] * (len(e) - 1)]
            put([i for e in whole for i in e], between[1:])
        else:
            keys = [strings[i][depth:depth + CHUNK] for i in items]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [i for i, k in zip(items, keys) if k < pivot]
            same = [i for i, k in zip(items, keys) if k == pivot]
            more = [i for i, k in zip(items, keys) if k > pivot]
            if more:
                stack.append((more, depth, True))
            if len(pivot) < CHUNK:  # these strings end here: equal
                stack += [([i], depth, True) for i in reversed(same)]
            else:
                stack.append((same, depth + CHUNK, True))
            if less:
                stack.append((less, depth, True))
    return order, depths


def matches(left: list[bytes], right: list[bytes], live: list[bool], least: int) -> list[list[tuple[int, int]]]:
    """For spans that meet at an anchor, with the reversed text before it and the text from it on: the runs
    ``(bytes before, bytes after)`` of at least ``least`` bytes in all that a live span shares with another one."""
    found: list[list[tuple[int, int]]] = [[] for _ in left]
    if len(left) == 2:
        r, x = common_prefix(*right), common_prefix(*left)
        if r + x >= least:
            for i in (0, 1):
                if live[i]:
                    found[i].append((x, r))
        return found
    by_left, _ = deep_shallow(left)
    rank = [0] * len(left)
    for k, i in enumerate(by_left):
        rank[i] = k
    order, depths = deep_shallow(right)
    group = list(range(len(left)))  # of each place in the order: where its group's ranks are
    ranks: list[list[int] | None] = [[rank[i]] for i in order]

    def top(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    def meet(i: int, j: int, r: int) -> None:
        x = common_prefix(left[i], left[j])
        if x + r >= least:
            for k in (i, j):
                if live[k]:
                    found[k].append((x, r))

    for k in sorted(range(1, len(order)), key=lambda k: -depths[k]):
        r = depths[k]
        a, b = top(k - 1), top(k)
        if len(ranks[a]) < len(ranks[b]):
            a, b = b, a
        large, small = ranks[a], ranks[b]
        for x in small:
            at = bisect_left(large, x)
            if at:
                meet(by_left[x], by_left[large[at - 1]], r)
            if at < len(large):
                meet(by_left[x], by_left[large[at]], r)
            insort(large, x)
        group[b], ranks[b] = a, None
    return found


# --- groups of spans -----------------------------------------------------------------------------------------------

_CONTEXT = "key long, span long, live boolean, id long, h long, at int, before short, after short, left binary, right binary"


def _contexts(spans: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """Text before (reversed) and from the anchor on, of one place of each span."""
    wanted = spans.groupBy("id", "h").agg(F.collect_list(
        F.struct("gram", "span", "live", "at", "before", "after")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            rows = zip(b.column("id").to_pylist(), b.column("h").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(),
                       b.column("places").to_pylist())
            for id_, h, text, places in rows:
                for p in places:
                    at, before, after = p["at"], p["before"], p["after"]
                    out.append((p["gram"], p["span"], p["live"], id_, h, at, before, after,
                                text[at - before:at][::-1], text[at:at - after + least]))
                if len(out) > 20_000:
                    yield _rows(out, _CONTEXT)
                    out = []
            if out:
                yield _rows(out, _CONTEXT)

    return _keyed(docs).join(wanted, ["id", "h"]).select("id", "h", "text", "places").mapInArrow(cut, _CONTEXT)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "short": pa.int16(), "boolean": pa.bool_(), "binary": pa.binary()}


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _TYPES[kind]) for c, (_, kind) in zip(zip(*rows), fields)], names=[name for name, _ in fields])


_RUNS = "id long, h long, start int, end int"


def _sorted_groups(contexts: DataFrame, least: int) -> DataFrame:
    """Repeated runs of bytes, from groups of spans that a task takes one after the other."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> list[tuple]:
            if len(held) < 2 or not any(x[1] for x in held):
                return []
            found = matches([x[5] for x in held], [x[6] for x in held], [x[1] for x in held], least)
            out = []
            for (_, _, id_, h, at, _, _), runs in zip(held, found):
                end = -1
                for start, stop in sorted((at - x, at + r) for x, r in runs):  # overlapping: all hold the anchor
                    if end < 0:
                        first, end = start, stop
                    else:
                        end = max(end, stop)
                if end >= 0:
                    out.append((id_, h, first, end))
            return out

        for b in batches:
            out: list[tuple] = []
            for x in zip(*(b.column(c).to_pylist() for c in ("key", "live", "id", "h", "at", "left", "right"))):
                if held and held[0][0] != x[0]:
                    out += flush()
                    held.clear()
                held.append(x)
            if out:
                yield _rows(out, _RUNS)
        if out := flush():
            yield _rows(out, _RUNS)

    grouped = contexts.select("key", "live", "id", "h", "at", "left", "right").repartition("key").sortWithinPartitions("key")
    return grouped.mapInArrow(solve, _RUNS)


_HALVES = _CONTEXT.replace("key long", "key long, low short, high short").replace("left binary", "left binary")


def _halved(contexts: DataFrame, least: int) -> DataFrame:
    """Both halves of the starts of every span. Strings that start ``d`` bytes before the anchor, ``low <= d <= high``,
    have the text from ``low`` before to ``least - high`` after it in common, which becomes their key."""

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "low", "high", "live", "id", "h", "at", "before", "after", "left", "right")
        for b in batches:
            out: list[tuple] = []
            for key, low, high, live, id_, h, at, before, after, left, right in zip(*(b.column(c).to_pylist() for c in names)):
                middle = (low + high) // 2
                for a, z in ((low, middle), (middle + 1, high)):
                    first, last = min(before, z), max(after, a)
                    if a > z or first < last:
                        continue
                    x, y = left[:first], right[:least - last]
                    core = left[:a] + b"|" + right[:least - z]
                    out.append((
                        _hash(b"%d,%d,%d:" % (key, a, z) + core), a, z, _hash(b"%d:" % first + x + b"|" + y),
                        live, id_, h, at, first, last, x, y))
                if len(out) > 20_000:
                    yield _rows(out, _HALVES)
                    out = []
            if out:
                yield _rows(out, _HALVES)

    return contexts.mapInArrow(halve, _HALVES)


def _hash(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def _run(at: Column, before: Column, after: Column, least: int) -> list[Column]:
    return [(at - before).cast("int").alias("start"), (at - after + least).cast("int").alias("end")]


def repeated_runs(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``id, h, start, end``: runs of bytes of the text with that key which repeat; they may overlap."""
    found = stored(_find_anchors(docs, least), "anchors")
    # how often each span occurs, and whether its gram occurs again and in different spans; counted per task before the shuffle
    # and written, so that both sides of the joins are plain exchanges, which adaptive execution splits where one is skewed
    counted = stored(found.groupBy("gram", "span").agg(F.sum("times").alias("n")), "span-counts")
    grams = stored(counted.groupBy("gram").agg(F.sum("n").alias("all"), F.count("*").alias("spans")).where(
        F.col("all") > 1).select("gram", (F.col("spans") > 1).alias("differ")), "grams")
    known = stored(counted.join(grams, "gram"), "spans-again")
    again = stored(found.join(known, ["gram", "span"]), "anchors-again")
    runs = [again.where("n > 1").select("id", "h", *_run(F.col("at"), F.col("before"), F.col("after"), least))]
    spans = stored(again.where("differ").groupBy("gram", "span").agg(
        F.min(F.when(F.col("times") > 0, F.struct("id", "h", "at", "before", "after"))).alias("place"), F.max("n").alias("n"),
    ).select("gram", "span", (F.col("n") == 1).alias("live"), "place.*"), "spans")
    sizes = stored(spans.groupBy("gram").agg(F.count("*").alias("n"), F.max("live").alias("any")).where(
        "n > 1 and any").drop("any"), "gram-sizes")
    open_ = spans.join(sizes, "gram")
    contexts = stored(_contexts(open_.drop("n"), docs, least).dropDuplicates(["key", "span"]).join(
        sizes.select(F.col("gram").alias("key"), "n"), "key"), "contexts")
    runs.append(_sorted_groups(contexts.where(F.col("n") <= most), least))
    large = contexts.where(F.col("n") > most).withColumns({"low": F.lit(0).cast("short"), "high": F.lit(least - GRAM).cast("short")})
    while large.take(1):
        halves = stored(_halved(large, least), "halves")
        counted = halves.groupBy("key", "low", "high", "span").agg(
            F.count("*").alias("times"), F.min(F.struct("id", "h", "at")).alias("one"))
        joined = stored(halves.join(counted, ["key", "low", "high", "span"]), "halves-counted")
        runs.append(joined.where("live and times > 1").select(
            "id", "h", *_run(F.col("at"), F.col("before"), F.col("after"), least)))
        kept = joined.where((F.col("times") == 1) | (F.struct("id", "h", "at") == F.col("one"))).withColumn(
            "live", F.col("live") & (F.col("times") == 1)).drop("times", "one")
        sizes = kept.groupBy("key", "low", "high").agg(
            F.count("*").alias("n"), F.max("live").alias("any")).where("n > 1 and any").drop("any")
        grouped = stored(kept.join(sizes, ["key", "low", "high"]), "halves-open")
        runs.append(_sorted_groups(grouped.where(F.col("n") <= most), least))
        large = grouped.where(F.col("n") > most)
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def _gathered(docs: DataFrame, least: int, most: int) -> DataFrame:
    """Runs of each text in one row."""
    return repeated_runs(docs, least, most).groupBy("id", "h").agg(
        F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"))


def removed(text: bytes, runs: list[dict]) -> tuple[bytes, int, list[tuple[int, int]]]:
    """What stays, how many bytes go, and the maximal runs that go."""
    whole: list[tuple[int, int]] = []
    for r in runs:
        if whole and r["start"] <= whole[-1][1]:
            whole[-1] = whole[-1][0], max(whole[-1][1], r["end"])
        else:
            whole.append((r["start"], r["end"]))
    kept, at = [], 0
    for a, b in whole:
        kept.append(text[at:a])
        at = b
    return b"".join(kept) + text[at:], sum(b - a for a, b in whole), whole


def digest(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            rows = zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("runs").to_pylist())
            for doc_id, text, runs in rows:
                kept, gone, whole = removed(text, runs or [])
                out.append((doc_id, len(text), gone, len(whole), sha256(kept).hexdigest()))
            ids, *numbers, hashes = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (ids, *numbers)] + [pa.array(hashes, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keyed = texts(docs).withColumns({"id": known_id(F.col("doc_id")), "h": F.xxhash64("text")})
    whole = keyed.join(_gathered(docs, least, most), ["id", "h"], "left").select("doc_id", "text", "runs")
    return whole.mapInArrow(summarise, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """All rows and columns of ``docs``, repeated passages cut from ``text`` and ``n_chars``, if there, set anew.

    A character that a removal cuts in two goes as a whole. Null texts stay null.
    """
    keyed = docs.withColumns({"__id": known_id(F.col("doc_id")), "__h": F.xxhash64(F.coalesce("text", F.lit("")))})
    runs = _gathered(docs, least, most).select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("runs").alias("__runs"))
    joined = keyed.join(runs, ["__id", "__h"], "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__runs")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for text, runs in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("__runs").to_pylist()):
                found.append(text.decode() if runs is None and text is not None else
                             None if text is None else removed(text, runs)[0].decode("utf-8", "ignore"))
            columns = []
            for field in b.schema.names[:-1]:
                if field == "text":
                    columns.append(pa.array(found, pa.string()))
                elif field == "n_chars":
                    sizes = [n if t is None or r is None else len(t) for t, r, n in zip(
                        found, b.column("__runs").to_pylist(), b.column("n_chars").to_pylist())]
                    columns.append(pa.array(sizes, b.schema.field("n_chars").type))
                else:
                    columns.append(b.column(field))
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-1])

    return joined.mapInArrow(cut, docs.schema)
