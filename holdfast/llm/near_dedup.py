"""Near-duplicate documents by HyperMinHash signatures, confirmed on full shingle sets.

1. Every text becomes its set of word shingles (64-bit hashes). Texts with equal sets form a class; from here on a class
   is one node, however many copies it has.
2. One pass over the set fills ``REGISTERS`` buckets; a register keeps the leading zeros of its bucket's least hash and the
   next ``MANTISSA`` bits. Registers are banded by ``BAND``; nodes that agree in a band share a bucket.
3. In a bucket of at most ``SMALL`` nodes all pairs are candidates; in a larger one each node is paired with ``CENTRES``
   centres, the same for most bands of a group, so candidates grow with the nodes and not with their square. Registers estimate the
   similarity, corrected for chance agreement; pairs six standard errors below the threshold are dropped.
4. What is left is confirmed on the full sets, and links are joined into components. Larger buckets that still hold several
   components and have the same one as their largest form a family; in each, the nodes outside that component are
   compared with the whole family in blocks, on full sets, so no link depends on the choice of centres.

A pair at similarity 0.8 shares no band at all with a probability of 5e-8.

Words are runs of characters other than white space, A-Z lower-cased. With fewer words than the width the whole sequence is
the only shingle. Null and empty texts and texts without words have the empty set and are linked with nothing. Links
need ``100 * intersection >= percent * union``, ties included. Repeated rows are copies of each other; rows with
a null ``doc_id`` take part, and a component of null ids alone has a null ``component_id``. An empty table gives no rows.
All shingles of a text count, however long it is.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import WHITE, blocks, mixed, stored, texts, utf8, word_classes, word_hashes
from holdfast.llm.links import connected, joined, relabelled

REGISTERS, BAND, MANTISSA = 128, 4, 10
#: Buckets up to this size are compared pair by pair at once.
SMALL = 16
#: Centres of a larger bucket.
CENTRES = 3
#: Members that are compared with one copy of a centre's set, and nodes in a block of a family.
PER_CENTRE = PER_BLOCK = 500
CLASSES = word_classes(WHITE, True)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the different shingles of each text."""
    for a, b in blocks(offsets):
        h, first = word_hashes(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], CLASSES)
        n = max(0, len(h) - width + 1)
        shingle = h[:n].copy()
        for k in range(1, width):
            shingle = mixed(shingle * _ODD + h[k:n + k])
        for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
            if j - i >= width:
                yield np.unique(shingle[i:j - width + 1])
            elif j > i:
                whole = h[i:i + 1] + np.uint64(j - i)
                for k in range(i + 1, j):
                    whole = mixed(whole * _ODD + h[k:k + 1])
                yield mixed(whole)
            else:
                yield h[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Registers of a sorted set; 0 where a bucket is empty."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(shingles):
        spread = mixed(shingles)
        spread.sort()
        bucket = (spread >> np.uint64(57)).astype(np.int64)
        least = np.flatnonzero(np.diff(bucket, prepend=-1))
        value = ((spread[least] & np.uint64((1 << 57) - 1)) >> np.uint64(4)).astype(float)  # 53 bits: exact
        fraction, exponent = np.frexp(value)
        zeros = 53 - exponent
        bits = np.floor(np.maximum(2 * fraction - 1, 0) * (1 << MANTISSA)).astype(np.int64)
        out[bucket[least]] = (zeros << MANTISSA) + bits + 1
    return out


#: For each register the order in which others stand in for it while it is empty; itself comes first.
_STAND_IN = np.stack([
    np.r_[j, (order := np.random.default_rng(j).permutation(REGISTERS))[order != j]] for j in range(REGISTERS)])


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A key per band. Empty registers take the value of the first filled one in their order, so that registers of small
    sets, too, agree with a probability equal to the similarity."""
    out = []
    for first in range(0, len(signatures), 256):
        part = signatures[first:first + 256]
        chosen = (part > 0)[:, _STAND_IN].argmax(2)
        dense = np.take_along_axis(part, _STAND_IN[np.arange(REGISTERS), chosen], 1)
        bands = np.ascontiguousarray(dense).view("<u8").reshape(len(part), -1)
        out.append(mixed(bands ^ mixed(np.arange(1, bands.shape[1] + 1, dtype=np.uint64))).view(np.int64))
    return np.concatenate(out) if out else np.zeros((0, REGISTERS // BAND), np.int64)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of pairs of signatures, corrected for registers that agree by chance, and its standard error at 0.8."""
    filled = ((a > 0) | (b > 0)).sum(1)
    agree = ((a == b) & (a > 0)).sum(1) / np.maximum(filled, 1)
    k = 2.0 ** -np.arange(1, 54)[None, :]
    sa, sb = (np.maximum(n, 1)[:, None] / REGISTERS for n in (na, nb))
    same_zeros = ((np.exp(-sa * k) - np.exp(-2 * sa * k)) * (np.exp(-sb * k) - np.exp(-2 * sb * k))).sum(1)
    chance = np.minimum(same_zeros, 1) * 2.0**-MANTISSA
    return (agree - chance) / (1 - chance), np.sqrt(0.16 / np.maximum(filled, 1))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """Per row its id, a hash of its text, its set's size, class and signature."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(s), xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None,
                      signature(s).tobytes() if len(s) else None)
                     for s in shingle_sets(*utf8(b.column("text")), width)]
            size, cls, sig = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("h"), pa.array(size, pa.int64()), pa.array(cls, pa.binary()),
                 pa.array(sig, pa.binary())], names=["doc_id", "h", "n_shingles", "cls", "sig"])

    hashed = texts(docs).withColumn("h", F.xxhash64("text"))
    return hashed.mapInArrow(sketch, "doc_id long, h long, n_shingles long, cls binary, sig binary")


def _bands(nodes: DataFrame) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(-1, REGISTERS)
            keys = band_keys(sig)
            row = np.repeat(np.arange(len(keys)), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), b.column("cls").take(pa.array(row))], names=["bucket", "cls"])

    return nodes.select("cls", "sig").mapInArrow(split, "bucket long, cls binary")


def _labelled(buckets: DataFrame, *labels: DataFrame) -> DataFrame:
    """``buckets`` with the ``label`` that the tables ``node, label`` lead to from ``cls``, one after the other."""
    found = buckets.withColumn("label", F.col("cls"))
    for x in labels:
        found = relabelled(found, "label", x)
    return found


def _families(members: DataFrame) -> DataFrame | None:
    """Members ``(family, cls, label)`` of the buckets (bucket, cls, label) that hold several components, by the largest of
    these; None if there are none."""
    counts = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    # written, so that both sides of the join are plain exchanges, which adaptive execution splits where one is skewed
    several = stored(counts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels")).where(
        "labels > 1").select("bucket", F.col("top.label").alias("family")), "near-several")
    if not _any(several):
        return None
    return stored(members.join(several, "bucket").select("family", "cls", "label").distinct(), "near-family")


def _all_pairs(members: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of different components within a bucket; the lesser class is the hub."""
    x, y = (members.select(*key, F.col("cls").alias(f"c{i}"), F.col("label").alias(f"l{i}")) for i in (0, 1))
    return x.join(y, key).where("c0 < c1 and l0 != l1").select(F.col("c0").alias("hub"), F.col("c1").alias("member"))


def _star(members: DataFrame) -> DataFrame:
    """Each node of a bucket with the bucket's centres, which are those first in orders that all buckets share."""
    first = [F.min(F.struct(F.xxhash64(F.col("cls"), F.lit(k)).alias("o"), F.col("cls").alias("cls"))) for k in range(CENTRES)]
    centres = stored(members.groupBy("bucket").agg(F.array_distinct(F.transform(
        F.array(*first), lambda c: c["cls"])).alias("hubs")), "near-centres")
    return members.join(centres, "bucket").select(F.explode("hubs").alias("hub"), F.col("cls").alias("member")).where(
        "hub != member")


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Different pairs whose sizes allow the similarity and whose registers do not speak against it."""
    once = pairs.select(
        "hub", "member", F.least("hub", "member").alias("a"), F.greatest("hub", "member").alias("b"),
    ).groupBy("a", "b").agg(F.min("hub").alias("hub")).select(
        "hub", F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"))
    of = lambda name, i: nodes.select(
        F.col("cls").alias(name), F.col("sig").alias(f"s{i}"), F.col("n_shingles").alias(f"n{i}"))
    sized = once.join(of("hub", 0), "hub").join(of("member", 1), "member").where(
        100 * F.least("n0", "n1") >= percent * F.greatest("n0", "n1"))

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, 4096):
                x = b.slice(first, 4096)
                s0, s1 = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("s0", "s1"))
                n0, n1 = (x.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n0", "n1"))
                similar, error = estimate(s0, s1, n0, n1)
                keep = similar >= percent / 100 - 6 * error
                yield x.select(["hub", "member"]).filter(pa.array(keep))

    return sized.select("hub", "member", "s0", "s1", "n0", "n1").mapInArrow(filtered, "hub binary, member binary")


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` among candidate pairs, from the full sets; more than once for classes whose row is repeated.

    A hub's members come to its set; a hub with many members is dealt out with one copy of the set per ``PER_CENTRE``.
    """
    hubs = stored(pairs.groupBy("hub").agg(F.ceil(F.count("*") / PER_CENTRE).cast("int").alias("copies")), "near-hubs")
    members = pairs.join(hubs, "hub").select(
        "hub", F.pmod(F.xxhash64("member"), F.col("copies")).cast("int").alias("part"),
        F.lit(1).alias("role"), F.col("member").alias("cls"))
    centres = hubs.select(
        "hub", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"), F.lit(0).alias("role"),
        F.col("hub").alias("cls"))
    placed = _with_texts(members.unionByName(centres), nodes, docs).repartition("hub", "part").sortWithinPartitions(
        "hub", "part", "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, centre = None, None
        for b in batches:
            links = []
            rows = zip(b.column("hub").to_pylist(), b.column("part").to_pylist(), b.column("role").to_pylist(),
                       b.column("cls").to_pylist(), shingle_sets(*utf8(b.column("text")), width))
            for hub, part, role, cls, found_set in rows:
                if role == 0:
                    place, centre = (hub, part), found_set
                elif place == (hub, part):
                    both = len(np.intersect1d(centre, found_set, assume_unique=True))
                    if 100 * both >= percent * (len(centre) + len(found_set) - both):
                        links.append((hub, cls))
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary()) for c in zip(*links)], names=["a", "b"])

    return placed.mapInArrow(compare, "a binary, b binary")


def _within_families(members: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components of a family, some both ways: its nodes outside the largest component against all its nodes.

    Both are dealt into blocks of ``PER_BLOCK``, and a task holds one block of the former while the latter stream by.
    """
    outside = F.count_if(F.col("label") != F.col("family"))
    largest = stored(members.groupBy("family").agg(
        F.ceil(F.count("*") / PER_BLOCK).cast("int").alias("blocks"), F.ceil(outside / PER_BLOCK).cast("int").alias("parts"),
    ), "near-largest")
    placed = members.join(largest, "family")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("cls"), F.col(n)).cast("int")
    columns = lambda role, block, part: ["family", block.alias("block"), part.alias("part"), F.lit(role).alias("role"),
                                         "label", "cls"]
    wanted = placed.where("label != family").select(
        "*", every("blocks").alias("block")).select(*columns(0, F.col("block"), dealt("parts"))).unionByName(
        placed.select("*", every("parts").alias("part")).select(*columns(1, dealt("blocks"), F.col("part"))))
    key = ["family", "block", "part"]
    texts_of = _with_texts(wanted, nodes, docs).repartition(*key).sortWithinPartitions(*key, "role")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, passing = None, [], []
        for b in batches:
            links: list[tuple[bytes, bytes]] = []
            rows = zip(*(b.column(c).to_pylist() for c in (*key, "role", "label", "cls")),
                       shingle_sets(*utf8(b.column("text")), width))
            for family, block, part, role, label, cls, found in rows:
                if place != (family, block, part):
                    links += _against(held, passing, percent)
                    place, held, passing = (family, block, part), [], []
                (passing if role else held).append((label, cls, found))
                if len(passing) == PER_BLOCK:
                    links += _against(held, passing, percent)
                    passing = []
            links += _against(held, passing, percent)
            passing = []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links)], names=["a", "b"])

    return texts_of.mapInArrow(compare, "a binary, b binary")


def _against(held: list, passing: list, percent: int) -> list[tuple[bytes, bytes]]:
    """Links of each held node with the passing ones of other components."""
    if not held or not passing:
        return []
    size = np.array([len(x) for _, _, x in passing])
    flat = np.concatenate([x for _, _, x in passing])
    start = np.r_[0, size.cumsum()[:-1]]
    out = []
    for label, cls, own in held:
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat((own[at] == flat).astype(np.int64), start)
        for k in np.flatnonzero(100 * both >= percent * (len(own) + size - both)).tolist():
            if passing[k][0] != label:
                out.append((cls, passing[k][1]))
    return out


def _with_texts(wanted: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """``wanted`` with the text of the first row of each class."""
    placed = wanted.join(nodes.select("cls", "doc_id", "h"), "cls")
    found = texts(docs).withColumn("h", F.xxhash64("text"))
    return placed.join(
        found, (known_id(placed["doc_id"]) == known_id(found["doc_id"])) & (placed["h"] == found["h"]),
    ).select(*wanted.columns, "text")


def _any(df: DataFrame) -> bool:
    return bool(df.take(1))


def _all_labels(docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> list[DataFrame]:
    """Tables ``node, label`` that lead from a class to its component, one after the other."""
    bands = _bands(nodes)
    shared = stored(bands.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "near-shared")
    buckets = stored(bands.join(shared, "bucket").select("bucket", "cls", "size"), "near-buckets")
    every = _labelled(buckets)
    pairs = _all_pairs(every.where(F.col("size") <= SMALL), ["bucket"]).unionByName(_star(every.where(F.col("size") > SMALL)))
    likely = stored(_likely(pairs, nodes, percent), "near-pairs")
    labels = connected(_confirmed(likely, nodes, docs, width, percent))
    families = _families(_labelled(buckets.where(F.col("size") > SMALL).select("bucket", "cls"), labels))
    if families is None:
        return [labels]
    # these links join components, whose own links need not be read again
    further = joined(_within_families(families, nodes, docs, width, percent), labels)
    return [labels] if further is None else [labels, further]


def _grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows' sets, and of every class its component's smallest id and first row (known ids first)."""
    sets = stored(_sets(docs, width), "near-sets")
    nodes = stored(sets.where("cls is not null").groupBy("cls").agg(
        F.min(F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "h", "sig", "n_shingles")).alias("first"),
        F.min("doc_id").alias("least"),
    ).select("cls", "first.*", "least"), "near-nodes")
    named = _labelled(nodes.select("cls", "unknown", "doc_id", "h", "least"), *_all_labels(docs, nodes, width, percent))
    of_label = named.groupBy("label").agg(
        F.min("least").alias("component_id"), F.min(F.struct("unknown", "doc_id", "h")).alias("stays"))
    return sets, named.select("cls", "label").join(of_label, "label")


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row; ``component_id`` is the smallest id that links reach."""
    sets, classes = _grouped(docs, width, percent)
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return sets.select("doc_id", "n_shingles", "cls").join(classes.select("cls", "component_id"), "cls", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: the smallest id, one row of repeated ones.

    Rows without words stay.
    """
    _, classes = _grouped(docs, width, percent)
    stays = classes.select(known_id(F.col("stays.doc_id")).alias("__id"), F.col("stays.h").alias("__h")).distinct()
    keyed = docs.withColumns({"__id": known_id(F.col("doc_id")), "__h": F.xxhash64(F.coalesce("text", F.lit("")))})
    wordless = F.btrim(F.coalesce("text", F.lit("")), F.lit(WHITE.decode())) == ""
    one = keyed.where(~wordless).join(stays, ["__id", "__h"], "left_semi").dropDuplicates(["__id", "__h"])
    return one.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(wordless))


def known_id(doc_id: Column) -> Column:
    """A join key that also finds null ids."""
    return F.coalesce(doc_id, F.lit(-2**63))
