"""What several operators share: input columns, intermediate tables, text as byte arrays."""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.session import new_folder

#: Bytes of text that one vectorised step handles at a time; longer texts are cut at word ends.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no other column can clash; a null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: later steps start from files that
    every executor reaches and that outlive executors. The files go when the application ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, bound: int) -> DataFrame:
    """``doc_id, text, label`` of the rows of at most ``bound`` labelled ids outside the held-out fold.

    Ids are taken in the order of their hash. Labels that are null or neither 0 nor 1, and ids that
    are null or labelled both ways, are left out. The sample's size bounds the broadcast. An id may have many rows:
    once they are reduced to what is fitted and copies are merged, ``bounded`` applies to them.
    """
    known = (
        labels.select("doc_id", F.col(label).alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold_of(F.col("doc_id"), folds) != held_out))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other").select("doc_id", F.col("label").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return texts(docs).join(F.broadcast(known), "doc_id")


def bounded(rows: DataFrame, bound: int, name: str) -> DataFrame:
    """At most ``bound`` of the rows, those with the least hashes of the whole row."""
    found = stored(rows.withColumn("place", F.xxhash64(*rows.columns)), name)
    if found.count() > bound:  # only hashes are put in order
        last = found.select("place").orderBy("place").limit(bound).agg(F.max("place")).first()[0]
        found = found.where(F.col("place") <= last)
    return found.drop("place")


def held_out_rows(ids: pa.Array, folds: int, fold: int) -> pa.Array:
    """Whether each id lies in the fold; null for a null id."""
    return pa.array([None if i is None else crc32(str(i).encode()) % folds == fold for i in ids.to_pylist()], pa.bool_())


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end, and the offset where each text starts (one more than texts)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def blocks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def _odd_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = [_odd_powers(1, 1), _odd_powers(1, 1)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        _POWERS[:] = _odd_powers(_BASE, n), _odd_powers(pow(_BASE, -1, 2**64), n)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers evenly (a fixed permutation of them)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_classes(separators: bytes, lower: bool) -> np.ndarray:
    """Table from a byte to what it counts as inside a word, 0 for a separator."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[0] = 255  # a NUL byte is text; 255 does not occur in UTF-8
    out[list(separators)] = 0
    return out


#: Space, tab, line feed, vertical tab, form feed and carriage return.
WHITE = b" \t\n\x0b\x0c\r"


def word_hashes(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple:
    """64-bit hashes of all words in order, and the index of the first word of each text (one more than texts); for each of
    ``prefixes`` also the hashes of the words' first bytes, 0 for a word that is no longer."""
    if len(data) > 4 * CHUNK_BYTES and len(offsets) == 2:  # one very long text: step through it
        return _long_text(data, classes, prefixes)
    n = len(data)
    folded = classes[data]
    inside = folded != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]  # words do not run from one text into the next
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    at, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    power, inverse = _powers(max(n, 1))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[folded] * power, out=total[1:])
    hashes = mixed((total[end] - total[at]) * inverse[at])
    starts_of = [
        np.where(end - at > k, mixed((total[np.minimum(at + k, n)] - total[at]) * inverse[at]), np.uint64(0)) for k in prefixes]
    return hashes, np.searchsorted(at, offsets), *starts_of


def _long_text(data: np.ndarray, classes: np.ndarray, prefixes: tuple[int, ...]) -> tuple:
    parts, first, n = [], 0, len(data)
    while first < n:
        last = min(n, first + CHUNK_BYTES)
        while last < n:  # up to the next separator
            gap = np.flatnonzero(classes[data[last:last + CHUNK_BYTES]] == 0)
            if len(gap):
                last += int(gap[0])
                break
            last = min(n, last + CHUNK_BYTES)
        # called with two rows, so that a word longer than the bound is still taken whole
        found = word_hashes(data[first:last], np.array([0, last - first, last - first]), classes, prefixes)
        parts.append((found[0], *found[2:]))
        first = last
    hashes, *starts_of = (np.concatenate(x) for x in zip(*parts))
    return hashes, np.array([0, len(hashes)]), *starts_of


def strings(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
