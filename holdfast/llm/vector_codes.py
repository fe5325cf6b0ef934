"""Vectors as short codes: one codebook entry per part of a vector, learned and assigned in whole numbers.

A component ``x`` counts as ``floor(1024 * x)``, a vector is cut into equal consecutive parts, and each part position has a
codebook of its own. Every round is one pass over the written integers: tasks assign their parts and sum them per entry, the
sums meet in Spark (at most parts x entries rows, whatever the table's size), and the next codebooks go back with the tasks.
Distances are exact: integers are split into limbs small enough that a float64 matrix product of limbs stays below 2^53, the
products are put together in int64, and the first least distance wins. So results do not depend on partitions or machines.

Rows whose vector is null or holds null or non-finite components are dropped. The parts' width is that of the commonest length
which the parts divide (the least on ties); rows of another length, and rows with components too large for exact 64-bit
distances (2^17 at 64 components), are returned with null ``code`` and ``error`` and take no part. Rows with a null ``vec_id``
are coded but start no entry; rows that share a ``vec_id`` start entries in the order of their vectors. Vectors without
components code as zeros. Null labels count as one label; a label without coded rows has a null ``label_error``. An empty table
gives no rows, fewer rows than entries shorter codebooks. Only ``vec_id``, ``embedding`` and ``label`` are read. Vectors of
any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows that one matrix product handles at a time.
ROWS = 4096


def _limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 arrays ``l`` with ``x = sum(l[i] << bits * i)``; all but the last lie in [0, 2^bits), the last in +-2^bits."""
    out = []
    while x.size and max(int(x.max()), -int(x.min())) > 1 << bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def exact_products(x: np.ndarray, c: np.ndarray, mantissa: int = 53) -> np.ndarray:
    """``x @ c.T`` of int64 matrices, exactly, as long as the result fits int64; limbs keep each float product within
    ``2^mantissa``."""
    width = x.shape[1]
    bits = (mantissa - max(width - 1, 0).bit_length()) // 2
    out = np.zeros((len(x), len(c)), np.int64)
    right = _limbs(c, bits)
    for i, a in enumerate(_limbs(x, bits)):
        for j, b in enumerate(right):
            out += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return out


def assign(values: np.ndarray, books: np.ndarray, mantissa: int = 53) -> tuple[np.ndarray, np.ndarray]:
    """Entry of each part (rows x parts) and the squared distances summed over parts; ``books`` is parts x entries x width."""
    parts, _, width = books.shape
    code, error = np.zeros((len(values), parts), np.int64), np.zeros(len(values), np.int64)
    for p, book in enumerate(books):
        x = values[:, p * width:(p + 1) * width]
        squares = (x * x).sum(1)[:, None] + (book * book).sum(1)[None, :]
        distance = squares - 2 * exact_products(x, book, mantissa)
        code[:, p] = distance.argmin(1)
        error += distance[np.arange(len(x)), code[:, p]]
    return code, error


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for first in range(0, len(whole), ROWS):
            b = whole.slice(first, ROWS)
            yield b, b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(b), dim)


def integers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """``vec_id, label, v`` of the rows that count (``v`` null where it cannot be coded), written once, and the length of ``v``."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("embedding").isNotNull() & finite)
    lengths = kept.groupBy(F.size("embedding").alias("dim")).count().where(F.col("dim") % parts == 0)
    best = lengths.orderBy(F.desc("count"), "dim").first()
    dim = best["dim"] if best else 0
    largest = min(isqrt((1 << 60) // max(dim, 1)), (1 << 31) - 1)
    fits = (F.size("embedding") == dim) & F.forall("embedding", lambda x: F.abs(x) * scale <= largest - 1)
    numbers = F.transform("embedding", lambda x: F.floor(x * scale).cast("int"))
    return stored(kept.select("vec_id", "label", F.when(fits, numbers).alias("v")), "vector_integers"), dim


def first_books(numbers: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the vectors with the least ids."""
    first = numbers.where("v is not null and vec_id is not null").orderBy("vec_id", "v").limit(entries).select("v").collect()
    rows = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, dim // parts)
    return np.ascontiguousarray(rows.transpose(1, 0, 2))


def next_books(numbers: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry becomes the floor of the mean of its parts; unused entries stay."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for _, values in _matrices(batches, parts * width):
            code, _ = assign(values, books)
            slot = code + np.arange(parts) * entries
            for p in range(parts):  # rows in the order of their entry are summed run by run
                order = np.argsort(slot[:, p], kind="stable")
                used, at = np.unique(slot[order, p], return_index=True)
                total[used] += np.add.reduceat(values[order, p * width:(p + 1) * width], at, axis=0)
            count += np.bincount(slot.ravel(), minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), *(pa.array(total[used, i]) for i in range(width))],
            names=["slot", "n", *(f"s{i}" for i in range(width))])

    names = ["n", *(f"s{i}" for i in range(width))]
    schema = "slot long, " + ", ".join(f"{n} long" for n in names)
    found = numbers.where("v is not null").select("v").mapInArrow(sums, schema)
    met = found.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names])
    out = books.reshape(parts * entries, width).copy()
    for r in met.collect():  # a row per entry in use
        out[r[0]] = np.array(r[2:], np.int64) // r[1]
    return out.reshape(books.shape)


def digest_of(books: np.ndarray) -> str:
    """sha256 of all components as decimal text, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``; at most 256 entries, two hex digits of ``code`` a part."""
    numbers, dim = integers(vectors, parts, scale)
    books = first_books(numbers, dim, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = next_books(numbers, books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, values in _matrices(batches, dim):
            code, error = assign(values, books)
            text = code.astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array([text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)]),
                 pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = numbers.schema["label"].dataType.simpleString()
    ids = numbers.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {ids}, label {kind}, code string, error long"
    uncoded = numbers.where("v is null") if books.shape[1] else numbers
    found = uncoded.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if books.shape[1]:
        found = numbers.where("v is not null").mapInArrow(codes, schema).unionByName(found)
    found = stored(found, "vector_codes")
    by_label = found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return found.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))
