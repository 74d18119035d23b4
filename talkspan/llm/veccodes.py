"""Vector code compression: product codes whose nearest entries are found by a VA file over the codebooks.

Vectors become integers and are cut into equal parts; each part position has a small codebook. The coordinates of its
entries are quantised to a few bits (cells); for a batch of parts, tables of the squared distance from each coordinate to
the near and the far edge of each cell give lower and upper bounds for every entry by lookups alone, and only entries
whose lower bound does not exceed the least upper bound are refined by integer distances. Training is Lloyd's rounds as
Spark jobs: tasks send sums and counts by entry, a table of fixed size that the driver turns into the next codebooks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Bits of a cell number.
BITS = 4
#: Vectors whose bounds are held at once inside a task.
BLOCK = 2048
#: Components beyond this many units (after scaling) are an error: squared distances of a part must fit 63 bits.
LARGEST = 1 << 26


@dataclass
class Cells:
    """The cells of one part position's entries: the first edge and the width by coordinate, and cell numbers."""

    low: np.ndarray
    width: np.ndarray
    number: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, bits: int = BITS) -> "Cells":
        low = entries.min(axis=0)
        width = np.maximum(-(-(entries.max(axis=0) - low + 1) >> bits), 1)
        return cls(low, width, (entries - low) // width)


def bounds(parts: np.ndarray, cells: Cells, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (parts, entries) of the squared distances, from lookup tables by coordinate and cell."""
    lower = np.zeros((len(parts), len(cells.number)), np.int64)
    upper = np.zeros_like(lower)
    for d in range(parts.shape[1]):
        first = cells.low[d] + np.arange(1 << bits) * cells.width[d]
        last = first + cells.width[d] - 1
        x = parts[:, d : d + 1]
        near = np.maximum(np.maximum(first - x, x - last), 0)
        far = np.maximum(np.abs(x - first), np.abs(x - last))
        lower += np.take(near * near, cells.number[:, d], axis=1)
        upper += np.take(far * far, cells.number[:, d], axis=1)
    return lower, upper


def nearest(parts: np.ndarray, entries: np.ndarray, cells: Cells) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of each part (ties to the lower index), its squared distance, and how many were refined."""
    lower, upper = bounds(parts, cells)
    row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
    gap = parts[row] - entries[entry]
    exact = (gap * gap).sum(axis=1)
    order = np.lexsort((entry, exact, row))
    first = order[np.concatenate([[True], np.diff(row[order]) > 0])] if len(order) else order
    return entry[first], exact[first], len(row)


def encode(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances (vectors, parts); books: (parts, entries, width)."""
    width = books.shape[2]
    codes = np.zeros((len(vectors), len(books)), np.int64)
    errors = np.zeros_like(codes)
    for p, entries in enumerate(books):
        cells = Cells.of(entries)
        for i in range(0, len(vectors), BLOCK):
            codes[i : i + BLOCK, p], errors[i : i + BLOCK, p], _ = nearest(vectors[i : i + BLOCK, p * width : (p + 1) * width], entries, cells)
    return codes, errors


def whole_numbers(column: pa.Array, dims: int) -> np.ndarray:
    """floor(256 x) of a list column without nulls, as (rows, dims)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(flat) != len(column) * dims or (len(column) and (np.diff(column.offsets.to_numpy()) != dims).any()):
        raise ValueError(f"all vectors must have {dims} components")
    if len(flat) and np.abs(flat).max() >= LARGEST:
        raise ValueError(f"a component is {LARGEST // SCALE} or more")
    return flat.astype(np.int64).reshape(len(column), dims)


def usable(vector: Column) -> Column:
    """Not null, and no component null, infinite or not a number."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (parts, entries, width) of rows (id, v); None without rows. They start as the vectors of the smallest ids
    (nulls last, ties by components); fewer rows give fewer entries. What reaches the driver is of fixed size."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()
    if not first.num_rows:
        return None
    dims = len(first.column("v")[0])
    if not dims or dims % parts:
        raise ValueError(f"vectors of {dims} components have no {parts} equal parts")
    width = dims // parts
    start = whole_numbers(first.column("v"), dims)
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        size = books.shape[1]

        def sums(batches, books=books, size=size):
            total, count = np.zeros(books.shape, object), np.zeros((parts, size), np.int64)
            for b in batches:
                v = whole_numbers(b.column(0), dims)
                codes, _ = encode(v, books)
                for p in range(parts):
                    own = np.zeros((size, width), np.int64)
                    np.add.at(own, codes[:, p], v[:, p * width : (p + 1) * width])
                    total[p] += own
                    count[p] += np.bincount(codes[:, p], minlength=size)
            p, e = np.nonzero(count)
            lists = pa.array([[int(x) for x in total[i, j]] for i, j in zip(p, e)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), lists], ["part", "entry", "n", "s"])

        partial = rows.select("v").mapInArrow(sums, "part int, entry int, n long, s array<long>")
        wide = [F.sum(F.col("s")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(width)]
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *wide).collect():  # parts x entries rows at most
            books[r["part"], r["entry"]] = [int(r[f"s{d}"]) // r["n"] for d in range(width)]
    return books


def books_sha256(books: np.ndarray) -> str:
    """Of all components by part, entry and position, as decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances summed over parts), label_error (errors summed
    over equal labels, nulls together), codebooks_sha256.

    Rows whose vector is null, or holds a null or non-finite component, are left out. Null ids start no codebook while
    others are left; equal ids are taken by their components. All vectors must have the same number of components, a
    multiple of the parts, each under 2^18: anything else is an error. Empty table: empty result. Other columns are not
    read. The codebooks are trained, and the codes written as a table,
    while this is called.
    """
    rows = vectors.select(F.col(id_).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v")).where(usable(F.col("v")))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    books = train(rows)
    digest = books_sha256(books) if books is not None else None

    def run(batches):
        if books is None:
            return
        dims = books.shape[0] * books.shape[2]
        hexed = np.array([f"{k:02x}" for k in range(256)], "S2")
        for b in batches:
            codes, errors = encode(whole_numbers(b.column(2), dims), books)
            code = np.ascontiguousarray(hexed[codes]).view(f"S{2 * len(books)}").ravel() if len(codes) else np.zeros(0, "S2")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.decode() for c in code.tolist()], pa.string()), pa.array(errors.sum(axis=1))], ["vec_id", "label", "code", "error"])

    coded = materialize(rows.mapInArrow(run, f"vec_id {kinds['id']}, label {kinds['label']}, code string, error long"), "codes")
    by = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    return coded.join(by, F.col("label").eqNullSafe(F.col("l")), "left").select("vec_id", "label", "code", "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))
