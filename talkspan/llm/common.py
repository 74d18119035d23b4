"""Shared helpers of the training-data operators: shared-folder tables, Arrow text views, byte ranges."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every byte-level word rule here: space and 0x09-0x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: What parts words of letters and digits: ASCII bytes other than these; bytes from 0x80 on count as letters.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

#: Text handled at once inside a Python worker; temporaries are about 60 times as large.
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a fresh local one where it is unset and there are no
    executors but the driver (tests); on a cluster without that setting there is no such folder, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            path = current.get()
        elif spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            path = "file://" + tempfile.mkdtemp(prefix="talkspan-")
            spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the JVM is gone; nothing can be removed any more
        pass


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """Tables that materialize() writes inside are deleted at the end, but for those made by keep()."""
    _scopes.append([])
    try:
        yield
    finally:
        for df in _scopes.pop():
            discard(df)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and return a read of it."""
    out = keep(df, label)
    if _scopes:
        _scopes[-1].append(out)
    return out


def keep(df: DataFrame, label: str) -> DataFrame:
    """materialize() for a table that outlives the scratch() around it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/talkspan-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove_at_exit, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._talkspan_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() that no later plan reads."""
    path = getattr(df, "_talkspan_path", None)
    if path:
        _remove(df.sparkSession, path)


def doc_key(doc_id: str = "doc_id", text: str = "text"):
    """A non-null order key: doc_id; rows without one follow all others, told apart by their text."""
    tail = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
    return F.coalesce(F.col(doc_id), tail + F.lit(1 << 62))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def keep_rows(docs: DataFrame, keys: dict, kept: DataFrame, once: bool = False) -> DataFrame:
    """Rows of docs whose keys (name to expression) are in kept, which has them as columns; once: equal keys stay once."""
    names = {k: fresh(docs, k) for k in keys}
    own = docs.withColumns({names[k]: c for k, c in keys.items()})
    out = own.join(kept.select(*(F.col(k).alias(n) for k, n in names.items())), list(names.values()), "left_semi")
    return (out.dropDuplicates(list(names.values())) if once else out).drop(*names.values())


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long column `name` that orders documents and tells different texts apart.

    It is doc_key() where no two texts share one. Otherwise rows are numbered in the order of doc_key() and text hash,
    equal rows alike: the ids and hashes are sorted by ranges and written, and a row's number is its place there.
    """
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    ids = docs.select(doc_key().cast("long").alias("k"), h.alias("h"))
    if ids.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").isEmpty():
        return docs.withColumn(name, doc_key().cast("long"))
    table = materialize(ids.distinct().sort("k", "h"), "order")
    files = table.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.min(F.struct("k", "h")).alias("k"), F.count("*").alias("n")).orderBy("k").collect()  # a row a file
    base, n = [], 0
    for r in files:
        base.append((r["f"], n))
        n += r["n"]
    first = docs.sparkSession.createDataFrame(base, "f string, first long")
    number = table.select("k", "h", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).join(first, "f")
    k, t = fresh(docs, "_k"), fresh(docs, "_h")
    number = number.select(F.col("k").alias(k), F.col("h").alias(t), (F.col("first") + F.col("i")).alias(name))
    return docs.withColumns({k: doc_key().cast("long"), t: h}).join(number, [k, t]).drop(k, t)


def row_key() -> dict:
    """What tells documents apart, null and repeated ids included: the order key, and a hash of the text."""
    return {"_key": doc_key().cast("long"), "_hash": F.xxhash64("text")}


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, from one native scan."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def power_of_two(n: float) -> int:
    return 1 << max(0, int(n - 1).bit_length() if n > 1 else 0)


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n+1, int64) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if offs is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def chunks(offs: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges (i, j) whose texts come to about limit bytes; at least one row each."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of all words; a word never crosses a row. between: the bytes that part words."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = ~between[data]
    begin = solid[1:] & ~solid[:-1]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begin[inner] |= solid[inner + 1]
    starts = np.flatnonzero(begin[: len(data)])
    row = np.searchsorted(offs, starts, "right") - 1
    stop = np.flatnonzero(solid[:-1] & ~solid[1:])  # ends at a separator or at the end
    nxt = np.empty(len(starts), np.int64)
    if len(starts):
        nxt[:-1], nxt[-1] = starts[1:], len(data)
        ends = np.minimum(stop[np.minimum(np.searchsorted(stop, starts, "right"), len(stop) - 1)], offs[row + 1])
        ends = np.minimum(ends, nxt)
    else:
        ends = nxt
    return starts, ends, row


def take_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as a binary array."""
    size = ends - starts
    at = np.cumsum(size) - size
    body = data[np.repeat(starts - at, size) + np.arange(int(size.sum()))] if len(size) else data[:0]
    offs = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(body.tobytes())])


def per_row(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def merge_ranges(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of each document, touching or overlapping ranges joined; ordered by document and start."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    _, rank = np.unique(doc, return_inverse=True)
    base = rank.astype(np.int64) << 40
    top = np.maximum.accumulate(end + base)
    new = np.ones(len(doc), bool)
    new[1:] = (start[1:] + base[1:]) > top[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], top[last] - base[last]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and fold), in place on uint64."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x
