"""Training-order materialisation: fixed-stride shards of token ids in a keyed global order.

Every document becomes sequences of `length` ids (16-bit, little-endian; the last is filled up with the end id). The
sequences are written once, numbered by file and row of that table, and a Feistel permutation with cycle-walking maps
number to slot. Slot ranges are the partitions: each is one shard whose records have a fixed stride (the ids and a line
feed, as write_shards() writes them), so a reader finds slot s at shard s // per_shard, byte (s % per_shard) * stride,
and resumes anywhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize
from .tokens import END, encoder

LENGTH = 512
PER_SHARD = 16_384
ROUNDS = 6


def stride(length: int = LENGTH) -> int:
    """Bytes of a record in a shard's file."""
    return 2 * length + 1


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def permute(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of range(n): Feistel rounds on the least even number of bits, walked until inside the range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    rng = np.random.default_rng(key)
    keys = [int(k) for k in rng.integers(0, 2**63, ROUNDS)]
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for k in keys:
            left, right = right, left ^ (_round(right, k) & mask)
        y = (left << np.uint64(half)) | right
        x[todo] = y
        todo = todo[y >= np.uint64(n)]
    return x.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """doc_id, sequence, n_tokens, body (compressed 16-bit ids) of every document, null text as empty."""

    def run(batches):
        enc, press = encoder(vocabulary, ranks), zstandard.ZstdCompressor(level=1, write_content_size=True)
        for b in batches:
            doc, seq, size, body = [], [], [], []
            for d, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.array(text)
                if len(ids) and int(ids.max()) > 0xFFFF:
                    raise ValueError("an id of this vocabulary does not fit 16 bits")
                ids = ids.astype("<u2")
                for k in range(0, len(ids), length):
                    part = ids[k : k + length]
                    doc.append(d)
                    seq.append(k // length)
                    size.append(len(part))
                    body.append(press.compress(part.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(seq, pa.int32()), pa.array(size, pa.int32()), pa.array(body, pa.binary())], ["doc_id", "sequence", "n_tokens", "body"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sequence int, n_tokens int, body binary")


def training_order(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = 20_240_601, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Rows in training order: shard, slot, byte_offset, doc_id, sequence, n_tokens, ids (binary of 2 * length bytes).

    Slots are 0 .. n-1, each once; partition k holds shard k, ordered. Numbers before the permutation follow the files
    and rows of the sequence table, which is written once, so a recomputed task makes the same records. Null text is a
    sequence of the end id; null doc_ids pass through; repeated rows give repeated sequences. Empty table: empty
    result. Only doc_id and text are read. byte_offset is the record's place in the shard's file of write_shards(). An
    id over 65,535 is an error. The sequence table is written while this is called.
    """
    table = materialize(sequences(docs, length, vocabulary, ranks), "sequences")
    files = [(r["f"], r["n"]) for r in table.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).orderBy("f").collect()]  # a row a file
    base, n = {}, 0
    for f, count in files:
        base[f], n = n, n + count
    offsets = table.sparkSession.createDataFrame(list(base.items()), "file string, first long")
    total = n

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), total, key))

    numbered = table.select("doc_id", "sequence", "n_tokens", "body", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    small = F.broadcast(offsets) if len(base) <= 100_000 else offsets  # a row a file of the sequence table
    slots = numbered.join(small, "file").withColumn("slot", slot_of(F.col("first") + F.col("row"))).withColumn("shard", F.expr(f"int(slot div {per_shard})"))
    shards = max(1, -(-n // per_shard))
    dealt = slots.select("shard", "slot", "doc_id", "sequence", "n_tokens", "body").repartitionById(shards, F.col("shard")).sortWithinPartitions("slot")

    def unpack(batches):
        press, end = zstandard.ZstdDecompressor(), np.full(length, END, "<u2").tobytes()
        for b in batches:
            slot = b.column(1).to_numpy()
            ids = [(press.decompress(x) + end)[: 2 * length] for x in b.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(slot % per_shard * stride(length)), b.column(2), b.column(3), b.column(4), pa.array(ids, pa.binary())], ["shard", "slot", "byte_offset", "doc_id", "sequence", "n_tokens", "ids"])

    return dealt.mapInArrow(unpack, "shard int, slot long, byte_offset long, doc_id long, sequence int, n_tokens int, ids binary")


def write_shards(order: DataFrame, path: str) -> None:
    """One raw file a shard under path/shard=k: records of 2 * length bytes and a closing line feed (the stride).

    The bytes go through Spark's own writer, so any store it reaches will do, and a retried task replaces its file.
    """
    order.select("shard", F.col("ids").cast("string").alias("value")).write.partitionBy("shard").option("compression", "none").option("lineSep", "\n").text(path)


def read_shard(spark: SparkSession, path: str, shard: int, length: int = LENGTH, first: int = 0) -> np.ndarray:
    """Records first.. of one shard as an array (n, length); the driver reads one shard, whose size is fixed."""
    files = spark.read.format("binaryFile").load(f"{path}/shard={shard}").orderBy("path").select("content").collect()
    body = np.frombuffer(b"".join(bytes(r["content"]) for r in files)[first * stride(length) :], np.uint8)
    return np.ascontiguousarray(body.reshape(-1, stride(length))[:, :-1]).view("<u2")
