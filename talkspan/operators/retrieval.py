"""Exact top-k retrieval by inner product of normalised vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import shared_path

#: Queries that are broadcast at once; more go in blocks.
QUERY_BLOCK = 20_000
#: Scores held at once inside a task.
SCORES = 1 << 22


def normalised(c):
    norm = F.sqrt(T.dot(c, c))
    return F.transform(c, lambda x: F.try_divide(x.cast("double"), norm))


def unit(column) -> np.ndarray:
    """Rows of a list column as unit vectors; null vectors and those without length are zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    if column.null_count or (len(size) and size.min() != size.max()):
        rows = column.to_pylist()
        most = max((len(r) for r in rows if r), default=0)
        x = np.array([r if r else [0.0] * most for r in rows], float).reshape(len(rows), most)
    else:
        x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size[0] if len(size) else 0)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def deal(asked: int, held: int, most_asked: int, most_held: int, least: int, tasks: int) -> tuple[int, int]:
    """Numbers of blocks of two sides: of most_asked and most_held rows at most, with as many pairs of blocks as tasks, but no
    more blocks than leave `least` rows in each;
    of such numbers those that send the fewest rows, if each side is sent once for each block of the other."""
    low, high = -(-asked // most_asked), -(-asked // least)
    tries = []
    for q in range(max(1, low), max(1, low, min(tasks, high)) + 1):
        a = max(1, -(-held // most_held), min(-(-tasks // q), -(-held // least)))
        tries.append((-min(q * a, tasks), asked * a + held * q, q, a))
    return min(tries)[2:]


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 10, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, vec_id, rank, score) of the k nearest others; equal scores (to six places) go by id.

    A stated query set meets all rows, exactly: the queries are read in blocks of QUERY_BLOCK, each is broadcast, every
    batch of rows is multiplied with it and gives out only its own k best a query, and those are merged by a group
    limit. One block is collected while this is called; of more, each is collected, its result written to a table in the
    shared folder, and freed before the next, so the driver holds one block whatever the number of queries.
    """
    shape = "query_id long, vec_id long, score double"
    rows = corpus.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "vec_id", "rank", "score")

    def block(b: int):
        own = queries.where(F.pmod(F.xxhash64(id_), F.lit(blocks)) == b).select(F.col(id_).cast("long").alias("q"), F.col(vector).alias("v")).toArrow()
        return corpus.sparkSession.sparkContext.broadcast((own.column("q").to_numpy(), unit(own.column("v"))))

    def nearest(shared):
        def run(batches):
            ids, q = shared.value
            for batch in batches:
                if not len(ids) or not len(batch):
                    continue
                vec, v = batch.column(0).to_numpy(), unit(batch.column(1))
                step = max(1, SCORES // len(ids))
                for i in range(0, len(vec), step):
                    other = vec[i : i + step]
                    score = np.round(q @ v[i : i + step].T, 6) + 0.0
                    score[ids[:, None] == other[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(other, score.shape), -score), axis=1)[:, :k]
                    top = np.take_along_axis(score, order, axis=1)
                    keep = np.isfinite(top)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, keep.sum(axis=1))), pa.array(other[order][keep]), pa.array(top[keep])], ["query_id", "vec_id", "score"])

        return rows.mapInArrow(run, shape)

    if blocks == 1:
        return best(nearest(block(0)))
    path = shared_path(corpus.sparkSession, "nearest")
    for b in range(blocks):
        shared = block(b)
        best(nearest(shared)).write.parquet(f"{path}/block={b}")
        shared.destroy()
    return corpus.sparkSession.read.schema("query_id long, vec_id long, rank int, score double").parquet(*(f"{path}/block={b}" for b in range(blocks)))


def retrieve_or_keep(top: DataFrame, queries: DataFrame, least: float = 0.3, id_: str = "vec_id") -> DataFrame:
    """query_id, answer_id, retrieved: the best row at or over the least similarity, else the query itself."""
    best = top.where((F.col("rank") == 1) & (F.col("score") >= least)).select("query_id", F.col("vec_id").alias("answer_id"))
    asked = queries.select(F.col(id_).cast("long").alias("query_id"))
    return asked.join(best, "query_id", "left").select("query_id", F.coalesce("answer_id", "query_id").alias("answer_id"), F.col("answer_id").isNotNull().alias("retrieved"))
