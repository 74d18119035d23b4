"""An index for nearest vectors by cosine: cells by k-means, product codes of residuals, exact scores for what may count.

The index is a folder of tables: centroids, codebooks, and the rows, partitioned by cell, with their codes, the length of
what the codes miss, and the vectors. A search sends each query to the blocks that hold its nearest cells. There a cell is
left out for a query if the radius of the cell shows that none of its rows reaches the k-th best so far; the rows of other
cells are scored exactly, as matrix products, and a block gives out k rows a query. So the answer is exact among the cells
that were probed, and with all cells it is exact. The codes are for readers that hold no vectors: as bounds they keep out too
few rows of vectors that hardly cluster, and to look them up costs more than a product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .retrieval import deal, unit

#: Rows of the sample that centroids and codebooks are fitted on, by cell; a documented bound, every row is indexed.
SAMPLE_PER_CELL = 64
MOST_CELLS = 4096
PARTS, ENTRIES = 16, 256
#: Rows of a block and queries that meet at once in a task, at most; fewer where vectors are long (NUMBERS components a side)
#: and where tasks would be few.
ROW_BLOCK, QUERY_BLOCK, NUMBERS = 65_536, 65_536, 1 << 22
LEAST_BLOCK = 256
#: Scores held at once inside a task, and the queries that they are of.
SCORES, QUERY_STEP = 1 << 20, 2048
#: Scores are compared after rounding to six places; bounds are this much wider.
SLACK = 2e-6


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of each row, in blocks."""
    half = (centres * centres).sum(axis=1) / 2
    step = max(1, (1 << 22) // len(centres))
    return np.concatenate([(half - x[i : i + step] @ centres.T).argmin(axis=1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


def _lloyd(rows: DataFrame, split, start: np.ndarray, rounds: int) -> np.ndarray:
    """Lloyd's rounds as Spark jobs. start: (groups, centres, width); split: batch to (groups, rows, width). Tasks send sums
    and counts by centre; centres without rows stay."""
    centres = start
    groups, many, width = start.shape
    for _ in range(rounds):

        def sums(batches, centres=centres):
            total, count = np.zeros(centres.shape), np.zeros(centres.shape[:2], np.int64)
            for b in batches:
                for g, x in enumerate(split(b)):
                    own = _nearest(x, centres[g])
                    np.add.at(total[g], own, x)
                    count[g] += np.bincount(own, minlength=many)
            g, c = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(c, pa.int32()), pa.array(count[g, c]), pa.array(list(total[g, c]), pa.list_(pa.float64()))], ["g", "c", "n", "s"])

        parts = rows.mapInArrow(sums, "g int, c int, n long, s array<double>")
        means = parts.select("g", "c", "n", F.posexplode("s").alias("d", "x")).groupBy("g", "c", "d").agg((F.sum("x") / F.sum("n")).alias("x"))
        got = means.toArrow()  # groups x centres x width numbers, whatever the table
        centres = centres.copy()
        centres[tuple(got.column(c).to_numpy() for c in ("g", "c", "d"))] = got.column("x").to_numpy()
    return centres


def _sample(rows: DataFrame, n: int, most: int) -> DataFrame:
    """About `most` of n rows, by a hash of the id."""
    share = min(1.0, 1.5 * most / max(n, 1))
    return rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)


def write_index(corpus: DataFrame, path: str, id_: str = "vec_id", vector: str = "embedding", metadata: list[str] = (), cells: int | None = None, rounds: int = 3) -> None:
    """Write the index of a corpus under path. metadata: columns that searches give back with a row.

    cells: the square root of the number of rows unless stated, MOST_CELLS at most. Centroids and codebooks are fitted on
    about SAMPLE_PER_CELL rows a cell. Null vectors and those without length score 0 with all others, as in top_k(). Rows
    without an id are left out, ids are unique. An empty corpus gives an empty index.
    """
    spark = corpus.sparkSession
    rows = corpus.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), *metadata)
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    n, dims = facts["n"], max(facts["dims"] or 1, 1)
    cells = cells or max(1, min(MOST_CELLS, round(n**0.5)))
    sample = _sample(rows, n, cells * SAMPLE_PER_CELL).select("id", "v")
    first = sample.orderBy(F.xxhash64("id", F.lit("start")), "id").limit(max(cells, ENTRIES)).select("v").toArrow()  # a row a cell
    start = _padded(first.column("v"), dims) if first.num_rows else np.zeros((1, dims))
    take = lambda b: _padded(b.column("v"), dims)[None]
    centres = _lloyd(sample, take, start[None, :cells], rounds)[0]
    width = -(-dims // PARTS)

    def residuals(x, own):
        r = np.zeros((len(x), PARTS * width))
        r[:, :dims] = x - centres[own]
        return r.reshape(len(x), PARTS, width).transpose(1, 0, 2)

    def split(b):
        x = _padded(b.column("v"), dims)
        return residuals(x, _nearest(x, centres))

    books = _lloyd(sample, split, residuals(start, _nearest(start, centres))[:, :ENTRIES].copy(), rounds)

    def encode(batches):
        for b in batches:
            x = _padded(b.column("v"), dims)
            own = _nearest(x, centres)
            r = residuals(x, own)
            codes = np.stack([_nearest(r[p], books[p]) for p in range(PARTS)], axis=1).astype(np.uint8)
            missed = sum(((r[p] - books[p][codes[:, p]]) ** 2).sum(axis=1) for p in range(PARTS)) ** 0.5
            code = [c.tobytes() for c in codes]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(code, pa.binary()), pa.array(missed + 1e-9), *b.columns], ["cell", "code", "missed", *b.schema.names])

    shape = ", ".join(["cell int, code binary, missed double", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)])
    coded = rows.mapInArrow(encode, shape)
    coded.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/rows")  # large cells are split, small ones merged
    spark.createDataFrame([(shape,)], "schema string").coalesce(1).write.parquet(f"{path}/schema")
    spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, v array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    flat = [(p, e, books[p, e].tolist()) for p in range(PARTS) for e in range(books.shape[1])]
    spark.createDataFrame(flat, "part int, entry int, v array<double>").coalesce(1).write.parquet(f"{path}/codebooks")


def _padded(column, dims: int) -> np.ndarray:
    x = unit(column)
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """id, v, metadata, cell, code and missed of every row of an index."""
    return spark.read.schema(spark.read.parquet(f"{path}/schema").first()["schema"]).parquet(f"{path}/rows")


def _blocks(sizes: list[tuple[int, int]], most: int) -> tuple[list[tuple[int, int, int]], int]:
    """(cell, n) to (cell, its first block, its number of blocks), and the number of blocks: small cells share one of `most`
    rows, a larger cell has several of its own."""
    out, block, room = [], -1, 0
    for cell, n in sizes:
        if n <= room:
            out.append((cell, block, 1))
            room -= n
            continue
        many = -(-n // most)
        out.append((cell, block + 1, many))
        block, room = block + many, (most - n if many == 1 else 0)
    return out, block + 1


def _few_copies(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows but those that have k + 1 equal rows of smaller ids: these can't be among the k best."""
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)
    order = np.lexsort((ids, same))
    starts = np.flatnonzero(np.diff(same[order], prepend=-1))
    rank = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    return np.sort(order[rank <= k])


class _Best:
    """The k best (score, id) of each of n queries so far, and the score that a further row must reach."""

    def __init__(self, n: int, k: int, least: float):
        self.k, self.n, self.new = k, n, 0
        self.bar = np.full(n, least)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))]

    def add(self, *found) -> None:
        self.held.append(found)
        self.new += len(found[0])
        if self.new > 2 * self.k * self.n or not np.isfinite(self.bar).all():
            self.settle()

    def settle(self) -> tuple:
        row, ids, score, cell = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((ids, -score, row))
        row = row[order]
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
        last = rank == self.k - 1
        self.bar[row[last]] = np.maximum(self.bar[row[last]], score[order[last]])
        order, row = order[rank < self.k], row[rank < self.k]
        self.held, self.new = [(row, ids[order], score[order], cell[order])], 0
        return self.held[0]


def _nearest_rows(x, ids, cell, q, who, allowed, centres, k, least):
    """(query, id, score, cell) of the k best rows of a block for each query. allowed: queries by cells, or None for all."""
    kept = _few_copies(x, ids, k)
    kept = kept[np.argsort(cell[kept], kind="stable")]
    x, ids, cell = x[kept], ids[kept], cell[kept]
    cells, first = np.unique(cell, return_index=True)
    ends = np.append(first[1:], len(cell))
    radius = np.sqrt(np.maximum.reduceat(((x - centres[cell]) ** 2).sum(axis=1), first)) + 1e-9
    towards = q @ centres[cells].T
    near = np.argsort(towards.argmax(axis=1), kind="stable")  # queries of one step share their nearest cells
    for i in range(0, len(q), QUERY_STEP):
        own = near[i : i + QUERY_STEP]
        best, high = _Best(len(own), k, -np.inf if least is None else least), towards[own] + radius
        for c in np.argsort(-high.mean(axis=0), kind="stable"):
            can = high[:, c] >= best.bar - SLACK
            if allowed is not None:
                can &= allowed[own, cells[c]]
            live = np.flatnonzero(can)
            if not len(live):
                continue
            step = max(1, SCORES // len(live))
            for j in range(first[c], ends[c], step):
                e = min(j + step, ends[c])
                score = q[own[live]] @ x[j:e].T
                bar = best.bar[live]
                if e - j > k + 1 and not np.isfinite(bar).all():  # one more than k, as a query may meet itself
                    bar = np.maximum(bar, np.partition(score, e - j - k - 1, axis=1)[:, e - j - k - 1])
                a, b = np.nonzero(score >= bar[:, None] - SLACK)
                other = who[own[live[a]]] != ids[j + b]
                a, b = a[other], b[other]
                best.add(live[a], ids[j + b], np.round(score[a, b], 6) + 0.0, np.full(len(a), cells[c], np.int32))
        row, found, score, of = best.settle()
        ok = slice(None) if least is None else score >= least
        yield who[own[row]][ok], found[ok], score[ok], of[ok]


def search(queries: DataFrame, path: str, k: int = 10, probes: int | None = None, least: float | None = None, id_: str = "vec_id", vector: str = "embedding", metadata: list[str] = ()) -> DataFrame:
    """query_id, vec_id, rank, score and metadata of the k nearest rows of an index; equal scores (to six places) go by id.

    probes: cells a query is sent to, the nearest first; all of them unless stated. least: rows that score less are left
    out. A query's own id is no answer. Queries have as many components as the rows, or are null. Work goes by (block of rows, block of queries): small cells share a block and a large one has several, so neither a
    large cell nor many queries fall to one task. A row is sent once for each block of queries, a query once for each
    block of rows it probes, in such numbers of blocks that the fewest are sent; a task gives out k rows a query at most.
    """
    spark = queries.sparkSession
    centres = np.array([r["v"] for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()])  # MOST_CELLS rows at most
    dims = centres.shape[1]
    rows = read_rows(spark, path)
    asked = queries.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("query_id"), F.col(vector).cast("array<float>").alias("q"))
    sizes = sorted((r["cell"], r["n"]) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect())  # a row a cell
    if not sizes:
        extra = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in metadata)
        return spark.createDataFrame([], f"query_id long, vec_id long, rank int, score double{extra}")
    most, n_rows, n_asked = max(1, NUMBERS // dims), sum(n for _, n in sizes), asked.count()
    of_q, of_rows = deal(n_asked, n_rows, min(QUERY_BLOCK, most), min(ROW_BLOCK, most), LEAST_BLOCK, 4 * spark.sparkContext.defaultParallelism)
    placed, many = _blocks(sizes, -(-n_rows // of_rows))
    visits = None if probes is None or probes >= len(centres) else probes
    if visits is None:
        sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    else:
        holds = {cell: range(start, start + n) for cell, start, n in placed}

        def send(batches):
            for b in batches:
                x = _padded(b.column("q"), dims)
                closest = np.argsort((centres * centres).sum(axis=1) / 2 - x @ centres.T, axis=1, kind="stable")[:, :visits]
                goes = [(i, block) for i, c in enumerate(closest.tolist()) for block in sorted({n for cell in c for n in holds.get(cell, ())})]
                at, block = (np.array(goes, np.int64).reshape(-1, 2)).T
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("q").take(at), pa.array(block.astype(np.int32))], ["query_id", "q", "block"])

        sent = asked.mapInArrow(send, "query_id long, q array<float>, block int")
    plan = F.broadcast(spark.createDataFrame(placed, "cell int, start int, many int"))  # a row a cell, MOST_CELLS at most
    block = (F.col("start") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int")
    left = rows.select("cell", "id", "v").join(plan, "cell").select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(of_q - 1))).alias("qb"), "cell", "id", "v")
    right = sent.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(of_q)).cast("int")).select("block", "qb", "query_id", "q")

    def nearest(own: pa.Table, asks: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and asks.num_rows:
            q, allowed = _padded(asks.column("q"), dims), None
            if visits is not None:
                closest = np.argsort((centres * centres).sum(axis=1) / 2 - q @ centres.T, axis=1, kind="stable")[:, :visits]
                allowed = np.zeros((len(q), len(centres)), bool)
                np.put_along_axis(allowed, closest, True, axis=1)
            out = list(_nearest_rows(_padded(own.column("v"), dims), own.column("id").to_numpy(), own.column("cell").to_numpy(), q, asks.column("query_id").to_numpy(), allowed, centres, k, least))
        kinds = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64, "cell": np.int32}
        return pa.table({c: pa.array(np.concatenate([o[n] for o in out]) if out else np.zeros(0), pa.from_numpy_dtype(t)) for n, (c, t) in enumerate(kinds.items())})

    keys = ["block", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, "query_id long, vec_id long, score double, cell int")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if metadata:
        out = out.join(rows.select("cell", F.col("id").alias("vec_id"), *metadata), ["cell", "vec_id"])
    return out.select("query_id", "vec_id", "rank", "score", *metadata)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact answers (query_id, vec_id) that were found."""
    hit = exact.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """cell, n: the rows of each cell of an index."""
    return read_rows(spark, path).groupBy("cell").agg(F.count("*").alias("n"))
