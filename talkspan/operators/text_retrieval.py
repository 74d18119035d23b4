"""Best answers by the words of texts: the largest cosine of TF-IDF weights at or over a threshold, by blocks.

Texts are sets of keywords, each word weighs its inverse document frequency among the answers, and the similarity of two
texts is the cosine of their weights. Texts with the same words are one class. Blocks of query classes, each packed into one
row, meet those of answer classes as a Cartesian product of these rows, one pair of blocks a task, so that no class is written
to disk once for each block of the other side. Inside a task, words that many texts of both have are multiplied as dense columns, all others by their
postings. Such scores are single precision; only answers that may still count are scored exactly, and a task gives out the
best two owners of each query. So no pair of texts is ever a row, however low the threshold and however common the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import shared_path
from .retrieval import deal

#: Classes of a block at most, of queries and of answers; fewer where tasks would be few.
BLOCK, LEAST_BLOCK = 16_384, 256
#: A word is a dense column where this share of all pairs of a task has it, for so many words at most.
DENSE_SHARE, DENSE = 0.0025, 256
#: Scores, and products of postings, held at once inside a task.
SCORES = 1 << 22


#: Shuffle files go when the statement that made them ends, not when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """rows as a table in the shared folder: they are used more than once. Nothing else of them stays on disk."""
    path, before = shared_path(spark, label), spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        rows.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)
    return spark.read.schema(rows.schema).parquet(path)


def _classes(rows: DataFrame) -> DataFrame:
    """rows (id, owner, key) by class: key, and with it the least ids of two owners at most."""
    first = rows.groupBy("key", "owner").agg(F.min("id").alias("id"))
    w = Window.partitionBy("key").orderBy("id")
    return first.withColumn("r", F.row_number().over(w)).where("r <= 2")


def _weighted(rows: DataFrame, frequency: DataFrame, total: int) -> DataFrame:
    """The classes of rows (key, words): key, length, and the ids and counts of those words that answers have."""
    classes = rows.groupBy("key").agg(F.any_value(F.array_join("words", " ")).alias("words"))  # a text is shorter than an array
    each = classes.select("key", F.explode(F.split("words", " ")).alias("word")).join(frequency, "word")
    terms = F.array_sort(F.collect_list(F.struct("n", "word_id"))).alias("terms")
    square = F.aggregate("terms", F.lit(0.0), lambda a, t: a + F.pow(F.log((total + 1) / (t["n"] + 1) + 1), F.lit(2)))
    return each.groupBy("key").agg(terms).select("key", F.sqrt(square).alias("length"), F.col("terms.word_id").alias("ids"), F.col("terms.n").alias("counts"))


def _packed(rows: DataFrame, many: int, name: str) -> DataFrame:
    """rows by blocks, a row each: block, and in `name` all rows of the block as a compressed Arrow stream."""

    def pack(own: pa.Table) -> pa.Table:
        sink, block = pa.BufferOutputStream(), own.column("block")[0]
        with pa.ipc.new_stream(sink, (kept := own.drop_columns("block")).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(kept)
        return pa.table({"block": pa.array([block.as_py()], pa.int32()), name: pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(many)).cast("int"))
    return dealt.groupBy("block").applyInArrow(pack, f"block int, {name} binary")


def _entries(table: pa.Table, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of all rows: row, id of the word and squared weight; and the length of each row."""
    ids, counts = table.column("ids").combine_chunks(), table.column("counts").combine_chunks()
    rows = np.repeat(np.arange(len(table)), pc.list_value_length(ids).to_numpy(zero_copy_only=False))
    square = np.log((total + 1) / (counts.flatten().to_numpy() + 1) + 1) ** 2
    return rows, ids.flatten().to_numpy(), square, table.column("length").to_numpy()


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges from starts of sizes, one range after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _nearest(asks: pa.Table, own: pa.Table, total: int, least: float):
    """(place in asks, place in own, score) of the best answers of two owners for each query of a block, from `least` on."""
    arow, aword, asq, alen = _entries(own, total)
    qrow, qword, qsq, qlen = _entries(asks, total)
    names, owner = own.column("id").to_numpy(), own.column("owner").combine_chunks().dictionary_encode().indices.to_numpy()
    place = np.argsort(owner, kind="stable")  # answers of an owner become neighbours
    seat = np.empty_like(place)
    seat[place] = np.arange(len(place))
    names, owner, alen = names[place], owner[place], alen[place]
    words, aword = np.unique(aword, return_inverse=True)
    by_row = np.argsort(seat[arow], kind="stable")
    arow, aword, asq = seat[arow][by_row], aword[by_row], asq[by_row]
    at = np.minimum(np.searchsorted(words, qword), len(words) - 1)
    known = words[at] == qword
    qrow, qword, qsq = qrow[known], at[known], qsq[known]
    in_a, in_q = np.bincount(aword, minlength=len(words)), np.bincount(qword, minlength=len(words))
    shares = in_a * in_q / (len(own) * len(asks))
    dense = np.argsort(-shares, kind="stable")[:DENSE]
    dense = dense[shares[dense] > DENSE_SHARE]
    column = np.full(len(words), -1)
    column[dense] = np.arange(len(dense))
    aval, qval = (np.sqrt(asq) / alen[arow]).astype(np.float32), (np.sqrt(qsq) / qlen[qrow]).astype(np.float32)
    common = column[aword] >= 0
    matrix = np.zeros((len(own), len(dense)), np.float32)
    matrix[arow[common], column[aword[common]]] = aval[common]
    rare = np.flatnonzero(~common)
    rare = rare[np.argsort(aword[rare], kind="stable")]
    post_row, post_val = arow[rare].astype(np.int32), aval[rare]
    size = np.bincount(aword[rare], minlength=len(words))
    first = np.cumsum(size) - size
    a_from, q_from = np.searchsorted(arow, np.arange(len(own) + 1)), np.searchsorted(qrow, np.arange(len(asks) + 1))
    # a sum of n products of single precision is out by n + 3 half units of its last place at most, as both sides have length 1
    most = int(max(np.diff(q_from).max(initial=0), 1))
    slack = 1e-6 + 2 * (most + len(dense) + 8) * 2.0**-24
    weight = np.zeros(len(words))
    step = max(1, SCORES // len(own))
    for i in range(0, len(asks), step):
        j = min(i + step, len(asks))
        e = slice(q_from[i], q_from[j])
        row, word, val = qrow[e] - i, qword[e], qval[e]
        asked = np.zeros((j - i, len(dense)), np.float32)
        common = column[word] >= 0
        asked[row[common], column[word[common]]] = val[common]
        score = asked @ matrix.T
        row, word, val = row[~common], word[~common], val[~common]
        n = size[word]
        ends = np.cumsum(n)
        flat = score.reshape(-1)
        k = 0
        while k < len(n):
            m = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + SCORES, "right")))
            p = _spans(first[word[k:m]], n[k:m])
            np.add.at(flat, np.repeat(row[k:m] * len(own), n[k:m]) + post_row[p], np.repeat(val[k:m], n[k:m]) * post_val[p])
            k = m
        top = score.argmax(axis=1)
        for r in np.flatnonzero(score[np.arange(j - i), top] >= least - slack):
            mine = score[r]
            a, b = np.searchsorted(owner, owner[top[r]]), np.searchsorted(owner, owner[top[r]], "right")
            second = max(mine[:a].max(initial=-1), mine[b:].max(initial=-1))  # the best of another owner
            found = np.flatnonzero(mine >= max(second, least) - slack)
            n = a_from[found + 1] - a_from[found]
            e = slice(q_from[i + r], q_from[i + r + 1])
            weight[qword[e]] = qsq[e]
            exact = np.add.reduceat(weight[aword[_spans(a_from[found], n)]], np.cumsum(n) - n)
            weight[qword[e]] = 0
            found, exact = found[exact > 0], exact[exact > 0]
            if not len(found):
                continue
            exact = np.round(exact / (qlen[i + r] * alen[found]), 6)
            order = np.lexsort((names[found], -exact))
            other = np.flatnonzero(owner[found[order]] != owner[found[order[0]]])[:1]
            for o in order[np.concatenate([[0], other]).astype(int)]:
                if exact[o] >= least:
                    yield i + r, place[found[o]], exact[o]


def best_answers(queries: DataFrame, answers: DataFrame, least: float = 0.3) -> DataFrame:
    """queries and answers (id, owner, text) to id, answer_id, score: of each query the answer of another owner that is
    most similar, at `least` or over (to six places); equal ones go by id. Queries without one are left out.

    Texts without keywords answer nothing; words that no answer has weigh nothing. Null owners are one owner, rows with a
    null id are left out. Copies are compared once: classes of equal word sets meet, those of answers by the least ids of
    two owners. Classes are packed into blocks once, and a task reads one block of each side; work is queries x answers, in
    tasks of bounded size. The word sets, weights and blocks are written to the shared folder while this is called.
    """
    words = F.array_sort(F.array_distinct(T.keywords(F.coalesce("text", F.lit("")))))
    own = lambda rows: rows.where("id is not null").select("id", F.coalesce(F.col("owner").cast("string"), F.lit("")).alias("owner"), words.alias("words")).where("size(words) > 0").withColumn("key", F.unhex(F.md5(F.array_join("words", " "))))
    spark = answers.sparkSession
    written = lambda rows, label: _written(spark, rows, label)
    asked, held = written(own(queries), "asked"), written(own(answers), "held")
    n_held = held.count()
    frequency = held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    frequency = written(frequency.withColumn("word_id", F.monotonically_increasing_id()), "frequency")
    a = written(_classes(held).join(_weighted(held, frequency, n_held), "key"), "answers")
    q = written(_weighted(asked, frequency, n_held), "queries")
    of_q, of_a = deal(q.count(), a.count(), BLOCK, BLOCK, LEAST_BLOCK, 4 * spark.sparkContext.defaultParallelism)
    left = written(_packed(q, of_q, "asks"), "asks").repartitionById(of_q, "block").select("asks")
    right = written(_packed(a, of_a, "own"), "own").repartitionById(of_a, "block").select("own")

    def nearest(batches):
        for batch in batches:
            for packed in zip(batch.column("asks"), batch.column("own")):
                asks, own = (pa.ipc.open_stream(p.as_buffer()).read_all() for p in packed)
                got = list(_nearest(asks, own, n_held, least))
                x, y, score = zip(*got) if got else ((), (), ())
                x, y = pa.array(x, pa.int64()), pa.array(y, pa.int64())
                found = {"q": asks.column("key").take(x), "from": own.column("owner").take(y), "answer_id": own.column("id").take(y), "score": pa.array(score, pa.float64())}
                yield from pa.table(found).combine_chunks().to_batches()

    pairs = left.crossJoin(right.hint("shuffle_replicate_nl"))  # of blocks: a task reads one of each, and nothing is sent
    found = pairs.mapInArrow(nearest, f"q binary, `from` string, answer_id {a.schema['id'].dataType.simpleString()}, score double")
    # of each query class the best answer of each owner, and of those the best two: one of them is of another owner
    best = lambda: F.max_by(F.struct("answer_id", "score"), F.struct(F.col("score"), -F.col("answer_id"))).alias("b")
    by = found.groupBy("q", "from").agg(best()).select("q", "from", "b.*")
    w = Window.partitionBy("q").orderBy(F.col("score").desc(), "answer_id")
    two = by.withColumn("r", F.row_number().over(w)).where("r <= 2")
    out = asked.select("id", "owner", F.col("key").alias("q")).join(two, "q").where(F.col("owner") != F.col("from"))
    return out.groupBy("id").agg(F.min_by(F.struct("answer_id", "score"), "r").alias("b")).select("id", "b.answer_id", "b.score")
