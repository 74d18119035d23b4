"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - score): one score from hashed-text weights, shared by all grades, and ordered
thresholds. Features are the distinct hashed words of a text and the shares of its word endings. The model is fitted
on at most MAX_LABELLED rated documents (by hash of doc_id), a bounded sample; all documents are scored whole.

Features of the rated documents are written as a table. What a feature's occurrences say is summed there by grade (a
row a feature, so a bounded number), at most MAX_FEATURES of those that lean to or from some grade are learned, and only
these go to the driver: at most MAX_LABELLED * MAX_FEATURES values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, mix, raw, word_spans

WORD_BUCKETS = 1 << 17
ENDING_BUCKETS = 1 << 12
MAX_LABELLED = 6000
#: A feature is learned if it occurs in this many rated documents and leans to or from some grade by SIGMAS deviations.
MIN_DOCUMENTS = 8
SIGMAS = 6.0
#: The most features learned, those that lean most before others.
MAX_FEATURES = 4096
#: Selection: least probability of a grade of 2 or more of 0..2 (good and harmless).
SELECT_FROM = 2
SELECT_AT = 0.5
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_power = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    """_BASE to the power of 0, 1, .. n - 1, modulo 2**64."""
    global _power
    while len(_power) < n:
        _power = np.concatenate([_power, _power * np.uint64(pow(_BASE, len(_power), 1 << 64))])
    return _power[:n]


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all texts, rows ascending; null texts have none."""
    data, offs = raw(texts)
    rows, feats, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for i, j in chunks(offs):
        d, o = _LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
        starts, ends, row = word_spans(d, o)
        if not len(starts):
            continue
        # hash of a word: polynomial of all its bytes (sums of byte times power between two places of the text)
        size = ends - starts
        power = _powers(int(size.max()))
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        term = (d[np.repeat(starts, size) + place].astype(np.uint64) + np.uint64(1)) * power[place]
        h = np.add.reduceat(term, np.cumsum(size) - size)
        tail = np.zeros(len(starts), np.uint64)
        for b in range(3):
            tail = tail * np.uint64(257) + np.where(size > b, d[np.maximum(ends - 1 - b, 0)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        word = (mix(h) % np.uint64(WORD_BUCKETS)).astype(np.int64)
        ending = (mix(tail) % np.uint64(ENDING_BUCKETS)).astype(np.int64) + WORD_BUCKETS
        total = WORD_BUCKETS + ENDING_BUCKETS
        pairs = np.unique(row * total + word)
        tails, n = np.unique(row * total + ending, return_counts=True)
        count = np.bincount(row, minlength=j - i)
        code = np.concatenate([pairs, tails])
        value = np.concatenate([np.ones(len(pairs)), 8.0 * n / count[tails // total]])
        order = np.argsort(code, kind="stable")
        rows.append(code[order] // total + i)
        feats.append(code[order] % total)
        values.append(value[order].astype(np.float32))
    return np.concatenate(rows), np.concatenate(feats), np.concatenate(values)


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. of each score."""
        return 1.0 - _logistic(self.thresholds[None, :] - score[:, None])

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, feat, value = features(texts)
        return np.bincount(row, self.weights[feat] * value, minlength=len(texts))

    @staticmethod
    def fit(row, feat, value, grade: np.ndarray, grades: int, steps: int = 150, rate: float = 0.3, decay: float = 2e-3) -> Model:
        """Adaptive gradient ascent of the ordinal likelihood; weights of features that do not occur stay zero."""
        size = WORD_BUCKETS + ENDING_BUCKETS
        n = len(grade)
        w, seen = np.zeros(size), np.full(size, 1e-8)
        share = np.array([(grade < k).mean() for k in range(1, grades)]).clip(0.01, 0.99)
        first = np.log(share / (1 - share))
        gap = np.log(np.maximum(np.diff(first), 1e-2))
        theta = np.concatenate([first[:1], gap])
        seen_t = np.full(len(theta), 1e-8)
        for _ in range(steps):
            cut = np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))
            score = np.bincount(row, w[feat] * value, minlength=n)
            edge = np.concatenate([[-40.0], cut, [40.0]])
            up, low = _logistic(edge[grade + 1] - score), _logistic(edge[grade] - score)
            p = np.maximum(up - low, 1e-9)
            du, dl = up * (1 - up) / p, low * (1 - low) / p
            g = np.bincount(feat, ((dl - du) / n)[row] * value, minlength=size) - decay * w
            seen += g * g
            w += rate * g / np.sqrt(seen)
            gc = np.array([(du[grade == k].sum() - dl[grade == k + 1].sum()) / n for k in range(grades - 1)])
            gt = np.concatenate([[gc.sum()], [gc[k:].sum() * np.exp(theta[k]) for k in range(1, grades - 1)]])
            seen_t += gt * gt
            theta += 0.1 * gt / np.sqrt(seen_t)
        return Model(w.astype(np.float32), np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])))


def grade_column():
    """0 harmful, 1 poor, 2 good."""
    return F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)


def leaning(counts: dict[int, np.ndarray], totals: np.ndarray) -> np.ndarray:
    """The features to learn. counts: documents of each grade that have the feature; totals: documents of each grade."""
    if not counts:
        return np.zeros(0, np.int64)
    feat, by = np.array(list(counts), np.int64), np.array(list(counts.values()), float)
    n = by.sum(axis=1)
    p = np.clip(totals / totals.sum(), 1e-3, 1 - 1e-3)
    lean = (np.abs(by - n[:, None] * p) / np.sqrt(np.maximum(n, 1)[:, None] * p * (1 - p))).max(axis=1)
    often = (n >= MIN_DOCUMENTS) & (lean >= SIGMAS)
    feat, lean = feat[often], lean[often]
    return np.sort(feat[np.lexsort((feat, -lean))[:MAX_FEATURES]])


def rated_documents(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, share: float = 1.0, held_out: bool = False) -> DataFrame:
    """text, grade of at most limit rated documents of the first `share` by hash of doc_id, or of the rest if held_out.

    A document rated twice takes its worst ratings; of rows that repeat a doc_id the text with the least hash counts.
    """
    rated = labels.where(F.col("quality").isNotNull() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    inside = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(1000)) < int(1000 * share)
    chosen = rated.where(~inside if held_out else inside).withColumn("_o", F.xxhash64("doc_id")).orderBy("_o", "doc_id").limit(limit)  # bounded by limit
    own = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return own.groupBy("doc_id").agg(F.min_by(F.struct("text", grade_column().alias("grade")), F.xxhash64("text")).alias("r")).select("r.text", "r.grade")


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, share: float = 1.0) -> Model | None:
    """A model from at most limit rated documents; None if fewer than two grades occur. share < 1 holds out the rest."""

    def run(batches):
        for b in batches:
            row, feat, value = features(b.column(0))
            at = pa.array(np.searchsorted(row, np.arange(len(b) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.ListArray.from_arrays(at, pa.array(feat.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value))], ["grade", "feats", "vals"])

    rows = rated_documents(docs, labels, limit, share)
    table = materialize(rows.mapInArrow(run, "grade int, feats array<int>, vals array<float>"), "rated")
    totals = np.zeros(3, np.int64)
    for r in table.groupBy("grade").agg(F.count("*").alias("n")).collect():  # a row a grade
        totals[r["grade"]] = r["n"]
    if (totals > 0).sum() < 2:
        return None
    by = table.select("grade", F.explode("feats").alias("feat")).groupBy("feat").agg(*(F.count_if(F.col("grade") == k).alias(f"n{k}") for k in range(3)))
    often = by.where(F.col("n0") + F.col("n1") + F.col("n2") >= MIN_DOCUMENTS)  # at most a row a bucket
    learned = leaning({r["feat"]: np.array([r["n0"], r["n1"], r["n2"]]) for r in often.orderBy("feat").toLocalIterator()}, totals)

    def pick(batches):
        for b in batches:
            kept = [np.isin(x.values.to_numpy(), learned) for x in b.column(1)]
            feats = [x.values.to_numpy()[k].astype("<i4").tobytes() for x, k in zip(b.column(1), kept)]
            vals = [x.values.to_numpy()[k].astype("<f4").tobytes() for x, k in zip(b.column(2), kept)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(feats, pa.binary()), pa.array(vals, pa.binary())], ["grade", "feats", "vals"])

    got = table.mapInArrow(pick, "grade int, feats binary, vals binary").collect()
    got.sort(key=lambda r: (bytes(r["feats"]), bytes(r["vals"]), r["grade"]))  # the fit must not depend on the order of tasks
    grade = np.array([r["grade"] for r in got], np.int64)
    feat = [np.frombuffer(r["feats"], "<i4") for r in got]
    value = [np.frombuffer(r["vals"], "<f4") for r in got]
    return Model.fit(np.repeat(np.arange(len(got)), [len(x) for x in feat]), np.concatenate(feat).astype(np.int64), np.concatenate(value), grade, 3)


def grade_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, expected_grade (0..2), p_good (grade 2), p_harmless (grade 1 or more), selected.

    Null or wordless text scores zero like any text without known words. Null labels are left out; a document rated
    twice takes its worst ratings. Without two grades to learn from all columns but doc_id are null. Null doc_ids and
    repeated rows pass through; ties cannot arise. Empty table: empty result. Extra columns are not read. The model is
    fitted while this is called.
    """
    model = model or fit(docs, labels)
    shape = "doc_id long, expected_grade double, p_good double, p_harmless double, selected boolean"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if model is None:
        return texts.selectExpr("doc_id", "cast(null as double) expected_grade", "cast(null as double) p_good", "cast(null as double) p_harmless", "cast(null as boolean) selected")

    def run(batches):
        for b in batches:
            tail = model.tails(model.scores(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tail.sum(axis=1)), pa.array(tail[:, 1]), pa.array(tail[:, 0]), pa.array(tail[:, SELECT_FROM - 1] >= SELECT_AT)], ["doc_id", "expected_grade", "p_good", "p_harmless", "selected"])

    return texts.mapInArrow(run, shape)
