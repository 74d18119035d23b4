"""Benchmark decontamination: a BM25 index of test items, asked with every training passage by block-max WAND.

Item weights are BM25 impacts as a share of the item's own total, so a passage scores the weighted share of an item's
words that it holds. A passage with OVERLAP of an item's shingles lacks at most 1 - OVERLAP as many words, so it holds
all weight but that of the item's heaviest such words; weights are scaled to make this 1, the threshold of all items,
and no match is lost.

Item numbers fall into blocks of SPAN. The greatest weight of each term in each block is kept, and the sums of these
bound what a passage can score anywhere in a block, for all blocks and many passages at once (block-max indexes with
document-oriented blocks, and the live blocks computed from them, as Dimopoulos, Nepomnyachiy and Suel describe). Only
live blocks are walked, by WAND with pivots and shallow moves over maxima of POSTINGS postings. What is retrieved is
verified on word shingles of the item's question (all sentences but the last) and answer (the last).

An index holds at most PART_ITEMS items and about PART_BYTES of their text. More items are dealt to parts; term and
length statistics are those of all items, so a score does not depend on the parts. Each part is broadcast, meets all
passages, is written and freed before the next, so neither the driver nor a task ever holds more than one.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, chunks, fresh, materialize, raw, take_words, word_spans

K1, B = 1.2, 0.75
THRESHOLD = 1.0
SHINGLE = 5
OVERLAP = 0.8
PART_OVERLAP = 0.5
#: Postings to a stretch of a list that has a maximum of its own.
POSTINGS = 4
#: Item numbers to a block.
SPAN = 8
PART_ITEMS = 10_000
PART_BYTES = 8 << 20
MATCH = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


def words_of(text: str) -> list[bytes]:
    data = np.frombuffer(text.lower().encode(), np.uint8)
    s, e, _ = word_spans(data, np.array([0, len(data)]), NOT_ALNUM)
    return [data[a:b].tobytes() for a, b in zip(s, e)]


def shingles(words: list, n: int = SHINGLE) -> set:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class Index:
    """Inverted lists with block maxima. items: (item_id, text); empty texts are left out."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = THRESHOLD, statistics: tuple | None = None):
        """statistics: (items with words, their mean number of words, items that hold a word by word) of all parts."""
        rows = [(i, words_of(t or ""), t or "") for i, t in items]
        rows = [r for r in rows if r[1]]
        self.threshold = threshold
        self.ids = [r[0] for r in rows]
        self.words = [r[1] for r in rows]
        self.length = max((len(w) for w in self.words), default=1)
        every, mean, df = statistics or (len(rows), sum(map(len, self.words)) / max(1, len(rows)), Counter(t for w in self.words for t in set(w)))
        lists: dict[bytes, list[tuple[int, float]]] = {}
        for k, w in enumerate(self.words):
            tf = Counter(w)
            impact = {t: math.log(1 + (every - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for t, n in tf.items()}
            n = len(shingles(w))
            lost = n - next(k for k in range(n + 1) if k / n >= OVERLAP)  # counted as verify() decides, not by a rounded product
            total = sum(sorted(impact.values(), reverse=True)[lost:]) or 1.0
            for t, x in impact.items():
                lists.setdefault(t, []).append((k, x / total))
        self.vocabulary = sorted(lists)
        self.lists = [([k for k, _ in lists[t]], [x for _, x in lists[t]]) for t in self.vocabulary]
        self.blocks = [[max(x[i : i + POSTINGS]) for i in range(0, len(x), POSTINGS)] for _, x in self.lists]
        self.n_blocks = max(1, -(-len(rows) // SPAN))
        # the blocks of each term and its greatest weight there, one list after the other
        held = [dict[int, float]() for _ in self.lists]
        for own, (ks, xs) in zip(held, self.lists):
            for k, x in zip(ks, xs):
                own[k // SPAN] = max(own.get(k // SPAN, 0.0), x)
        self.held_first = np.cumsum([0, *map(len, held)])
        self.held_block = np.array([k for own in held for k in own], np.int64)
        self.held_most = np.array([x for own in held for x in own.values()])
        self.terms = pa.array(self.vocabulary, pa.binary())
        self.parts = []
        for _, w, text in rows:
            sentences = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
            n = len(words_of(" ".join(sentences[:-1]))) or len(w)
            self.parts.append((shingles(w), shingles(w[:n]), shingles(w[n:]) or shingles(w)))

    def retrieve(self, terms: list[int], block: int | None = None) -> list[tuple[int, float]]:
        """Items (number, score) at or over the threshold for a passage's distinct terms, of one block or all."""
        lo, hi = (0, len(self.ids)) if block is None else (block * SPAN, (block + 1) * SPAN)
        need = self.threshold - 1e-9
        lists, blocks = self.lists, self.blocks
        bound, heap, out = {}, [], []  # heap: (current item, term, posting)
        for t in terms:
            docs, weights = lists[t]
            q, end = bisect.bisect_left(docs, lo), bisect.bisect_left(docs, hi)
            if q < end:
                bound[t] = max(weights[q:end])
                heap.append((docs[q], t, q))
        while heap:
            heap.sort()
            total, pivot = 0.0, -1
            for n, (_, t, _) in enumerate(heap):
                total += bound[t]
                if total >= need:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = heap[pivot][0]
            while pivot + 1 < len(heap) and heap[pivot + 1][0] == item:
                pivot += 1
            # shallow move: the block of each list that would hold the item, and its greatest impact
            total, stop, moved = 0.0, None, []
            for _, t, p in heap[: pivot + 1]:
                docs = lists[t][0]
                q = p if docs[p] >= item else bisect.bisect_left(docs, item, p)
                moved.append(q)
                if q < len(docs):
                    total += blocks[t][q // POSTINGS]
                    end = docs[min(len(docs), (q // POSTINGS + 1) * POSTINGS) - 1]
                    stop = end if stop is None else min(stop, end)
            if total >= need:
                score = sum(lists[t][1][q] for (_, t, _), q in zip(heap, moved) if q < len(lists[t][0]) and lists[t][0][q] == item)
                if score >= need:
                    out.append((item, score))
                target = item + 1
            else:  # no item up to the end of these blocks can reach the threshold, unless another list joins
                target = (item if stop is None else stop) + 1
                if pivot + 1 < len(heap):
                    target = max(item + 1, min(target, heap[pivot + 1][0]))
            rest = heap[pivot + 1 :]
            for (_, t, _), q in zip(heap[: pivot + 1], moved):
                docs = lists[t][0]
                q = bisect.bisect_left(docs, target, q)
                if q < len(docs) and docs[q] < hi:
                    rest.append((docs[q], t, q))
            heap = rest
        return out

    def bounds(self, pairs: np.ndarray, pieces: int, at_once: int = 1 << 20) -> np.ndarray:
        """What each piece of text can score in each block at most. pairs: piece * terms + term, each once, ascending."""
        piece, term = np.divmod(pairs, max(1, len(self.lists)))
        first, size = self.held_first[term], self.held_first[term + 1] - self.held_first[term]
        upto = np.cumsum(size)
        out = np.zeros((pieces, self.n_blocks), np.float32)
        i = 0
        while i < len(pairs):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + at_once, "right")))
            n = size[i:j]
            place = np.repeat(first[i:j] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            low, high = int(piece[i]), int(piece[j - 1]) + 1
            code = np.repeat(piece[i:j] - low, n) * self.n_blocks + self.held_block[place]
            out[low:high] += np.bincount(code, self.held_most[place], minlength=(high - low) * self.n_blocks).reshape(high - low, -1)
            i = j
        return out

    def verify(self, item: int, words: list[bytes]) -> tuple[float, float, float]:
        """Shares of the shingles of the item, its question and its answer that the words hold; without words all are 0."""
        have = shingles(words)
        shares = []
        for own in self.parts[item]:
            short = [s for s in own if len(s) < SHINGLE]
            if short:  # under five words: the words must follow each other
                n = len(short[0])
                shares.append(float(short[0] in {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}))
            else:
                shares.append(len(own & have) / len(own))
        return shares[0], shares[1], shares[2]

    def search(self, texts: pa.Array) -> list[tuple[int, int, float, float, float, float]]:
        """(row, item number, score, overlaps) of every verified match; each row and item once, the best passage."""
        found: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        data, offs = raw(pc.utf8_lower(texts))
        need, size = self.threshold - 1e-9, self.length
        for i, j in chunks(offs):
            d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            starts, ends, row = word_spans(d, o, NOT_ALNUM)
            if not len(starts) or not self.ids:
                continue
            term = pc.index_in(take_words(d, starts, ends), value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False)
            count = np.bincount(row, minlength=j - i)
            first = np.cumsum(count) - count
            # stretches of `size` words; a passage is two neighbours, so each item-long stretch lies in one
            n = -(-count // size)
            own = np.repeat(np.arange(j - i), n)
            at = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            lo = first[own] + at * size
            hi = np.minimum(lo + size, (first + count)[own])
            known = np.flatnonzero(term >= 0)
            piece = np.searchsorted(lo, known, "right") - 1
            best = self.bounds(np.unique(piece * np.int64(len(self.lists)) + term[known]), len(own))
            joint = best.copy()
            pair = np.flatnonzero(own[1:] == own[:-1])
            joint[pair] += best[pair + 1]
            whole = hi.copy()
            whole[pair] = hi[pair + 1]
            for k, block in zip(*np.nonzero(joint >= need - 1e-4)):
                a, b = int(lo[k]), int(whole[k])
                terms = np.unique(term[a:b])
                hits = self.retrieve(terms[terms >= 0].tolist(), int(block))
                if hits:
                    passage = [d[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])]
                for item, score in hits:
                    shares = self.verify(item, passage)
                    if shares[0] >= OVERLAP and min(shares[1:]) >= PART_OVERLAP:
                        key = (i + int(own[k]), item)
                        found[key] = max(found.get(key, (0.0,)), (score, *shares))
        return [(*k, *v) for k, v in found.items()]


def _match(texts: DataFrame, index: Index) -> tuple[DataFrame, object]:
    shared = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index = shared.value
        for b in batches:
            hits = index.search(b.column(1))
            doc = b.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
            yield pa.RecordBatch.from_arrays([doc, pa.array([index.ids[h[1]] for h in hits], pa.int64()), *(pa.array([h[c] for h in hits], pa.float64()) for c in (2, 3, 4, 5))], ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"])

    return texts.mapInArrow(run, MATCH), shared


def _words(batches):
    for b in batches:
        own = [[w.decode() for w in words_of(t or "")] for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.list_(pa.string()))], ["part", "item_id", "text", "words"])


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, part_items: int | None = None) -> DataFrame:
    """Rows (doc_id, item_id, score, overlap, question_overlap, answer_overlap): the documents that hold a test item.

    docs: doc_id, text; items: item_id, text. A match needs OVERLAP of the item's word 5-shingles in one passage, and
    PART_OVERLAP of those of question and answer. Null or empty texts match nothing. Null ids pass through. Repeated
    documents or items match each by themselves. Without documents or items the result is empty. Extra columns are
    not read. With more than part_items items, matches are written part by part while this is called.
    """
    part_items = part_items or PART_ITEMS
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    parts = max(1, -(-size["n"] // part_items), -(-(size["b"] or 0) // PART_BYTES))
    own = items.select(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts).cast("long")).alias("part"), F.col("item_id").cast("long").alias("item_id"), "text")
    pairs = lambda rows: [(r["item_id"], r["text"]) for r in rows.select("item_id", "text").orderBy("item_id", "text").collect()]
    if parts == 1:
        return _match(texts, Index(pairs(own), threshold))[0]
    table = materialize(own.mapInArrow(_words, "part long, item_id long, text string, words array<string>"), "items")
    every = table.where(F.size("words") > 0).agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    single = table.select("part", F.explode(F.array_distinct("words")).alias("word"))
    counts = materialize(single.groupBy("word").agg(F.count("*").alias("df")), "words")
    out = None
    for k in range(parts):
        needed = counts.join(single.where(F.col("part") == k).select("word").distinct(), "word", "left_semi")
        df = {r["word"].encode(): r["df"] for r in needed.collect()}  # the words of one part
        index = Index(pairs(table.where(F.col("part") == k)), threshold, (every["n"], every["mean"], df))
        lazy, shared = _match(texts, index)
        part = materialize(lazy, "matches")
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents (all columns) without any verified match. A match is of the text, so the text decides, not the id."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    hit = find_leaks(texts, items, threshold).select(F.col("doc_id").alias("_hit_hash")).distinct()
    name = fresh(docs, "_hit_hash")
    own = docs.withColumn(name, F.xxhash64("text"))
    return own.join(hit.select(F.col("_hit_hash").alias(name)), name, "left_anti").drop(name)
