"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within three bits share a midpoint one flip from one and two flips from the other. Each fingerprint
emits the variants of half the radius: its one-bit ball if its parity is odd, its two-bit ball if even (1.5 bits on
average, half of 3). Of the two-bit ball only pairs of bits in the same 32-bit half are needed, since two of any three
bits share a half; even fingerprints two bits apart across the halves meet by flipping one bit of a half chosen by
the parity of their upper half. All pairs within the radius meet, and every bucket of equal variants is a star of
valid links, so a bucket emits its members once and never all pairs.

Variants are dealt out by a linear hash of their bits. The receiver knows which flips of a fingerprint fall to its
part, so each fingerprint travels once a part and not once a variant.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, keep_rows, materialize, power_of_two, raw, row_key, word_spans
from .components import connected_components

RADIUS = 3
#: A fingerprint of more than one in HOT_PARTS rows is hot; there are fewer than HOT_PARTS of them.
HOT_PARTS = 1000
#: Variants that one part should hold, about; 16 bytes each while they are sorted.
PART_VARIANTS = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_hashes(texts: pa.Array, words: int, seed: int):
    """(first row, shingles of each row, their hashes) of each chunk; fewer words than a shingle are one shingle."""
    data, offs = raw(texts)
    digest = xxhash.xxh64_intdigest
    for i, j in chunks(offs):
        d, o = LOWER[data[offs[i] : offs[j]]], offs[i : j + 1] - offs[i]
        starts, ends, row = word_spans(d, o)
        if not len(starts):
            continue
        # words joined by one space: keep word bytes, and one byte before each word
        size = ends - starts + 1
        at = np.cumsum(size) - size  # place of each word in the joined text, its space first
        keep = np.repeat(starts - 1 - at, size) + np.arange(int(size.sum()))
        joined = d[np.maximum(keep, 0)]
        joined[at] = 32
        count = np.bincount(row, minlength=j - i)
        first = np.cumsum(count) - count
        n_sh = np.where(count >= words, count - words + 1, np.minimum(count, 1))
        doc = np.repeat(np.arange(j - i), n_sh)
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh)
        w0 = first[doc] + rank
        w1 = np.minimum(w0 + words, first[doc] + count[doc]) - 1
        view = memoryview(joined.tobytes())
        yield i, n_sh, np.array([digest(view[s:e], seed) for s, e in zip((at[w0] + 1).tolist(), (at[w1] + size[w1]).tolist())], np.uint64)


def fingerprints(texts: pa.Array, words: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of each text over its word shingles, repeats included; null or wordless: zero."""
    out = np.zeros(len(texts), np.uint64)
    for i, n_sh, h in shingle_hashes(texts, words, seed):
        bits = np.unpackbits(h.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
        has = np.flatnonzero(n_sh)
        ones = np.add.reduceat(bits, (np.cumsum(n_sh) - n_sh)[has], axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > n_sh[has, None], axis=1)
        out[i + has] = packed.view(">u8").ravel().astype(np.uint64)
    return out


def fingerprint_table(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, key, hash, fp): fp is the fingerprint as a signed long, key orders documents (null ids last)."""

    def run(batches):
        for b in batches:
            fp = fingerprints(b.column(3), words, seed)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp.view(np.int64))], ["doc_id", "key", "hash", "fp"])

    key, text_hash = row_key().values()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), text_hash.alias("hash"), "text").mapInArrow(run, "doc_id long, key long, hash long, fp long")


class Flips:
    """The flips a fingerprint may make, by the part that the variant falls to. parts is a power of two."""

    def __init__(self, parts: int, seed: int = 7):
        self.bits = parts.bit_length() - 1
        rng = np.random.default_rng(seed)
        self.rows = rng.integers(0, 2**64, self.bits, dtype=np.uint64)
        one = np.uint64(1) << np.arange(64, dtype=np.uint64)
        pair = [one[i] | one[j] for h in (0, 32) for i in range(h, h + 32) for j in range(i + 1, h + 32)]
        none = np.zeros(1, np.uint64)
        # kind: 0 odd parity; 1, 2 even parity with an even, odd upper half
        self.sets = [one, np.concatenate([none, np.array(pair, np.uint64), one[32:]]), np.concatenate([none, np.array(pair, np.uint64), one[:32]])]
        self.by = []
        for flips in self.sets:
            part = self.part(flips)
            order = np.argsort(part, kind="stable")
            values, at = np.unique(part[order], return_index=True)
            self.by.append(dict(zip(values.tolist(), np.split(flips[order], at[1:]))))

    def part(self, x: np.ndarray) -> np.ndarray:
        """The linear hash: a parity bit for each row."""
        out = np.zeros(len(x), np.int64)
        for k, r in enumerate(self.rows):
            out |= (np.bitwise_count(x & r) & 1).astype(np.int64) << k
        return out

    @staticmethod
    def kind(x: np.ndarray) -> np.ndarray:
        odd = np.bitwise_count(x) & 1
        upper = np.bitwise_count(x >> np.uint64(32)) & 1
        return np.where(odd == 1, 0, 1 + upper).astype(np.int64)


def deal(flips: Flips, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, fingerprint) for every part that some variant of the fingerprint falls to."""
    home, kind = flips.part(fps), flips.kind(fps)
    parts, values = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k in range(3):
        own = fps[kind == k]
        shift = np.array(list(flips.by[k]), np.int64)
        parts.append((home[kind == k][:, None] ^ shift[None, :]).ravel())
        values.append(np.repeat(own, len(shift)))
    return np.concatenate(parts), np.concatenate(values)


def meet(flips: Flips, part: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (hub, member) of the fingerprints whose variants fall to this part and collide there."""
    fps = np.unique(fps)
    shift, kind = part ^ flips.part(fps), flips.kind(fps)
    var, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    order = np.lexsort((shift, kind))
    code = kind[order] * (1 << flips.bits) + shift[order]
    for group in np.split(order, np.flatnonzero(np.diff(code)) + 1) if len(order) else []:
        f = flips.by[int(kind[group[0]])].get(int(shift[group[0]]))
        if f is not None:
            var.append((fps[group][:, None] ^ f[None, :]).ravel())
            own.append(np.repeat(fps[group], len(f)))
    var, own = np.concatenate(var), np.concatenate(own)
    order = np.argsort(var, kind="stable")
    var, own = var[order], own[order]
    same = var[1:] == var[:-1]
    many = np.zeros(len(var), bool)
    many[1:] |= same
    many[:-1] |= same
    var, own = var[many], own[many]
    if not len(var):
        return var, own
    # hub of each bucket: an odd member, else the variant itself, else (odd variants) the smallest member
    bucket = np.concatenate([[0], np.cumsum(var[1:] != var[:-1])])
    odd = (np.bitwise_count(own) & 1) == 1
    rank = np.where(odd, 0, np.where(own == var, 1, np.where((np.bitwise_count(var) & 1) == 1, 2, 3)))
    order = np.lexsort((own, rank, bucket))
    var, own, bucket, rank = var[order], own[order], bucket[order], rank[order]
    first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    lead = np.flatnonzero(first)[bucket]
    hub = own[lead]
    ok = (hub != own) & (rank[lead] < 3)
    hub, own = hub[ok], own[ok]
    ok = np.bitwise_count(hub ^ own) <= RADIUS  # verify
    pairs = np.unique(np.stack([hub[ok], own[ok]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def link_fingerprints(fps: DataFrame, parts: int | None = None) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) within RADIUS bits; every link is valid."""
    if parts is None:
        parts = power_of_two(max(128, fps.count() * 545 / PART_VARIANTS))

    def send(batches):
        flips = Flips(parts)
        for b in batches:
            all_fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i in range(0, len(all_fps), 8192):
                part, fp = deal(flips, all_fps[i : i + 8192])
                order = np.argsort(part, kind="stable")
                part, fp = part[order], fp[order]
                at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
                blobs = [x.tobytes() for x in np.split(fp, at[1:])] if len(part) else []
                yield pa.RecordBatch.from_arrays([pa.array(part[at], pa.int64()), pa.array(blobs, pa.binary())], ["part", "fps"])

    def receive(key, table):
        flips = Flips(parts)
        data, _ = raw(table.column("fps"))
        a, b = meet(flips, int(key[0].as_py()), np.frombuffer(data.tobytes(), np.uint64))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return fps.select("fp").mapInArrow(send, "part long, fps binary").groupBy("part").applyInArrow(receive, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, n_links, is_first.

    component_id is the smallest doc_id reachable over links of at most RADIUS differing bits; equal fingerprints are
    linked. n_links counts the links found for the fingerprint. is_first marks one document a component, the one to
    keep. Null text or no words: fingerprint zero, linked like any other. Null doc_ids come after all others, so a
    component_id is null only where every member's is. Repeated rows share a component. Empty table: empty result.
    Only doc_id and text are read; other columns cannot clash. Fingerprints, links and components are written while this
    is called.
    """
    return _grouped(docs, words, seed).drop("key", "hash", "component")


def _grouped(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """What near_duplicates() gives, with the key and text hash of each row and the root of its component."""
    table = materialize(fingerprint_table(docs, words, seed), "fps")
    nodes = materialize(table.groupBy("fp").agg(F.min("key").alias("key"), F.count("*").alias("rows")), "nodes")
    links = materialize(link_fingerprints(nodes), "pairs")
    roots = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = nodes.join(roots, nodes.fp == roots.node).select("fp", "key", "root")
    least = linked.groupBy("root").agg(F.min("key").alias("component_key"))
    comp = linked.join(least, "root").select("fp", "root", "component_key").join(degree.withColumnRenamed("node", "fp"), "fp", "left")
    every = nodes.join(comp, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"), F.coalesce("component_key", "key").alias("component_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # rows of a hot fingerprint meet its component where they are: at most HOT_PARTS rows are sent to all tasks
    total = nodes.agg(F.sum("rows").alias("n")).first()["n"] or 0
    hot = nodes.where(F.col("rows") * HOT_PARTS > total).select("fp")
    few = F.broadcast(materialize(every.join(hot, "fp", "left_semi"), "hot"))
    joined = table.join(few, "fp").unionByName(table.join(F.broadcast(hot), "fp", "left_anti").join(every.join(F.broadcast(hot), "fp", "left_anti"), "fp"))
    return joined.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("component_key") < (1 << 62), F.col("component_key")).alias("component_id"),
        F.col("n_links").cast("long").alias("n_links"),
        (F.col("key") == F.col("component_key")).alias("is_first"),
        "key",
        "hash",
        "component",
    )


def drop_near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """The documents (all columns) that come first in their component; one of each group stays.

    Rows that repeat a doc_id and its text are one document and stay once; rows that share only a doc_id, or have
    none, are different documents.
    """
    # rows of one id may both come first: the least text hash of them stays
    first = _grouped(docs, words, seed).where("is_first").groupBy("component").agg(F.min(F.struct(F.col("key").alias("_key"), F.col("hash").alias("_hash"))).alias("first"))
    return keep_rows(docs, row_key(), first.select("first.*").distinct(), once=True)
