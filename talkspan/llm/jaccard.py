"""Near copies by the Jaccard similarity of word shingles: fingerprints and MinHash propose, whole sets decide.

Texts with equal sets are one node. Candidates come two ways. Fingerprints of the shingles within simhash.RADIUS bits
collide in the balls of simhash.link_fingerprints(); each such link is a bucket of one node of either, and the nodes of one
fingerprint are a bucket. As most
pairs at similarity 0.8 lie further apart than any radius that balls can reach, a node also falls into BANDS buckets,
each named by ROWS minima; a pair at similarity s shares none with a chance of (1 - s**ROWS)**BANDS, 5e-8 at 0.8 and
less above. Every pair of a bucket is compared on its whole sets, in integers, and only links that join something new
are given out: fewer than a bucket has members. A bucket of more than BLOCK members is dealt out by pairs of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, keep_rows, materialize, raw, row_key
from .components import connected_components
from .simhash import link_fingerprints, shingle_hashes

WORDS = 5
#: Least similarity, as a fraction of integers.
NUMERATOR, DENOMINATOR = 4, 5
BANDS, ROWS = 32, 4
BLOCK = 1024


def shingle_sets(texts: pa.Array, words: int = WORDS, seed: int = 42) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; null or wordless: none."""
    out = [np.zeros(0, np.uint64)] * len(texts)
    for i, n_sh, h in shingle_hashes(texts, words, seed):
        at = np.concatenate([[0], np.cumsum(n_sh)])
        for k in np.flatnonzero(n_sh):
            out[i + k] = np.unique(h[at[k] : at[k + 1]])
    return out


def name(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 42)


_draw = np.random.default_rng(11).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64)


def bands(own: np.ndarray) -> list[int]:
    """The bucket of each band; no shingles, no buckets."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(own), 2048):
        least = np.minimum(least, (own[i : i + 2048, None] * (_draw[0] * np.uint64(2) + np.uint64(1)) + _draw[1]).min(axis=0))
    return [xxhash.xxh64_intdigest(x.tobytes(), 42) for x in least.reshape(BANDS, ROWS)]


def links(nodes: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A forest over the members of a bucket that connects all pairs at the similarity; every link is valid."""
    size = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(column, kind="stable")
    holder = np.repeat(np.arange(len(sets)), size)[order]
    many = np.bincount(column, minlength=len(values))
    first = np.cumsum(many) - many
    group, out = np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        own = column[at[i] : at[i + 1]]
        n = many[own]
        places = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        both = np.bincount(holder[places], minlength=len(sets))
        near = DENOMINATOR * both >= NUMERATOR * (size + size[i] - both)
        near[: i + 1] = False
        near &= group != group[i]
        other, member = np.unique(group[near], return_index=True)
        for g, k in zip(other, np.flatnonzero(near)[member]):
            out.append((int(nodes[i]), int(nodes[k])))
            group[group == g] = group[i]
        if (group == group[0]).all():
            break
    return out


def fingerprint(own: np.ndarray) -> int:
    """SimHash of a set of shingle hashes, as a signed long; no shingles: zero."""
    bits = np.unpackbits(own.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(own)).view(">i8")[0])


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def drop_near_copies(docs: DataFrame, words: int = WORDS, seed: int = 42) -> DataFrame:
    """The documents (all columns) that come first in their group; one of each group stays.

    A group is what links of pairs at the similarity connect. The first has the smallest doc_id (null ids follow, told
    apart by their text). Rows that repeat a doc_id and its text are one document and stay once; rows that share only
    a doc_id are different documents. Texts without words are one group.
    """

    def sketch(batches):
        for b in batches:
            node, own, fp = [], [], []
            texts = b.column(2)
            _, offs = raw(texts)
            for i, j in chunks(offs):
                for x in shingle_sets(texts.slice(i, j - i), words, seed):
                    node.append(name(x))
                    own.append(bands(x))
                    fp.append(fingerprint(x))
            flat = _signed([v for x in own for v in x])
            at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _signed(node), pa.array(fp, pa.int64()), pa.ListArray.from_arrays(at, flat)], ["_key", "_hash", "node", "fp", "bands"])

    def whole(batches):
        for b in batches:
            texts = b.column(0)
            _, offs = raw(texts)
            for i, j in chunks(offs):
                sets = shingle_sets(texts.slice(i, j - i), words, seed)
                yield pa.RecordBatch.from_arrays([_signed([name(x) for x in sets]), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "shingles"])

    def compare(key, table):
        node = table.column("node").to_numpy()
        order = np.argsort(node, kind="stable")
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        found = links(node[order], [sets[k] for k in order])
        return pa.table({c: pa.array([x[k] for x in found], pa.int64()) for k, c in enumerate("ab")})

    rows = docs.select(*(c.alias(k) for k, c in row_key().items()), "text")
    table = materialize(rows.select("_key", "_hash", "text").mapInArrow(sketch, "_key long, _hash long, node long, fp long, bands array<long>"), "sketches")
    nodes = table.groupBy("node").agg(F.min(F.struct("_key", "_hash")).alias("first"))
    each = table.groupBy("node").agg(F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    each = materialize(each, "nodes")
    banded = each.select("node", F.posexplode("bands").alias("band", "value"))
    # the nodes of one fingerprint, and one each of two that are linked, are buckets too
    alike = each.select("node", F.lit(-1).alias("band"), F.col("fp").alias("value"))
    least = each.groupBy("fp").agg(F.min("node").alias("node"))
    balls = link_fingerprints(least.select("fp"))
    left, right = least.select(F.col("fp").alias("a"), F.col("node").alias("x")), least.select(F.col("fp").alias("b"), F.col("node").alias("y"))
    near = balls.join(left, "a").join(right, "b").select(F.explode(F.array("x", "y")).alias("node"), F.lit(-2).alias("band"), F.xxhash64("a", "b").alias("value"))
    found = banded.unionByName(alike).unionByName(materialize(near, "near"))
    # many bands have the same nodes: of buckets with equal sums of hashes one is kept. No row holds the nodes of a bucket
    sums = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("h"), F.bit_xor(F.xxhash64(F.col("node"), F.lit(seed))).alias("i")]
    buckets = found.groupBy("band", "value").agg(*sums).where("n > 1").groupBy("n", "h", "i").agg(F.min(F.struct("band", "value")).alias("b"))
    buckets = materialize(buckets.select("b.band", "b.value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "buckets")
    bucket, place = F.xxhash64("band", "value").alias("bucket"), F.pmod(F.xxhash64("node", F.lit(seed + 1)), F.col("blocks")).cast("int").alias("block")
    members = materialize(found.join(buckets, ["band", "value"]).select(bucket, "blocks", place, "node"), "members")
    wanted = members.select("node").distinct().join(nodes, "node").select("first.*")
    sets = materialize(rows.join(wanted, ["_key", "_hash"], "left_semi").dropDuplicates(["_key", "_hash"]).select("text").mapInArrow(whole, "node long, shingles binary"), "sets")
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("blocks = 1 OR other <> block")
    dealt = dealt.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "node")
    pairs = materialize(dealt.join(sets, "node").groupBy("bucket", "low", "high").applyInArrow(compare, "a long, b long"), "pairs")
    discard(sets)
    roots = connected_components(pairs)
    group = F.coalesce("root", nodes["node"])
    kept = nodes.join(roots.withColumnRenamed("node", "_member"), F.col("node") == F.col("_member"), "left").groupBy(group.alias("group")).agg(F.min("first").alias("first")).select("first.*")
    return keep_rows(docs, row_key(), kept, once=True)
