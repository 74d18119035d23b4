"""Best-fit packing of tokenised documents into sequences of bounded length, by hierarchical residual packing.

Groups of pieces are packed best-fit decreasing; nearly full bins are final, the others travel up as items and are
packed again with those of other groups, in ever fewer groups, until none is left. What counts as nearly full doubles
its slack by level, so every bin is final by level 9 at a limit of 2048. Pieces are dealt to groups by their place in the piece table and each group
holds a bounded number of bins, so no task depends on the size of the input or on its keys.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, raw
from .tokens import encoder

LIMIT = 2048
#: Bins that one group packs at once, about.
GROUP_ITEMS = 20_000
#: Free tokens up to which a bin is final, by level.
SLACK = 4
PIECE = np.dtype([("doc", "<i8"), ("null", "<u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4"), ("offset", "<i4")])
RESULT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cuts(n: int, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only those over the limit are cut, and the first piece may be shorter."""
    first = n - (n - 1) // limit * limit
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)]


def piece_table(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32-bit) of every document's pieces."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        enc = encoder(vocabulary, ranks)
        for b in batches:
            out = {c: [] for c in names}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.array(text).astype("<u4")
                for k, (s, n) in enumerate(cuts(len(ids), limit)):
                    body = ids[s : s + n].tobytes()
                    row = (doc, k, s, n, zlib.crc32(body), body)
                    for c, v in zip(names, row):
                        out[c].append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(names, kinds)], names)

    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, shape)


def best_fit(sizes: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bin number of each item; items go by decreasing size, each to the fullest bin that takes it."""
    bins: list[list[int]] = [[] for _ in range(limit + 1)]  # open bins by free space
    free, count = 0, 0  # free: bit r is set if some open bin has r tokens free
    out = np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        fit = free >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = bins[r].pop()
            if not bins[r]:
                free &= ~(1 << r)
        else:
            r, b, count = limit, count, count + 1
        out[i] = b
        r -= n
        if r:
            bins[r].append(b)
            free |= 1 << r
    return out


def _pack_group(group: int, level: int, items: np.ndarray, counts: np.ndarray, limit: int, last: bool) -> pa.Table:
    """items: PIECE records, counts[k] of them in item k, which is a bin of the level below or one piece."""
    head = np.cumsum(counts) - counts
    fills = np.add.reduceat(items["length"].astype(np.int64), head) if len(counts) else np.zeros(0, np.int64)
    bins = best_fit(fills, limit)
    order = np.argsort(bins, kind="stable")
    # place of each item in its bin
    size = fills[order]
    before = np.cumsum(size) - size
    new = np.ones(len(order), bool)
    new[1:] = bins[order[1:]] != bins[order[:-1]]
    at = np.flatnonzero(new)
    shift = before - before[at][np.cumsum(new) - 1] if len(order) else before
    n = counts[order]
    take = np.repeat(head[order] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    items = items[take].copy()
    items["offset"] += np.repeat(shift, n).astype(np.int32)
    per_bin = np.add.reduceat(n, at) if len(at) else np.zeros(0, np.int64)
    fill = np.add.reduceat(size, at) if len(at) else np.zeros(0, np.int64)
    done = (fill >= limit - (SLACK << level)) | last
    of_item = np.repeat(done, per_bin)
    ids = (np.int64(level) << 56) | (np.int64(group) << 28) | np.arange(len(at), dtype=np.int64)
    rows = {"group": [], "final": [], "bins": [], "counts": [], "ids": [], "items": []}
    for flag in (True, False):
        if (done == flag).any():
            rows["group"].append(group)
            rows["final"].append(flag)
            rows["bins"].append(int((done == flag).sum()))
            rows["counts"].append(per_bin[done == flag].astype("<i4").tobytes())
            rows["ids"].append(ids[done == flag].tobytes())
            rows["items"].append(items[of_item == flag].tobytes())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), (pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))})


_LEVEL = "group long, final boolean, bins long, counts binary, ids binary, items binary"


def _records(column, dtype) -> np.ndarray:
    return np.frombuffer(raw(column)[0].tobytes(), dtype)


def _repack(level: int, limit: int, last: bool):
    def run(key, table):
        return _pack_group(int(key[0].as_py()), level, _records(table.column("items"), PIECE), _records(table.column("counts"), np.int32).astype(np.int64), limit, last)

    return run


def pack_pieces(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Rows of RESULT: every piece with its sequence and its place there. pieces: a written table of piece_table()'s rows.

    The levels are written while this is called. Pieces of one length go by doc_id, piece and content, so equal rows
    are the only ties.
    """
    groups = max(1, -(-pieces.count() // GROUP_ITEMS))

    def first(key, table):
        items = np.zeros(table.num_rows, PIECE)
        doc = table.column("doc_id").combine_chunks()
        items["null"] = doc.is_null().to_numpy(zero_copy_only=False)
        for f, c in (("doc", doc.fill_null(0)), ("piece", table.column("piece")), ("start", table.column("start")), ("length", table.column("length")), ("crc", table.column("ids_crc32"))):
            items[f] = c.to_numpy()
        items = items[np.lexsort((items["crc"], items["length"], items["start"], items["piece"], items["doc"], items["null"]))]
        return _pack_group(int(key[0].as_py()), 0, items, np.ones(len(items), np.int64), limit, False)

    # the piece table is written once, so a piece's file and row stay the same when a task is run again
    place = F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(groups).cast("long")).alias("group")
    level = materialize(pieces.select(place, "doc_id", "piece", "start", "length", "ids_crc32").groupBy("group").applyInArrow(first, _LEVEL), "packed0")
    done = [level.where("final")]
    open_bins = level.where("not final").agg(F.sum("bins").alias("n")).first()["n"] or 0
    k = 0
    while open_bins:
        k += 1
        last_groups, groups = groups, max(1, min(groups, -(-open_bins // (2 * GROUP_ITEMS))))
        last = last_groups == 1
        below = level.where("not final").select((F.col("group") % groups).alias("group"), "counts", "items")
        level = materialize(below.groupBy("group").applyInArrow(_repack(k, limit, last), _LEVEL), f"packed{k}")
        done.append(level.where("final"))
        open_bins = level.where("not final").agg(F.sum("bins").alias("n")).first()["n"] or 0
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)

    def rows(batches):
        for b in batches:
            items, counts, ids = (_records(b.column(i), t) for i, t in ((0, PIECE), (1, np.int32), (2, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(items["doc"], mask=items["null"] == 1),
                    pa.array(items["piece"]),
                    pa.array(items["start"]),
                    *(pa.array(items[c].astype(np.int64)) for c in ("length", "crc")),
                    pa.array(np.repeat(ids, counts)),
                    pa.array(items["offset"].astype(np.int64)),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return out.select("items", "counts", "ids").mapInArrow(rows, RESULT)


def pack_documents(docs: DataFrame, limit: int = LIMIT, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and the end id 0; null or empty text is the end id alone. Documents over `limit` are cut
    into pieces of `limit`, the first of which may be shorter; no other document is cut. Offsets of a sequence are
    gapless from 0. Null doc_ids pass through; repeated rows are separate documents; ties in length go by doc_id and
    piece. Empty table: empty result. Only doc_id and text are read.
    """
    return pack_pieces(materialize(piece_table(docs, limit, vocabulary, ranks), "pieces"), limit)
