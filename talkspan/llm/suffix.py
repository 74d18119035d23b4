"""Removal of repeated byte strings by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte goes if some string of `length` bytes that covers it also starts earlier (smaller document key, or earlier in
the same document); strings never cross documents. Every window of `length` bytes has an anchor, the least hashed
gram inside it, so equal windows have equal anchors. Consecutive windows with one anchor form a fragment. Steps:

1. each task finds the fragments of its texts and collapses identical ones, by 128-bit codes of their bytes (the
   pre-aggregation);
2. fragments meet by anchor; identical ones keep their first place, and anchors with several different fragments
   ask for the bytes of one of each;
3. the asked fragments are indexed: the BWT of their concatenation, then breadth-first backward extension, which
   yields the common prefix of neighbouring suffixes by increasing value and stops at `length`; what has no value by
   then shares at least `length` bytes. In each such interval all but the first start are repeats;
4. ranges meet the texts by document.

Groups never grow without bound: a part of the anchors over HOT_PART_BYTES (known from the sizes of what step 1 wrote)
is dealt out again by fragment code, so its equal fragments still meet; as one anchor's fragments are then apart, they
are matched window by window, by 128-bit codes of all windows, dealt out by those, with collapse inside each text part.
The same is done for an anchor with more than HOT_FRAGMENTS different fragments in an ordinary part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, keyed, materialize, merge_ranges, mix, power_of_two, raw, text_bytes

BLOCK = 1 << 20
PART_BYTES = 4 << 20
BUCKET_BYTES = 1 << 19
HOT_FRAGMENTS = 2000
HOT_PART_BYTES = 32 << 20
FRAGMENT = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("key", "<u4"), ("doc", "<i8"), ("off", "<u4"), ("m", "<u2")])
RANGE = np.dtype([("doc", "<i8"), ("start", "<u4"), ("end", "<u4")])
ASK = np.dtype([("doc", "<i8"), ("off", "<u4"), ("m", "<u2"), ("key", "<u4"), ("hot", "<u1")])
WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8"), ("off", "<u4")])


# ---- anchors and fragments -------------------------------------------------------------------------------------


def gram_size(length: int) -> int:
    return 1 << max(0, (max(1, length // 3)).bit_length() - 1)


def fragments(data: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, start in data, number of windows, anchor hash) of all fragments; start is the first window's start."""
    q = gram_size(length)
    rows, starts, counts, keys = [], [], [], []
    at = 0
    while at < len(data):  # blocks overlap by a window; a fragment may be cut at a block's end
        block = data[at : at + BLOCK + length - 1]
        lo, n = at, len(block) - length + 1
        at += BLOCK
        if n <= 0:
            break
        h = block.astype(np.uint64) + np.uint64(1)
        step, base = 1, 0x9E3779B97F4A7C15
        while step < q:
            h = h[:-step] * np.uint64(base) + h[step:]
            base, step = base * base % (1 << 64), step * 2
        mix(h)
        low = (h & ~np.uint64((1 << 21) - 1)) | np.arange(len(h), dtype=np.uint64)
        w, s = length - q + 1, 1
        while 2 * s <= w:
            low = np.minimum(low[:-s], low[s:])
            s *= 2
        if w > s:
            low = np.minimum(low[: len(low) - (w - s)], low[w - s :])
        anchor = (low & np.uint64((1 << 21) - 1)).astype(np.int64)[:n]
        i0 = max(0, int(np.searchsorted(offs, lo, "right")) - 1)
        i1 = int(np.searchsorted(offs, lo + n, "left"))
        first = np.maximum(offs[i0:i1] - lo, 0)
        last = np.minimum(offs[i0 + 1 : i1 + 1] - length + 1 - lo, n)  # end of the row's window starts
        fit = last > first
        first, last, own = first[fit], last[fit], np.arange(i0, i1)[fit]
        if not len(own):
            continue
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, first, 1)
        np.add.at(edge, last, -1)
        valid = np.cumsum(edge[:n]) > 0
        new = np.ones(n, bool)
        new[1:] = anchor[1:] != anchor[:-1]
        new[first] = True
        st = np.flatnonzero(new & valid)
        r = np.searchsorted(first, st, "right") - 1
        en = np.minimum(np.append(st[1:], n), last[r])
        rows.append(own[r])
        starts.append(st + lo)
        counts.append(en - st)
        keys.append(h[anchor[st]])
    if not rows:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(counts), np.concatenate(keys)


def firsts(codes: tuple[np.ndarray, ...], doc: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of the first of each code, indices of all that come strictly later than their first)."""
    order = np.lexsort((off, doc, *codes))
    d, o = doc[order], off[order]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in codes])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
    later = (d != d[lead]) | (o != o[lead])
    return order[new], order[later]


def digests(view: memoryview, starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit codes of stretches of bytes, as two arrays."""
    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(view[s:e]) for s, e in zip(starts, ends)]), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _blobs(part: np.ndarray, rec: np.ndarray) -> tuple[list[int], list[bytes]]:
    order = np.argsort(part, kind="stable")
    part, rec = part[order], rec[order]
    at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return part[at].tolist(), [x.tobytes() for x in (np.split(rec, at[1:]) if len(part) else [])]


def _batch(kind: int, parts: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([kind] * len(parts), pa.int32()), pa.array(blobs, pa.binary())], ["part", "kind", "blob"])


def _doc_part(doc: np.ndarray, parts: int) -> np.ndarray:
    x = doc.astype(np.int64).view(np.uint64)
    return (x ^ x >> np.uint64(13) ^ x >> np.uint64(29)).view(np.int64) % parts


def doc_part(key: str, parts: int):
    """The column form of _doc_part; parts is odd."""
    c = F.col(key)
    return F.pmod(c.bitwiseXOR(F.shiftrightunsigned(c, 13)).bitwiseXOR(F.shiftrightunsigned(c, 29)), F.lit(parts).cast("long"))


def _ranges(doc, start, end, parts: int) -> tuple[list[int], list[bytes]]:
    doc, start, end = merge_ranges(doc, start, end)
    rec = np.empty(len(doc), RANGE)
    rec["doc"], rec["start"], rec["end"] = doc, start, end
    return _blobs(_doc_part(rec["doc"], parts), rec)


def _codes(rec: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return rec["h1"], rec["h2"]


# ---- Burrows-Wheeler index -------------------------------------------------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first depth symbols at least (prefix doubling)."""
    rank = text.astype(np.int64)
    h = 1
    order = np.argsort(rank, kind="stable")
    while True:
        new = np.ones(len(text), np.int64)
        if h == 1:
            new[1:] = rank[order[1:]] != rank[order[:-1]]
        else:
            new[1:] = key[order[1:]] != key[order[:-1]]  # noqa: F821
        new[0] = 0
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(new)
        if h >= depth or rank[order[-1]] == len(text) - 1:
            return order
        step = h
        key = rank * (len(text) + 1)
        key[: len(text) - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        h *= 2


def bounded_prefixes(text: np.ndarray, order: np.ndarray, length: int, ends: int) -> np.ndarray:
    """lcp[i] for suffixes order[i-1], order[i] where under length; -1 where length or more is shared.

    Breadth-first: intervals of strings of 0, 1, 2, ... symbols are extended backward on the transform; an interval's
    right border, where still open, gets the number of symbols as its value, and only then is the new interval kept.
    Symbols under `ends` are separators, each of which occurs once.
    """
    n = len(text)
    last = text[order - 1]  # the transform; order 0 wraps to the final separator
    by = np.argsort(last, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int64)
    lcp[0] = lcp[n] = 0
    lb, rb = np.zeros(1, np.int64), np.full(1, n, np.int64)
    wide = int(text.max()) + 1 if n else 1
    for value in range(length):
        if not len(lb):
            break
        size = rb - lb
        total = int(size.sum())
        group = np.repeat(np.arange(len(lb)), size)
        pos = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lb, size)
        sym = last[pos].astype(np.int64)
        if value:  # a separator's own border is set at value 0; nothing repeated reaches past one
            ok = sym >= ends
            group, pos, sym = group[ok], pos[ok], sym[ok]
        code = group * wide + sym
        o = np.argsort(code, kind="stable")  # keeps positions in order
        c = code[o]
        at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        count = np.diff(np.append(at, len(c)))
        left = lf[pos[o[at]]]
        right = left + count
        open_ = lcp[right] == -1
        lcp[right[open_]] = value
        # a right border that is already known needs no further extension: those of its extensions are known as well
        lb, rb = left[open_], right[open_]
    return lcp[:n]


def repeated_starts(texts: list[bytes] | tuple[np.ndarray, np.ndarray], length: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, start) of every window of length bytes that another one equals which comes first by place.

    place orders the texts' starts: rows (doc, off) of each text's first byte.
    """
    data, offs = texts
    n_t = len(offs) - 1
    sizes = np.diff(offs)
    sym = np.empty(len(data) + n_t, np.int32)
    begin = offs[:-1] + np.arange(n_t)
    body = np.ones(len(sym), bool)
    body[begin + sizes] = False
    sym[body] = data.astype(np.int32) + n_t
    sym[begin + sizes] = np.arange(n_t)
    order = suffix_order(sym, length)
    lcp = bounded_prefixes(sym, order, length, n_t)
    joined = lcp == -1
    group = np.cumsum(~joined)
    many = joined.copy()
    many[:-1] |= joined[1:]
    at, group = order[many], group[many]
    t = np.searchsorted(begin, at, "right") - 1
    rel = at - begin[t]
    _, later = firsts((group,), place["doc"][t], place["off"][t] + rel)
    return t[later], rel[later]


# ---- tasks -----------------------------------------------------------------------------------------------------


def _find(parts: int, doc_parts: int, length: int):
    def run(batches):
        for b in batches:
            data, offs = raw(b.column(1))
            doc = b.column(0).to_numpy(zero_copy_only=False)
            i, n = 0, len(doc)
            while i < n:
                j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + 4 * BLOCK, "right")) - 1))
                part = data[offs[i] : offs[j]]
                row, start, count, key = fragments(part, offs[i : j + 1] - offs[i], length)
                if len(row):
                    rec = np.empty(len(row), FRAGMENT)
                    rec["h1"], rec["h2"] = digests(memoryview(part.tobytes()), start.tolist(), (start + count + length - 1).tolist())
                    rec["key"] = (key >> np.uint64(32)).astype(np.uint32)
                    rec["doc"] = doc[i + row]
                    rec["off"] = start - (offs[i : j + 1] - offs[i])[row]
                    rec["m"] = count
                    keep, later = firsts(_codes(rec), rec["doc"], rec["off"])
                    keep.sort()
                    where = ((key[keep] & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
                    yield _batch(0, *_blobs(where, rec[keep]))
                    if len(later):
                        x = rec[later]
                        k, blobs = _ranges(x["doc"], x["off"], x["off"] + x["m"].astype(np.int64) + length - 1, doc_parts)
                        yield _batch(1, k, blobs)
                i = j

    return run


def _out(rows: list[tuple[int, list[int], list[bytes]]]) -> pa.Table:
    part = [p for _, ps, _ in rows for p in ps]
    kind = [k for k, ps, _ in rows for _ in ps]
    blob = [b for _, _, bs in rows for b in bs]
    return pa.table({"part": pa.array(part, pa.int64()), "kind": pa.array(kind, pa.int32()), "blob": pa.array(blob, pa.binary())})


def _records(table: pa.Table, kind: int, dtype: np.dtype) -> np.ndarray:
    own = table.filter(pc.equal(table.column("kind"), kind))
    data, _ = raw(own.column("blob"))
    return np.frombuffer(data.tobytes(), dtype)


def _asks(rep: np.ndarray, hot, doc_parts: int, part: int) -> tuple[int, list[int], list[bytes]]:
    ask = np.empty(len(rep), ASK)
    for f in ("doc", "off", "m", "key"):
        ask[f] = rep[f]
    ask["key"] ^= np.uint32(part * 2654435761 % (1 << 32))
    ask["hot"] = hot
    return (2, *_blobs(_doc_part(ask["doc"], doc_parts), ask))


def _resolve(doc_parts: int, length: int, hot: bool):
    """Collapse of the fragments of a part, or of a share of a hot one, all of whose fragments are asked for."""

    def run(key, table):
        rec = _records(table, 0, FRAGMENT)
        keep, later = firsts(_codes(rec), rec["doc"], rec["off"])
        x = rec[later]
        rows = [(1, *_ranges(x["doc"], x["off"].astype(np.int64), x["off"].astype(np.int64) + x["m"] + length - 1, doc_parts))]
        rep = rec[keep]
        if hot and len(rep):
            rows.append(_asks(rep, 1, doc_parts, int(key[0].as_py())))
        elif len(rep):
            rep = rep[np.argsort(rep["key"], kind="stable")]
            new = np.concatenate([[True], rep["key"][1:] != rep["key"][:-1]])
            size = np.diff(np.append(np.flatnonzero(new), len(rep)))
            size = np.repeat(size, size)
            rows.append(_asks(rep[size > 1], size[size > 1] > HOT_FRAGMENTS, doc_parts, int(key[0].as_py())))
        return _out(rows)

    return run


def _spread(batches):
    """Blobs of hot parts, cut into shares by fragment code; shares: how many of the part."""
    for b in batches:
        part, share, blobs = [], [], []
        for p, n, blob in zip(*(b.column(k).to_pylist() for k in range(3))):
            rec = np.frombuffer(blob, FRAGMENT)
            own, out = _blobs((rec["h2"] % np.uint64(n)).astype(np.int64), rec)
            part += [p] * len(own)
            share += own
            blobs += out
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([0] * len(part), pa.int32()), pa.array(blobs, pa.binary()), pa.array(share, pa.int64())], ["part", "kind", "blob", "share"])


def _fetch(buckets: int, length: int):
    def run(key, docs, asks):
        ask = _records(asks, 2, ASK)
        data, offs = raw(docs.column("text"))
        doc = docs.column("key").to_numpy()
        order = np.argsort(doc, kind="stable")
        at = np.searchsorted(doc[order], ask["doc"])
        row = order[np.minimum(at, len(order) - 1)] if len(order) else np.zeros(0, np.int64)
        rows = []
        cold = ask["hot"] == 0
        a, r = ask[cold], row[cold]
        s = offs[r] + a["off"]
        e = s + a["m"] + length - 1
        bucket = (mix(a["key"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        o = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[o])) + 1 if len(o) else []
        for g in np.split(o, cut) if len(o) else []:
            n = (e - s)[g]
            take = np.repeat(s[g] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            head = np.uint32(len(g)).tobytes() + a["doc"][g].tobytes() + a["off"][g].tobytes() + n.astype(np.uint32).tobytes()
            rows.append((3, [int(bucket[g[0]])], [head + data[take].tobytes()]))
        if not cold.all():
            a, r = ask[~cold], row[~cold]
            m = a["m"].astype(np.int64)
            t = np.repeat(np.arange(len(a)), m)
            off = a["off"].astype(np.int64)[t] + np.arange(len(t)) - np.repeat(np.cumsum(m) - m, m)
            at = offs[r][t] + off
            w = np.empty(len(t), WINDOW)
            w["h1"], w["h2"] = digests(memoryview(data.tobytes()), at.tolist(), (at + length).tolist())
            w["doc"], w["off"] = a["doc"][t], off
            keep, later = firsts(_codes(w), w["doc"], w["off"])
            rows.append((4, *_blobs((w["h2"][keep] % np.uint64(buckets)).astype(np.int64), w[keep])))
            x = w[later]
            rec = np.empty(len(x), RANGE)
            rec["doc"], rec["start"], rec["end"] = x["doc"], x["off"], x["off"] + np.uint32(length)
            rows.append((1, *_blobs(_doc_part(rec["doc"], buckets), rec)))
        return _out(rows)

    return run


def _index(doc_parts: int, length: int):
    def run(key, table):
        docs, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        place, size, body = [], [], []
        for blob in table.filter(pc.equal(table.column("kind"), 3)).column("blob").to_pylist():
            n = int(np.frombuffer(blob, np.uint32, 1)[0])
            p = np.empty(n, [("doc", "<i8"), ("off", "<i8")])
            p["doc"], p["off"] = np.frombuffer(blob, np.int64, n, 4), np.frombuffer(blob, np.uint32, n, 4 + 8 * n)
            place.append(p)
            size.append(np.frombuffer(blob, np.uint32, n, 4 + 12 * n).astype(np.int64))
            body.append(np.frombuffer(blob, np.uint8, -1, 4 + 16 * n))
        if place:
            place, size, body = np.concatenate(place), np.concatenate(size), np.concatenate(body)
            t, rel = repeated_starts((body, np.concatenate([[0], np.cumsum(size)])), length, place)
            docs.append(place["doc"][t])
            starts.append(place["off"][t] + rel)
        w = _records(table, 4, WINDOW)
        _, later = firsts(_codes(w), w["doc"], w["off"])
        docs.append(w["doc"][later])
        starts.append(w["off"][later].astype(np.int64))
        x = _records(table, 1, RANGE)
        docs, starts = np.concatenate(docs), np.concatenate(starts)
        rows = _ranges(np.append(docs, x["doc"]), np.append(starts, x["start"].astype(np.int64)), np.append(starts + length, x["end"].astype(np.int64)), doc_parts)
        return _out([(1, *rows)])

    return run


def repeat_ranges(texts: DataFrame, length: int, doc_parts: int, total: int) -> DataFrame:
    """Rows (part, blob): packed RANGE records of the bytes to remove; part is the document's part. texts: key, text."""
    parts = power_of_two(max(128, total / PART_BYTES))
    packed = "part long, kind int, blob binary"
    # kind 0: fragments by anchor; kind 1: ranges by document, found inside one task
    found = materialize(texts.mapInArrow(_find(parts, doc_parts, length), packed), "found")
    sizes = found.where("kind = 0").groupBy("part").agg(F.sum(F.octet_length("blob")).alias("n")).where(F.col("n") > HOT_PART_BYTES)
    hot = materialize(sizes.select("part", F.ceil(F.col("n") * 4 / HOT_PART_BYTES).cast("long").alias("shares")), "hot")  # under a row for HOT_PART_BYTES
    resolve = _side(_resolve(doc_parts, length, False), doc_parts)
    if hot.isEmpty():
        resolved = found.groupBy("part", "kind").applyInArrow(resolve, packed)
    else:
        cold = found.where("kind = 1").unionByName(found.where("kind = 0").join(hot, "part", "left_anti"))
        shares = found.where("kind = 0").join(hot, "part").select("part", "shares", "blob").mapInArrow(_spread, packed + ", share long")
        resolved = cold.groupBy("part", "kind").applyInArrow(resolve, packed).unionByName(shares.groupBy("part", "share").applyInArrow(_side(_resolve(doc_parts, length, True), doc_parts, False), packed))
    resolved = materialize(resolved, "resolved")
    discard(found)
    asked = resolved.where("kind = 2")
    n = asked.agg(F.sum(F.octet_length("blob")).alias("n")).first()["n"] or 0
    ranges = resolved.where("kind = 1").select("part", "blob")
    if n:
        buckets = power_of_two(max(128, n / ASK.itemsize * 150 / BUCKET_BYTES))
        by_part = texts.select("key", "text", doc_part("key", doc_parts).alias("part"))
        fetched = by_part.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(_fetch(buckets, length), packed)
        more = materialize(fetched.groupBy("part").applyInArrow(_index(doc_parts, length), packed), "indexed")
        ranges = ranges.unionByName(more.select("part", "blob"))
    return ranges


def _side(resolve, doc_parts: int, mixed: bool = True):
    def run(key, table):
        if mixed and key[1].as_py():
            x = _records(table, 1, RANGE)
            return _out([(1, *_ranges(x["doc"], x["start"].astype(np.int64), x["end"].astype(np.int64), doc_parts))])
        return resolve(key, table)

    return run


def _cut(length: int, as_text: bool, names: list[str], key_name: str):
    def run(key, docs, ranges):
        rec = _records(ranges, 1, RANGE)
        data, offs = raw(docs.column("text"))
        doc = docs.column(key_name).to_numpy()
        d, s, e = merge_ranges(rec["doc"], rec["start"].astype(np.int64), rec["end"].astype(np.int64))
        lo, hi = np.searchsorted(d, doc, "left"), np.searchsorted(d, doc, "right")
        spans, kept = [], []
        for i in range(len(doc)):
            body = data[offs[i] : offs[i + 1]].tobytes()
            if lo[i] == hi[i]:
                spans.append([])
                kept.append(body.decode() if as_text else body)
                continue
            own = [(a, min(b, len(body))) for a, b in zip(s[lo[i] : hi[i]].tolist(), e[lo[i] : hi[i]].tolist()) if a < len(body)]
            spans.append([{"start": a, "end": b} for a, b in own])
            out, at = [], 0
            for a, b in own:
                if as_text:  # a code point that is removed in part stays
                    while a < b and body[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(body) and body[b] & 0xC0 == 0x80:
                        b -= 1
                out.append(body[at:a])
                at = b
            out.append(body[at:])
            kept.append(b"".join(out).decode() if as_text else b"".join(out))
        if as_text:
            text = pa.array(kept, pa.string())
            cols = {c: text if c == "text" else docs.column(c) for c in names}
            if "n_chars" in names:
                cols["n_chars"] = pc.utf8_length(text).cast(pa.int64())
            return pa.table(cols)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": docs.column("doc_id"), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary())})

    return run


def _apply(docs: DataFrame, length: int, as_text: bool, out: str, names: list[str]) -> DataFrame:
    total = text_bytes(docs)
    doc_parts = power_of_two(max(64, total / PART_BYTES)) + 1
    key, part = fresh(docs, "key"), fresh(docs, "part")
    texts = keyed(docs, key).withColumn("text", F.coalesce("text", F.lit("")))
    ranges = repeat_ranges(texts.select(F.col(key).alias("key"), "text"), length, doc_parts, total)
    texts = texts.withColumn(part, doc_part(key, doc_parts))
    ranges = ranges.select(F.col("part").alias(part), F.lit(1).alias("kind"), "blob")
    return texts.groupBy(part).cogroup(ranges.groupBy(part)).applyInArrow(_cut(length, as_text, names, key), out)


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """One row per document: doc_id, spans (array of start, end byte offsets to remove), kept (the remaining bytes).

    Null text counts as empty: no spans, empty kept. Texts under `length` bytes keep all. Of equal documents the first
    by doc_id stays whole and the others lose everything (if long enough). Rows with a null doc_id follow all others.
    Different texts of one doc_id are different documents, in the order of their hash. Rows that repeat a doc_id and
    text start at the same place, so neither is earlier: all get the same result. Empty table: empty result. Other
    columns are not read. Fragments and ranges are written while this is called.
    """
    return _apply(docs.select("doc_id", "text"), length, False, "doc_id long, spans array<struct<start:long,end:long>>, kept binary", [])


def drop_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """The documents with repeated bytes cut from text; a code point removed in part stays. Columns are unchanged.

    n_chars, where present, is counted anew. Documents with nothing left (whole repeats) go.
    """
    names = docs.columns
    out = _apply(docs, length, True, docs.schema, names)
    return out.where(F.col("text") != "")
