"""Media columns, GIF: bytes kept losslessly as palette indices, and timed frames with colour histograms read back.

The writer lays 8-bit samples out as frames of 64 columns with a grey palette, LZW-coded. The reader takes any GIF: local
and global palettes, interlaced rows, transparency, the four disposal rules, delays. Code streams are cut into codes by
array arithmetic (between two clear codes the width of every code follows from its place) and expanded by the string
table. Both work on one medium after another inside tasks; rows are whole media or single frames.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The layout of stored payloads: columns, rows of a frame at most, hundredths of a second a frame is shown.
WIDTH, HEIGHT, DELAY = 64, 16_384, 10
#: Codes of a stream are at most so many bits.
MOST_BITS = 12
#: Bytes of samples or pixels gathered before a batch goes out.
OUT_BYTES = 8 << 20
#: Canvas pixels beyond which a medium counts as broken (a header of 10 bytes can claim 4 billion).
MOST_PIXELS = 1 << 26
#: First rows and steps of the passes of an interlaced frame.
PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


@lru_cache(64)
def _widths(bits: int, n: int) -> np.ndarray:
    """Bits of the n codes after a clear code, for samples of `bits` bits: the table has one entry more after each but the first."""
    entries = (1 << bits) + 1 + np.arange(n)
    return np.minimum(np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1, MOST_BITS)


def lzw_codes(samples: bytes, bits: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their widths; the table is cleared when it is full. Inside, codes stand eight bits up, for the next sample."""
    clear, runs, out = 1 << bits, [], []
    first, top = (clear + 2) << 8, ((1 << MOST_BITS) - 1) << 8
    table: dict[int, int] = {}
    get, add, following = table.get, out.append, first
    prefix = samples[0] << 8
    for b in memoryview(samples)[1:]:
        code = get(prefix | b)
        if code is not None:
            prefix = code
            continue
        add(prefix)
        if following < top:
            table[prefix | b] = following
            following += 256
        else:
            runs.append(out)
            out, following = [], first
            add = out.append
            table.clear()
        prefix = b << 8
    add(prefix)
    runs.append(out)
    codes, widths = [np.array([clear])], [np.array([bits + 1])]
    spans = _widths(bits, 1 << MOST_BITS)
    for k, run in enumerate(runs):
        codes += [np.array(run, np.int64) >> 8, np.array([clear + (k == len(runs) - 1)])]
        widths.append(spans[: len(run) + 1])
    return np.concatenate(codes), np.concatenate(widths)


def pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes one after another, least significant bits first."""
    out = []
    place = np.arange(MOST_BITS)
    carry = np.zeros(0, bool)
    for i in range(0, len(codes), 1 << 16):
        c, w = codes[i : i + (1 << 16)], widths[i : i + (1 << 16)]
        own = ((c[:, None] >> place) & 1).astype(bool)[place < w[:, None]]
        own = np.concatenate([carry, own])
        full = len(own) // 8 * 8 if i + (1 << 16) < len(codes) else len(own)
        out.append(np.packbits(own[:full], bitorder="little").tobytes())
        carry = own[full:]
    return b"".join(out)


def _sub_blocks(body: bytes) -> bytes:
    """Blocks of at most 255 bytes behind their lengths, and an empty one."""
    full, rest = divmod(len(body), 255)
    whole = np.frombuffer(body[: full * 255], np.uint8).reshape(full, 255)
    out = np.concatenate([np.full((full, 1), 255, np.uint8), whole], axis=1).tobytes()
    return out + (bytes([rest]) + body[full * 255 :] if rest else b"") + b"\0"


GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def encode_samples(samples: bytes, width: int = WIDTH, height: int = HEIGHT, delay: int = DELAY) -> bytes:
    """A GIF of samples, a multiple of width: rows of grey levels, a frame every `height` rows; frames replace the last."""
    if len(samples) % width:
        raise ValueError("samples must fill their rows")
    rows = len(samples) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, height), 0xF7, 0, 0), GREY]
    for first in range(0, rows, height):
        part = samples[first * width : (first + height) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        out.append(_sub_blocks(pack_codes(*lzw_codes(part))))
    return b"".join(out) + b"\x3b"


def unpack_samples(stream: bytes, bits: int, n: int) -> bytes:
    """The first n samples of a code stream. One that ends early or has a code that is not in the table gives fewer."""
    clear, most = 1 << bits, 1 << MOST_BITS
    body = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, at, out, have = 8 * len(stream), 0, [], 0
    roots = [bytes([k]) for k in range(clear)] + [b"", b""]
    table, last, place = list(roots), b"", 0  # last: the string before, empty after a clear code; place: codes since then
    spans = _widths(bits, most)
    while have < n:
        w = spans[place:] if place < len(spans) - 256 else np.full(most, MOST_BITS)
        start = at + np.cumsum(w) - w
        fit = int(np.searchsorted(start, total - w[-1], "right"))
        fit += int(np.searchsorted((start + w)[fit : fit + MOST_BITS], total, "right"))
        if not fit:
            break
        start, w = start[:fit], w[:fit]
        b = start >> 3
        codes = ((body[b] | body[b + 1] << 8 | body[b + 2] << 16) >> (start & 7).astype(np.uint32)) & ((1 << w) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        end = int(marks[0]) if len(marks) else fit
        part, broken = _strings(codes[:end].tolist(), table, last, clear, most)
        out.append(b"".join(part))
        have += len(out[-1])
        if broken or (len(marks) and codes[end] != clear):
            break
        if len(marks):
            table, last, place = list(roots), b"", 0
            at = int(start[end] + w[end])
        else:
            last, place = part[-1], place + fit
            at = int(start[-1] + w[-1])
    return b"".join(out)[:n]


def _strings(codes: list, table: list, last: bytes, clear: int, most: int) -> tuple[list, bool]:
    """The strings of codes between two clear codes, and whether one was not in the table, which grows with them."""
    out = []
    if not last and codes:
        if codes[0] >= clear:
            return out, True
        last = table[codes[0]]
        out.append(last)
        codes = codes[1:]
    room = max(0, most - len(table))
    put, add = out.append, table.append
    for c in codes[:room]:
        try:
            entry = table[c]
        except IndexError:
            if c != len(table):
                return out, True
            entry = last + last[:1]
        add(last + entry[:1])
        put(entry)
        last = entry
    out += [table[c] for c in codes[room:]]
    return out, False


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    samples: np.ndarray  # (height, width) palette indices
    palette: np.ndarray  # 256 colours, as on the canvas
    canvas: np.ndarray  # (rows, columns) after this frame: red, green, blue, alpha from the low byte up


@lru_cache(64)
def _colours(table: bytes) -> np.ndarray:
    """A palette as 256 opaque colours; those that it lacks are black."""
    out = np.zeros((256, 4), np.uint8)
    out[:, 3] = 255
    out[: len(table) // 3, :3] = np.frombuffer(table, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


def decode(media: bytes) -> Iterator[Frame]:
    """Frames in order, each with the canvas it leaves on show. A broken medium raises ValueError at the broken place."""

    def take(at: int, n: int) -> bytes:
        if at + n > len(media):
            raise ValueError("the medium ends early")
        return media[at : at + n]

    def blocks(at: int) -> tuple[bytes, int]:
        out = []
        while n := take(at, 1)[0]:
            out.append(take(at + 1, n))
            at += 1 + n
        return b"".join(out), at + 1

    def palette(at: int, flags: int) -> tuple[np.ndarray, int]:
        size = 3 << ((flags & 7) + 1)
        return _colours(take(at, size)), at + size

    if take(0, 6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    columns, rows, flags, _, _ = struct.unpack("<HHBBB", take(6, 7))
    if columns * rows > MOST_PIXELS:
        raise ValueError("the canvas is too large")
    at, shared = 13, None
    if flags & 0x80:
        shared, at = palette(at, flags)
    canvas = np.zeros((rows, columns), np.uint32)
    delay, disposal, transparent = 0, 0, None
    while (kind := take(at, 1)) != b"\x3b":
        if kind == b"\x21":
            label = take(at + 1, 1)
            body, at = blocks(at + 2)
            if label == b"\xf9" and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != b"\x2c":
            raise ValueError("an unknown block")
        left, top, width, height, flags = struct.unpack("<HHHHB", take(at + 1, 9))
        if width * height > MOST_PIXELS:
            raise ValueError("a frame is too large")
        colours, at = palette(at + 10, flags) if flags & 0x80 else (shared, at + 10)
        if colours is None:
            raise ValueError("a frame without a palette")
        bits = take(at, 1)[0]
        if not 1 <= bits <= 8:
            raise ValueError("samples are not of 1 to 8 bits")
        stream, at = blocks(at + 1)
        got = unpack_samples(stream, bits, width * height)
        if len(got) < width * height:
            raise ValueError("a code stream ends early")
        samples = np.frombuffer(got, np.uint8).reshape(height, width)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, height, step) for a, step in PASSES])
            straight = np.empty_like(samples)
            straight[order] = samples
            samples = straight
        before = canvas
        shown = canvas.copy()
        area = shown[top : top + height, left : left + width]
        seen = samples[: area.shape[0], : area.shape[1]]
        if transparent is None:
            area[...] = colours[seen]
        else:
            solid = seen != transparent
            area[solid] = colours[seen[solid]]
        yield Frame(left, top, width, height, delay, disposal, transparent, samples, colours, shown)
        if disposal == 3:
            canvas = before
        else:
            canvas = shown
            if disposal == 2:
                canvas = shown.copy()
                canvas[top : top + height, left : left + width] = 0
        delay, disposal, transparent = 0, 0, None


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of the visible pixels by the two high bits of red, green and blue: 64 bins."""
    flat = canvas.ravel()
    if flat.min(initial=1 << 24) < 1 << 24:
        flat = flat[flat >= 1 << 24]
    high = flat >> 6 & 0x30303  # fields at bits 0, 8 and 16; the product brings them together at bits 20, 18 and 16
    return np.bincount((high * np.uint32(1 << 20 | 1 << 10 | 1) >> 16 & 63).astype(np.intp), minlength=64)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every whole text as a GIF. Its UTF-8 bytes, with zero bytes up to a positive multiple of 64,
    are the samples. Null text is empty; null and repeated ids pass through, a row each. Other columns are not read."""

    def run(batches):
        for b in batches:
            ids, size, media, held = [], [], [], 0
            for d, text in zip(b.column(0), b.column(1)):
                body = b"" if (v := text.as_buffer()) is None else v.to_pybytes()
                padded = body + bytes(-len(body) % WIDTH or (0 if body else WIDTH))
                ids.append(d.as_py())
                size.append(len(body))
                media.append(encode_samples(padded))
                held += len(media[-1])
                if held > OUT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
                    ids, size, media, held = [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def frames(media: DataFrame, id_: str = "doc_id", column: str = "media", pixels: bool = True) -> DataFrame:
    """One row a frame: id, frame (from 0), start_ms, delay_ms, disposal, left, top, width, height, columns, rows, samples
    (the frame's own palette indices, row by row), pixels (RGBA of the canvas on show; null without `pixels`), histogram
    (64 counts of the canvas) and problem.

    Null media, media that are no GIF, and what follows a broken place of one give one row with the problem stated and
    frame null. A frame with the `user input` flag or no delay lasts 0 ms. Equal media give equal rows; ids pass through.
    """
    kind = media.schema[id_].dataType.simpleString()
    shape = f"{id_} {kind}, frame int, start_ms long, delay_ms long, disposal int, left int, top int, width int, height int, columns int, rows int, samples binary, pixels binary, histogram array<long>, problem string"
    names = ["frame", "start_ms", "delay_ms", "disposal", "left", "top", "width", "height", "columns", "rows", "samples", "pixels", "histogram", "problem"]
    types = [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 7, pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.string()]

    def run(batches):
        def out(rows, id_type):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], id_type), *(pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(types))], [id_, *names])

        for b in batches:
            rows, held = [], 0
            for d, m in zip(b.column(0).to_pylist(), b.column(1)):
                start = 0
                try:
                    if not m.is_valid:
                        raise ValueError("no medium")
                    for k, f in enumerate(decode(m.as_py())):
                        rgba = f.canvas.astype("<u4").tobytes() if pixels else None
                        rows.append((d, k, start, 10 * f.delay, f.disposal, f.left, f.top, f.width, f.height, f.canvas.shape[1], f.canvas.shape[0], f.samples.tobytes(), rgba, colour_histogram(f.canvas).tolist(), None))
                        start += 10 * f.delay
                        held += f.samples.size + 4 * pixels * f.canvas.shape[0] * f.canvas.shape[1]
                        if held > OUT_BYTES:
                            yield out(rows, b.column(0).type)
                            rows, held = [], 0
                except ValueError as e:
                    rows.append((d, *[None] * (len(names) - 1), str(e)))
            if rows:
                yield out(rows, b.column(0).type)

    return media.select(id_, column).mapInArrow(run, shape)


def features(media: DataFrame, keep: list[str], column: str = "media") -> DataFrame:
    """One row a medium: the columns of keep, n_frames, duration_ms, samples (of all frames, as the reader decoded them),
    histogram (summed over the canvases) and problem; what a medium holds before a broken place counts."""
    kinds = ", ".join(f"{c} {media.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for b in batches:
            first = 0
            rows, held = [], 0

            def out(i, j, rows):
                n, ms, samples, hist, problem = zip(*rows)
                own = [b.column(k).slice(i, j - i) for k in range(len(keep))]
                return pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int32()), pa.array(ms, pa.int64()), pa.array(samples, pa.binary()), pa.array(hist, pa.list_(pa.int64())), pa.array(problem, pa.string())], [*keep, "n_frames", "duration_ms", "samples", "histogram", "problem"])

            for k, m in enumerate(b.column(len(keep))):
                n, ms, parts, hist, problem = 0, 0, [], np.zeros(64, np.int64), None
                try:
                    if not m.is_valid:
                        raise ValueError("no medium")
                    for f in decode(m.as_py()):
                        n, ms = n + 1, ms + 10 * f.delay
                        parts.append(f.samples.tobytes())
                        hist += colour_histogram(f.canvas)
                except ValueError as e:
                    problem = str(e)
                rows.append((n, ms, b"".join(parts), hist.tolist(), problem))
                held += len(rows[-1][2])
                if held > OUT_BYTES:
                    yield out(first, k + 1, rows)
                    first, rows, held = k + 1, [], 0
            if rows:
                yield out(first, b.num_rows, rows)

    return media.select(*keep, column).mapInArrow(run, f"{kinds}, n_frames int, duration_ms long, samples binary, histogram array<long>, problem string")
