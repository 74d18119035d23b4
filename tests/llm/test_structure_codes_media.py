"""Structure repair, vector codes and GIF columns against brute force, hand-worked media and exact round trips."""

import hashlib
import heapq
import random
import struct
import zlib

import numpy as np
import pytest

from talkspan.llm import gif, registry, repair, veccodes

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


# ---- structure repair ------------------------------------------------------------------------------------------


def cheapest(rows, faults):
    """Cost, audit and lines by shortest paths over (row, last role), least audits first."""
    following = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (i, last) in done:
            continue
        done.add((i, last))
        to = following[last]
        name = "user" if to == "u" else "assistant"
        heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*lines, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, lines))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to, (*lines, f"{name}:{text}")))
                if role[:1] == to or role[:1] == "s" and last == "":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))


def conversation(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    stated = [t for t, _, _ in rows if t is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, text = cheapest(rows, faults)
    gaps = max(stated) - min(stated) + 1 - len(set(stated)) if stated else 0
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damaged(rows):
    out, said = {}, lambda v: " " if v is None else str(v)
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        own = out.setdefault(conv, [])
        if fault == 1:
            text = ""
        elif fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif fault == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return {c: conversation(r) for c, r in out.items()}


def repaired(df):
    return {r.conv_id: tuple(r)[1:] for r in repair.digests(df).collect()}


def random_turns(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "Why?", "So.\n", "ça", "x" * 5000 + "!", None]
    roles = ["user", "assistant", "system", "usher", "tool", "", "User", "été", None]
    turn = lambda n: rng.choice([None, rng.randrange(n + 1), rng.randrange(3 * n + 1) - n])
    return [(rng.choice([c, c, c, None]), turn(n), rng.choice(roles), rng.choice(texts)) for c in range(conversations) for n in [rng.randrange(1, most)] for _ in range(n)]


def test_structure_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in registry.op11_structure_repair(spark, SF).collect()}
    assert got == damaged(rows)


@pytest.mark.parametrize("piece_rows", [10_000, 7, 1])
def test_structure_in_pieces(spark, piece_rows):
    """Null, tied and repeated rows; with small pieces every conversation lies in many."""
    rows = random_turns(piece_rows, 40, 14)
    df = spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", piece string")
    assert repaired(repair.repair_conversations(repair.damage(df), "present", piece_rows)) == damaged(rows)


def test_structure_long_conversation(spark):
    rows = [(1, t, ("user", "assistant", "tool")[t * t % 3], f"turn {t % 170}{'.' * (t % 5 > 0)}") for t in range(700)] + [(2, 0, "user", "Hello."), (2, 1, "assistant", "Yes.")]
    got = repaired(repair.repair_conversations(spark.createDataFrame(rows, TURNS).repartition(3), piece_rows=64))
    assert got == {c: conversation([r[1:] for r in rows if r[0] == c]) for c in (1, 2)}
    assert got[2][5:7] == (0, "KK")


def test_structure_by_hand(spark):
    def audit(*rows):
        df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(rows)], TURNS)
        (r,) = repair.repair_conversations(df).collect()
        return r.cost, r.audit, r.repaired

    assert audit(("user", "Q?"), ("assistant", "A.")) == (0, "KK", "user:Q?\nassistant:A.")
    assert audit(("system", "S.")) == (4, "D", "")  # not two inserts for 6
    assert audit(("user", "Q?")) == (3, "KI", "user:Q?\nassistant:")
    assert audit(("user", "Q"), ("assistant", "A.")) == (3, "KK", "user:Q\nassistant:A.")
    assert audit(("user", "Q?"), ("user", "R?")) == (3, "KR", "user:Q?\nassistant:R?")


def test_structure_empty_and_dropped(spark):
    assert repaired(repair.repair_conversations(spark.createDataFrame([], TURNS))) == {}
    gone = spark.createDataFrame([(5, 1, "user", "x", False), (None, 1, "user", "y", None)], TURNS + ", here boolean")
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repaired(repair.repair_conversations(gone, "here")) == {5: nothing, None: nothing}


# ---- vector codes ----------------------------------------------------------------------------------------------


def coded(rows, parts=16, entries=64, rounds=2):
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not rows:
        return []
    v = np.floor(np.array([r[1] for r in rows], float) * 256).astype(int).reshape(len(rows), parts, -1)
    books = v[:entries].transpose(1, 0, 2).copy()
    spans = lambda: ((v[:, :, None, :] - books[None]) ** 2).sum(axis=-1)
    for _ in range(rounds):
        own = spans().argmin(axis=-1)
        for p in range(parts):
            for e in range(books.shape[1]):
                if (own[:, p] == e).any():
                    books[p, e] = v[own[:, p] == e, p].sum(axis=0) // (own[:, p] == e).sum()
    codes, error = spans().argmin(axis=-1), spans().min(axis=-1).sum(axis=1)
    by = {}
    for r, e in zip(rows, error):
        by[r[2]] = by.get(r[2], 0) + int(e)
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel()).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{x:02x}" for x in c), int(e), by[r[2]], digest) for r, c, e in zip(rows, codes, error)), key=str)


def test_codes_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(map(tuple, registry.op12_vector_codes(spark, SF).collect()), key=str) == coded(rows)


def compressed(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, error int")
    return sorted(map(tuple, veccodes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes_edge_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i) if i % 9 else None, (rng.normal(size=32) * (100 if i % 7 == 0 else 1)).tolist(), int(i) % 4 or None) for i in range(300)]
    rows += rows[20:40]  # repeated rows
    rows += [(3, rows[5][1], 1), (3, rows[6][1], 2)]  # one id, several vectors
    bad = [(1000, None, 1), (1001, [None] + [0.0] * 31, 1), (1002, [float("nan")] * 32, 2), (1003, [float("inf")] * 32, 2), (-5, [float("-inf")] * 32, 2)]
    assert compressed(spark, rows + bad) == coded(rows)
    assert compressed(spark, rows[:5] + bad) == coded(rows[:5])  # fewer rows than entries
    assert compressed(spark, [(k, [0.0] * 16, None) for k in range(70)]) == coded([(k, [0.0] * 16, None) for k in range(70)])  # ties
    assert compressed(spark, bad) == [] == compressed(spark, [])


def test_codes_refuse_other_shapes(spark):
    with pytest.raises(ValueError):
        compressed(spark, [(1, [1.0] * 15, 1)])
    with pytest.raises(Exception, match="components"):
        compressed(spark, [(1, [1.0] * 16, 1), (2, [1.0] * 32, 1)])
    with pytest.raises(Exception, match="or more"):
        compressed(spark, [(1, [1.0] * 16, 1), (2, [1e30] * 16, 1)])


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(1)
    entries, parts = rng.integers(-90, 90, (64, 4)), rng.integers(-120, 120, (1000, 4))
    cells = veccodes.Cells.of(entries)
    lower, upper = veccodes.bounds(parts, cells)
    exact = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (lower <= exact).all() and (exact <= upper).all()
    code, error, refined = veccodes.nearest(parts, entries, cells)
    assert (code == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()
    assert refined < 0.2 * exact.size


# ---- GIF -------------------------------------------------------------------------------------------------------

#: A published sample: 10 x 10 pixels of four colours.
SAMPLE = bytes.fromhex("474946383961 0a000a00910000 ffffff ff0000 0000ff 000000 21f9040000000000 2c000000000a000a0000 02 16 8c2d99872a1cdc33a00275ec95faa8de608c04914c01 00 3b")


def slow_unpack(stream, bits):
    """A bit-by-bit reader, to the end code."""
    clear, out, at, value = 1 << bits, b"", 0, int.from_bytes(stream, "little")
    table, size, last = [bytes([k]) for k in range(clear)] + [b"", b""], bits + 1, None
    while True:
        c = value >> at & (1 << size) - 1
        at += size
        if c == clear:
            table, size, last = table[: clear + 2], bits + 1, None
            continue
        if c == clear + 1:
            return out
        entry = table[c] if c < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        out, last = out + entry, entry
        if len(table) == 1 << size and size < 12:
            size += 1


@pytest.mark.parametrize("bits", [2, 3, 5, 8])
@pytest.mark.parametrize("n", [1, 2, 3, 300, 9000])
def test_lzw_round_trip(bits, n):
    rng = random.Random(bits * n)
    for body in (bytes(rng.randrange(1 << bits) for _ in range(n)), bytes(n), bytes(k // 7 % (1 << bits) for k in range(n))):
        stream = gif.pack_codes(*gif.lzw_codes(body, bits))
        assert slow_unpack(stream, bits) == body
        assert gif.unpack_samples(stream, bits, n) == body


def test_lzw_late_clear_and_broken_streams():
    """Writers may leave a full table as it is; streams may end early or name codes that do not exist."""
    rng = random.Random(9)
    body = bytes(rng.randrange(256) for _ in range(6000))
    codes = np.array([256, *body, 257])
    widths = np.array([9, *gif._widths(8, len(body) + 1)])
    stream = gif.pack_codes(codes, widths)
    assert slow_unpack(stream, 8) == body == gif.unpack_samples(stream, 8, 6000)
    assert body.startswith(short := gif.unpack_samples(stream[:2000], 8, 6000)) and 1000 < len(short) < 6000
    assert gif.unpack_samples(gif.pack_codes(np.array([256, 65, 400, 257]), np.array([9, 9, 9, 9])), 8, 9) == b"A"
    assert gif.unpack_samples(b"", 8, 9) == b""


def rgba(f):
    return f.canvas.astype("<u4")[..., None].view(np.uint8)


def test_published_sample():
    (f,) = gif.decode(SAMPLE)
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert f.samples.tolist() == [[int(c) for c in r] for r in rows]
    assert rgba(f)[0, 0].tolist() == [255, 0, 0, 255] and rgba(f)[0, 9].tolist() == [0, 0, 255, 255]
    hist = gif.colour_histogram(f.canvas)
    assert {k: int(n) for k, n in enumerate(hist) if n} == {63: 16, 48: 42, 3: 42}


def frame(samples, left, top, width, height, disposal, delay, transparent=None, palette=None, interlaced=False):
    control = b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (transparent is not None), delay, transparent or 0) + b"\0"
    flags = (0x81 if palette else 0) | (0x40 if interlaced else 0)
    head = b"\x2c" + struct.pack("<HHHHB", left, top, width, height, flags) + (palette or b"")
    return control + head + b"\x02" + gif._sub_blocks(gif.pack_codes(*gif.lzw_codes(bytes(samples), 2)))


def movie(*parts, width=3, height=2):
    colours = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    return b"GIF89a" + struct.pack("<HHBBB", width, height, 0x81, 0, 0) + colours + b"".join(parts) + b"\x3b"


def test_disposal_transparency_and_palettes():
    media = movie(
        b"\x21\xfe\x02hi\0",  # a comment
        frame([0] * 6, 0, 0, 3, 2, 1, 10),
        frame([1, 3], 0, 0, 2, 1, 3, 20, transparent=3),  # shown, then the canvas before it comes back
        frame([2], 2, 1, 1, 1, 2, 30),  # shown, then its place is cleared
        frame([0], 1, 0, 1, 1, 0, 0, palette=bytes([7, 8, 9] * 4)),
        frame([1, 1, 1, 1], 2, 1, 2, 2, 0, 5),  # reaches out of the canvas
    )
    show = lambda f: ["".join({(255, 0, 0, 255): "r", (0, 255, 0, 255): "g", (0, 0, 255, 255): "b", (7, 8, 9, 255): "x", (0, 0, 0, 0): "."}[tuple(p)] for p in row) for row in rgba(f).tolist()]
    seen = list(gif.decode(media))
    assert [show(f) for f in seen] == [["rrr", "rrr"], ["grr", "rrr"], ["rrr", "rrb"], ["rxr", "rr."], ["rxr", "rrg"]]
    assert [(f.delay, f.disposal) for f in seen] == [(10, 1), (20, 3), (30, 2), (0, 0), (5, 0)]


def test_interlaced_rows():
    order = [0, 8, 4, 2, 6, 10, 1, 3, 5, 7, 9]
    (f,) = gif.decode(movie(frame([r % 4 for r in order], 0, 0, 1, 11, 0, 0, interlaced=True), width=1, height=11))
    assert f.samples[:, 0].tolist() == [r % 4 for r in range(11)]


def test_frames_table(spark):
    good = movie(frame([0] * 6, 0, 0, 3, 2, 1, 10), frame([1], 0, 0, 1, 1, 0, 7))
    rows = [(1, good), (2, None), (3, b"no"), (4, good[:-12]), (None, good), (1, good)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, media binary, frame string")
    got = gif.frames(df).collect()
    seen = sorted(((r.doc_id or 0, r.frame, r.start_ms, r.delay_ms, r.problem) for r in got), key=str)
    both = lambda d: [(d, 0, 0, 100, None), (d, 1, 100, 70, None)]
    broken = [(2, None, None, None, "no medium"), (3, None, None, None, "the medium ends early"), (4, 0, 0, 100, None), (4, None, None, None, "the medium ends early")]
    assert seen == sorted(both(1) * 2 + both(0) + broken, key=str)
    (second,) = {(bytes(r.samples), bytes(r.pixels), tuple(r.histogram)) for r in got if r.frame == 1}
    assert second[0] == b"\1" and second[1] == bytes([0, 255, 0, 255] + [255, 0, 0, 255] * 5) and second[2][12] == 1 and second[2][48] == 5
    whole = gif.features(df, ["doc_id"]).collect()
    assert sorted((r.doc_id or 0, r.n_frames, r.duration_ms, r.problem or "") for r in whole) == [(0, 2, 170, ""), (1, 2, 170, ""), (1, 2, 170, ""), (2, 0, 0, "no medium"), (3, 0, 0, "the medium ends early"), (4, 1, 100, "the medium ends early")]


def payload(text):
    body = (text or "").encode()
    return len(body), body + bytes(-len(body) % 64) or bytes(64)


def test_texts_as_gifs(spark):
    texts = [None, "", "a", "x" * 64, "é" * 33, "long text " * 300_000, "a", "\0" * 10]
    docs = spark.createDataFrame([(k if k else None, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in gif.features(gif.store(docs), ["doc_id", "n_bytes", "media"]).collect()}
    for k, t in enumerate(texts):
        r = got[k if k else None]
        n, body = payload(t)
        assert (r.n_bytes, bytes(r.samples), r.problem) == (n, body, None)
        assert r.n_frames == -(-len(body) // (64 * gif.HEIGHT)) and sum(r.histogram) == r.n_frames * min(len(body), 64 * gif.HEIGHT)
    assert got[2].media == got[6].media and got[None].media == got[1].media
    assert gif.features(gif.store(docs.limit(0)), ["doc_id", "media"]).count() == 0


def test_gif_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.op13_gif(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n, body = payload(docs[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        media = gif.encode_samples(body)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and r.feature.startswith("1 frames 100 ms ")
