"""Conversation structure repair: the cheapest edits that make a conversation `(s?(ua)+)?`, by role initials.

Turns are dealt by ranges of (conversation, turn), so a conversation of any length may lie in many tasks. Each task cuts
its sorted batches into pieces, one row a conversation and batch. Pieces inside a batch are whole conversations: they are
bucketed by length and solved together, time-major: one tensor of row codes (turn x conversation), a backward pass that
updates the costs of all conversations for one turn at a time, and a trace that takes one edit of all of them at a time.
Pieces at a batch's ends may go on in the next one. Their rows become codes of one byte, which are put together by
conversation (as long as its audit, which is one value anyway), solved the same way, and dealt back to the pieces.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import SPACES, materialize, raw

#: Costs of the edits. A row that is kept or gets another role costs TRUNCATED more if its text is cut off.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States by what was written last: nothing, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn that the grammar allows next, and the state after keeping a row of a role.
NEXT = np.array([USER, USER, ASSISTANT, USER])
KEEP = np.full((4, 4), -1)
KEEP[START, SYSTEM] = SYSTEM
KEEP[[START, SYSTEM, ASSISTANT], USER] = USER
KEEP[USER, ASSISTANT] = ASSISTANT
LEGAL = [(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)]
#: Row codes: the role (0 for any other) plus flags.
CUT_OFF, GONE, PAD = 4, 8, 16
NEVER = 1 << 40
#: Letters in the order in which ties are decided.
LETTERS = np.frombuffer(b"DIKR", np.uint8)
#: Rows of a batch, and so of a piece at most.
PIECE_ROWS = 10_000
#: Cells (turns x conversations) of one tensor at most, or one conversation.
CELLS = 1 << 20

STATS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired string"


def backward(codes: np.ndarray) -> np.ndarray:
    """Least costs to the end, (turns + 1, states, conversations), of time-major codes (turns, conversations)."""
    n, many = codes.shape
    out = np.empty((n + 1, 4, many), np.int64)

    def inserts(b):
        for _ in range(2):  # two inserts reach every state that has an end
            np.minimum(b, INSERT + b[NEXT], out=b)

    out[n] = NEVER
    out[n, [START, ASSISTANT]] = 0
    inserts(out[n])
    for t in range(n - 1, -1, -1):
        row, after, now = codes[t], out[t + 1], out[t]
        now[:] = DELETE + after
        extra = np.where(row & CUT_OFF, TRUNCATED, 0)
        extra = np.where(row & GONE, NEVER, extra)
        np.minimum(now, REROLE + extra + after[NEXT], out=now)
        for s in range(4):
            for role in (SYSTEM, USER, ASSISTANT):
                if KEEP[s, role] >= 0:
                    now[s] = np.where((row & 3) == role, np.minimum(now[s], extra + after[KEEP[s, role]]), now[s])
        inserts(now)
        now[:] = np.where(row & PAD, after, now)
    return out


def trace(codes: np.ndarray, costs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits as (steps, conversations) letters, 0 after the end, and the row of each edit; the ASCII-least of the cheapest."""
    n, many = codes.shape
    at, state, who = np.zeros(many, np.int64), np.zeros(many, np.int64), np.arange(many)
    letters, rows = [], []
    codes = np.vstack([codes, np.full((1, many), PAD, codes.dtype)])
    while True:
        row = codes[at, who]
        here, best = np.minimum(at + 1, n), costs[at, state, who]
        inside = row & PAD == 0
        if not (inside | (best > 0)).any():
            break
        onward, kept = NEXT[state], KEEP[state, row & 3]
        extra = np.where(row & GONE, NEVER, np.where(row & CUT_OFF, TRUNCATED, 0))
        ways = np.stack(
            [
                np.where(inside, DELETE + costs[here, state, who], NEVER),
                INSERT + costs[at, onward, who],
                np.where(inside & (kept >= 0), extra + costs[here, kept, who], NEVER),
                np.where(inside, REROLE + extra + costs[here, onward, who], NEVER),
            ]
        )
        pick = np.argmax(ways == best, axis=0)
        live = inside | (best > 0)
        letters.append(np.where(live, LETTERS[pick], 0).astype(np.uint8))
        rows.append(at.copy())
        state = np.where(live, np.choose(pick, [state, onward, kept, onward]), state)
        at = np.where(live & (pick != 1), here, at)
    if not letters:
        return np.zeros((0, many), np.uint8), np.zeros((0, many), np.int64)
    return np.stack(letters), np.stack(rows)


def solve(codes: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """The audit of each conversation: conversations are bucketed by length, to powers of two, and solved by buckets."""
    size = np.diff(offs)
    audits = [b""] * len(size)
    level = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for k in np.unique(level[size > 0]):
        bucket = np.flatnonzero((level == k) & (size > 0))
        step = max(1, CELLS >> int(k))
        for i in range(0, len(bucket), step):
            own = bucket[i : i + step]
            turns = np.arange(int(size[own].max()))[:, None]
            inside = turns < size[own]
            block = np.where(inside, codes[np.where(inside, offs[own] + turns, 0)], PAD).astype(np.uint8)
            letters, _ = trace(block, backward(block))
            for c, column in zip(own, np.ascontiguousarray(letters.T)):
                audits[c] = column[column > 0].tobytes()
    return audits


def row_codes(roles: pa.Array, texts: pa.Array, conversation: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes and the faults blank, duplicate, truncated (the first of each row) of rows in order."""
    data, offs = raw(roles)
    first = np.concatenate([data, [0]])[np.minimum(offs[:-1], len(data))]
    role = np.where(offs[1:] > offs[:-1], np.select([first == ord(c) for c in "sua"], [SYSTEM, USER, ASSISTANT], 0), 0)
    data, offs = raw(texts)
    solid = np.flatnonzero(~SPACES[data])
    last = np.searchsorted(solid, offs[1:]) - 1
    end = np.where(last >= 0, solid[np.maximum(last, 0)], -1) if len(solid) else np.full(len(offs) - 1, -1)
    blank = end < offs[:-1]
    again = pd.DataFrame({"c": conversation, "r": roles.to_pandas(), "t": texts.to_pandas()}).duplicated().to_numpy()
    if seen is not None:
        again |= seen
    duplicate = again & ~blank
    truncated = ~blank & ~duplicate
    if len(data):
        truncated &= ~np.isin(data[np.maximum(end, 0)], list(b".!?"))
    codes = role + np.where(truncated, CUT_OFF, 0) + np.where(blank | duplicate, GONE, 0)
    return codes.astype(np.uint8), blank, duplicate, truncated


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return c[offs[1:]] - c[offs[:-1]]


def _between(turns: pa.Array, codes: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Missing turns and illegal neighbours between the rows of each piece."""
    n = len(codes)
    missing, wrong = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n:
        some = ~np.asarray(turns.is_null())
        t = turns.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        inner = np.ones(n, bool)
        inner[offs[:-1][np.diff(offs) > 0]] = False
        both = inner[1:] & some[1:] & some[:-1]
        missing[1:] = np.where(both, np.maximum(np.diff(t) - 1, 0), 0)
        role = codes & 3
        fine = np.logical_or.reduce([(role[:-1] == a) & (role[1:] == b) for a, b in LEGAL])
        wrong[1:] = inner[1:] & ~fine
    return _sums(missing, offs), _sums(wrong, offs)


def _written(audit: bytes, roles: list, texts: list, state: int = START) -> tuple[str, int]:
    """The repaired turns, a line each, and the state after them."""
    out, i = [], 0
    for a in audit:
        if a == 68:  # D
            i += 1
        elif a == 75:  # K
            out.append(f"{roles[i]}:{texts[i]}")
            state = int(KEEP[state, {"s": SYSTEM, "u": USER, "a": ASSISTANT}[roles[i][0]]])
            i += 1
        else:  # I, R
            state = int(NEXT[state])
            out.append(f"{'user' if state == USER else 'assistant'}:{texts[i] if a == 82 else ''}")
            i += a == 82
    return "\n".join(out), state


def _cost(audit: bytes, codes: np.ndarray) -> int:
    done = np.frombuffer(audit, np.uint8)
    taken = done[done != 73]
    return int((done == 73).sum() * INSERT + (done == 82).sum() * REROLE + (done == 68).sum() * DELETE + ((taken != 68) & (codes[: len(taken)] & CUT_OFF > 0)).sum() * TRUNCATED)


def _finished(turns, roles, texts, offs, codes, faults, audits, states=None) -> dict:
    missing, wrong = _between(turns, codes, offs)
    r, t = roles.to_pylist(), texts.to_pylist()
    out = {"gaps": missing, "illegal": wrong, **{k: _sums(f, offs) for k, f in zip(("blank", "duplicate", "truncated"), faults)}}
    out["cost"] = np.array([_cost(a, codes[i:j]) for a, i, j in zip(audits, offs[:-1], offs[1:])], np.int64)
    out["repaired"] = [_written(a, r[i:j], t[i:j], s)[0] for a, i, j, s in zip(audits, offs[:-1], offs[1:], states or [START] * len(audits))]
    out["audit"] = [a.decode() for a in audits]
    return out


def _same(ids: pa.Array) -> np.ndarray:
    """Whether each id equals the one before it, nulls alike."""
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    return np.asarray(pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null())))


def repair_conversations(turns: DataFrame, present: str | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row a piece of a conversation: conv_id, piece, whole, its own gaps, blank, duplicate, truncated, illegal and
    cost, and its audit and repaired turns (`role:text` lines).

    A conversation with whole has this one piece. Of others, sums over the pieces and the audits and lines in the order of
    `piece` make the conversation; what lies between two pieces counts for the later one. Rows are taken by turn, nulls
    first, then role and text. A null role or text is one space (so the role is neither, the text is blank); null conv_ids
    are one conversation. Edits and costs: Keep 0, Rerole to user or assistant 3, Delete 4 (forced for blank texts and for
    a role and text seen earlier in the conversation), Insert of an empty user or assistant turn 3; a row that stays costs
    3 more if its last character that is no white space is not one of `.!?`. Of the cheapest audits the ASCII-least is
    taken. Rows whose `present` column is false only name their conversation, which may come out empty: zeros, an empty
    audit and no lines. Empty table: no rows. Other columns are not read. Equal rows of a conversation and turn go to one
    task, which streams them. A table of pieces is written while this is called.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
        (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"),
    )
    order = ["conv_id", "turn", "role", "text"]
    dealt = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 16), F.substring("text", 1, 32)).sortWithinPartitions(*order)
    raw_lists = "turns array<long>, roles array<string>, texts array<string>"
    shape = f"conv_id {kind}, piece long, whole boolean, {STATS}, {raw_lists}"

    def pieces(batches):
        number = TaskContext.get().partitionId() << 36
        for b in (x.slice(i, piece_rows) for x in batches for i in range(0, x.num_rows, piece_rows)):
            ids = b.column(0)
            first = np.concatenate([[0], np.flatnonzero(~_same(ids)) + 1, [len(ids)]])
            here = np.asarray(b.column(4))
            offs = np.concatenate([[0], np.cumsum(here)])[first]
            turn, role, text = (b.column(k).filter(pa.array(here)) for k in (1, 2, 3))
            n = len(first) - 1
            whole = np.ones(n, bool)
            whole[[0, -1]] = False
            codes, *faults = row_codes(role, text, np.repeat(np.arange(n), np.diff(offs)))
            done = _finished(turn, role, text, offs, codes, faults, solve(codes, offs))
            inner = pa.array(whole)
            o = pa.array(np.where(whole, 0, 1) * np.diff(offs)).cast(pa.int32())
            bounds = pa.array(np.concatenate([[0], np.cumsum(o.to_numpy())]).astype(np.int32))
            border = pa.array(np.repeat(~whole, np.diff(offs)))
            columns = {"conv_id": ids.take(pa.array(first[:-1])), "piece": pa.array(number + np.arange(n)), "whole": inner}
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost"):
                columns[c] = pc.if_else(inner, pa.array(done[c], pa.int64()), pa.scalar(None, pa.int64()))
            for c in ("audit", "repaired"):
                columns[c] = pc.if_else(inner, pa.array(done[c], pa.string()), pa.scalar(None, pa.string()))
            for c, v in (("turns", turn), ("roles", role), ("texts", text)):
                columns[c] = pa.ListArray.from_arrays(bounds, v.filter(border))
            number += n
            yield pa.RecordBatch.from_pydict(columns)

    table = materialize(dealt.mapInArrow(pieces, shape), "pieces")
    names = ["conv_id", "piece", "whole", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
    return table.where("whole").select(*names).unionByName(_across(table.where("not whole"), kind).select(*names))


def _across(parts: DataFrame, kind: str) -> DataFrame:
    """The pieces of conversations that may lie in several of them, finished."""
    key = F.transform(
        F.arrays_zip("roles", "texts"),
        lambda x: F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.col("conv_id").isNull().cast("string"), F.length(x["roles"]).cast("string"), x["roles"], x["texts"])),
    )
    keyed = parts.withColumn("keys", key)
    found = keyed.select("piece", F.explode("keys").alias("key")).distinct().groupBy("key").agg(F.collect_list("piece").alias("p")).where("size(p) > 1")
    later = found.select("key", F.explode(F.array_except("p", F.array(F.array_min("p")))).alias("piece"))
    seen = later.groupBy("piece").agg(F.collect_list("key").alias("seen"))
    ready = keyed.join(seen, "piece", "left")

    def coded(batches):
        for b in batches:
            out = {"conv_id": b.column("conv_id"), "piece": b.column("piece")}
            many = [[], [], []]
            for k, before, turn, roles, texts in zip(b.column("keys").to_pylist(), b.column("seen").to_pylist(), b.column("turns").to_pylist(), b.column("roles").to_pylist(), b.column("texts").to_pylist()):
                known = set(before or ())
                codes, blank, duplicate, _ = row_codes(pa.array(roles, pa.string()), pa.array(texts, pa.string()), np.zeros(len(roles), int), np.array([x in known for x in k], bool))
                many[0].append(codes.tobytes())
                stated = [t for t in turn if t is not None]
                many[1].append(stated[0] if stated else None)
                many[2].append(stated[-1] if stated else None)
            out |= {"codes": pa.array(many[0], pa.binary()), "first_turn": pa.array(many[1], pa.int64()), "last_turn": pa.array(many[2], pa.int64())}
            yield pa.RecordBatch.from_pydict(out)

    lean = ready.mapInArrow(coded, f"conv_id {kind}, piece long, codes binary, first_turn long, last_turn long")

    def together(t: pa.Table) -> pa.Table:
        t = t.sort_by("piece")
        own = t.column("codes").to_pylist()
        size = np.array([len(x) for x in own])
        codes = np.frombuffer(b"".join(own), np.uint8)
        block = codes[:, None]
        letters, rows = trace(block, backward(block)) if len(codes) else (np.zeros((0, 1), np.uint8), np.zeros((0, 1), np.int64))
        letters, rows = letters[:, 0], rows[:, 0]
        # an insert before a row belongs to the piece of that row, one after the last row to the last piece that has rows
        cut = np.searchsorted(rows, np.cumsum(size))
        if len(codes):
            cut[np.flatnonzero(size)[-1] :] = len(rows)
        audits = [letters[i:j].tobytes() for i, j in zip(np.concatenate([[0], cut[:-1]]), cut)]
        states, missing, wrong, state, turn, role = [], [], [], START, None, None
        for a, c, f, l in zip(audits, own, t.column("first_turn").to_pylist(), t.column("last_turn").to_pylist()):
            states.append(state)
            state = _after(a, np.frombuffer(c, np.uint8), state)
            missing.append(max(f - turn - 1, 0) if f is not None and turn is not None else 0)
            turn = l if l is not None else turn
            wrong.append(int(bool(c) and role is not None and (role, c[0] & 3) not in LEGAL))
            role = c[-1] & 3 if c else role
        return pa.table({"piece": t.column("piece"), "codes": t.column("codes"), "audit": pa.array([a.decode() for a in audits], pa.string()), "state": pa.array(states, pa.int32()), "missing": pa.array(missing, pa.int64()), "wrong": pa.array(wrong, pa.int64()), "alone": pa.array([len(own) == 1] * len(own), pa.bool_())})

    solved = lean.groupBy("conv_id").applyInArrow(together, "piece long, codes binary, audit string, state int, missing long, wrong long, alone boolean")
    joined = parts.select("conv_id", "piece", "turns", "roles", "texts").join(solved, "piece")

    def finished(batches):
        for b in batches:
            out = {c: [] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")}
            for turn, roles, texts, c, audit, state, missing, wrong in zip(*(b.column(x).to_pylist() for x in ("turns", "roles", "texts", "codes", "audit", "state", "missing", "wrong"))):
                codes = np.frombuffer(c, np.uint8)
                _, blank, _, _ = row_codes(pa.array(roles, pa.string()), pa.array(texts, pa.string()), np.zeros(len(roles), int))
                faults = [blank, (codes & GONE > 0) & ~blank, codes & CUT_OFF > 0]
                done = _finished(pa.array(turn, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string()), np.array([0, len(codes)]), codes, faults, [audit.encode()], [state])
                done["gaps"] = done["gaps"] + missing
                done["illegal"] = done["illegal"] + wrong
                for k in out:
                    out[k].append(done[k][0])
            lists = {k: pa.array(v, pa.string() if k in ("audit", "repaired") else pa.int64()) for k, v in out.items()}
            yield pa.RecordBatch.from_pydict({"conv_id": b.column("conv_id"), "piece": b.column("piece"), "whole": b.column("alone"), **lists})

    return joined.mapInArrow(finished, f"conv_id {kind}, piece long, whole boolean, {STATS}")


def _after(audit: bytes, codes: np.ndarray, state: int) -> int:
    """The state after a piece."""
    i = 0
    for a in audit:
        if a in (68, 75, 82):
            state = int(KEEP[state, codes[i] & 3]) if a == 75 else state if a == 68 else int(NEXT[state])
            i += 1
        else:
            state = int(NEXT[state])
    return state


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation: its sums, whole audit, and the SHA-256 of its repaired turns, joined by line feeds.

    Pieces of a conversation that has several are hashed in their order as a stream; no task holds their texts together.
    """
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kind = pieces.schema["conv_id"].dataType.simpleString()
    own = pieces.where("whole").select("conv_id", *sums, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
    shape = f"conv_id {kind}, {', '.join(f'{c} long' for c in sums)}, audit string, repaired_sha256 string"

    def stream(batches):
        current = None
        for b in batches:
            for r in b.to_pylist():
                if current is None or r["conv_id"] != current[0]:
                    if current:
                        yield row(current)
                    current = [r["conv_id"], [0] * len(sums), [], hashlib.sha256(), False]
                current[1] = [x + r[c] for x, c in zip(current[1], sums)]
                current[2].append(r["audit"])
                if any(a != "D" for a in r["audit"]):
                    current[3].update((("\n" if current[4] else "") + r["repaired"]).encode())
                    current[4] = True
        if current:
            yield row(current)

    def row(c):
        return pa.RecordBatch.from_pylist([{"conv_id": c[0], **dict(zip(sums, c[1])), "audit": "".join(c[2]), "repaired_sha256": c[3].hexdigest()}], pa.schema([("conv_id", id_type), *((s, pa.int64()) for s in sums), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    id_type = to_arrow_type(pieces.schema["conv_id"].dataType)
    split = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return own.unionByName(split.mapInArrow(stream, shape))


def damage(turns: DataFrame) -> DataFrame:
    """Rows with one of five faults by the CRC-32 of `conv_id:turn` (nulls: one space) mod 20: 0 is dropped (present is
    false), 1 loses its text, 2 its `.!?`, 3 comes twice, 4 becomes a user turn; all others stay. A null role or text is
    one space."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    rows = turns.select("conv_id", "turn", "role", "text", fault.alias("f"))
    copies = rows.withColumn("copy", F.explode(F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return copies.select("conv_id", "turn", F.when(F.col("f") == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"), (F.col("f") != 0).alias("present"))
