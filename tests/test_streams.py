"""Streams: state across restarts, late and missing turns, watermarks, and batches that are written again."""

import os
from datetime import datetime, timedelta

import pytest

from talkspan.operators import examples as E
from talkspan.streaming import contexts as C
from talkspan.streaming import turns as W

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "turn", "role", "response", "context_text", "evidence"]


def put(spark, folder, rows, schema):
    """One more file of the stream."""
    part = os.path.join(folder, f"part{len(os.listdir(folder)) if os.path.isdir(folder) else 0}")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(part)


def run(spark, tmp, **kwargs):
    stream = C.contexts(C.turn_stream(spark, f"{tmp}/in/*"), **kwargs)
    query = C.start(stream, f"{tmp}/out", f"{tmp}/state")
    query.awaitTermination()
    return spark.read.schema(C.SHAPE).parquet(f"{tmp}/out")


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_contexts_out_of_order_with_restarts(spark, tmp_path):
    """Turns in any order over four files, each taken up by a query that starts again: the rows of the table."""
    turns = [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c}: {'some more words here ' * (t % 3)}") for c in range(12) for t in range(9)]
    turns[13] = (*turns[13][:3], None)
    for k in range(4):
        put(spark, f"{tmp_path}/in", [r for i, r in enumerate(turns) if (i * 7 + i // 9) % 4 == k], TURNS)
        got = run(spark, tmp_path, least_words=4)
    assert rows(got) == rows(E.extract_examples(spark.createDataFrame(turns, TURNS), least_words=4))
    assert got.where("late").isEmpty()


def test_contexts_after_a_lost_commit(spark, tmp_path):
    """A batch whose commit is lost runs again from the state before it; its rows are there once."""
    turns = [(1, t, "user", f"turn number {t} has five words") for t in range(8)]
    put(spark, f"{tmp_path}/in", turns[:4], TURNS)
    run(spark, tmp_path)
    put(spark, f"{tmp_path}/in", turns[4:], TURNS)
    run(spark, tmp_path)
    for name in ("1", ".1.crc"):
        os.remove(f"{tmp_path}/state/commits/{name}")
    got = run(spark, tmp_path)
    assert rows(got) == rows(E.extract_examples(spark.createDataFrame(turns, TURNS)))


def test_late_repeated_and_missing_turns(spark, tmp_path):
    said = lambda *numbers: [(1, t, "user", f"turn {t} says five words") for t in numbers]
    put(spark, f"{tmp_path}/in", [*said(0, 1, 2, 3, 4), (None, 0, "user", "no place for this one here"), (2, None, "user", "no place for this one here")], TURNS)
    assert [r.turn for r in run(spark, tmp_path).orderBy("turn").collect()] == [0, 1, 2, 3, 4]
    put(spark, f"{tmp_path}/in", [(1, 3, "assistant", "another three that comes late"), *said(7)], TURNS)
    got = run(spark, tmp_path)
    (late,) = got.where("late").collect()
    assert (late.turn, late.response, late.evidence) == (3, "another three that comes late", "turn 2 says five words")
    assert late.context_text == "[user]: turn 2 says five words"  # turns 0 and 1 are no longer remembered
    assert got.where("turn = 7").isEmpty()  # waits for 5 and 6
    put(spark, f"{tmp_path}/in", said(6, 5), TURNS)
    got = run(spark, tmp_path)
    last = got.where("turn = 7").first()
    assert last.evidence == "turn 6 says five words" and last.context_text.startswith("[user]: turn 4 says")


def test_patience_by_event_time(spark, tmp_path):
    """A gap is given up when the watermark has passed the patience of what waits behind it."""
    start = datetime(2024, 5, 1, 12)
    at = lambda minutes, *numbers, conv=1: [(conv, t, "user", f"turn {t} says five words", start + timedelta(minutes=minutes)) for t in numbers]
    clock = {"patience": 5 * 60_000, "ts": "ts", "late": "1 minute"}
    put(spark, f"{tmp_path}/in", at(0, 0, 1, 4), TURNS + ", ts timestamp")
    assert sorted(r.turn for r in run(spark, tmp_path, **clock).collect()) == [0, 1]
    put(spark, f"{tmp_path}/in", at(20, 0, conv=2), TURNS + ", ts timestamp")
    got = run(spark, tmp_path, **clock).where("conv_id = 1")
    assert sorted(r.turn for r in got.collect()) == [0, 1, 4]
    assert got.where("turn = 4").first().evidence == "turn 1 says five words"
    put(spark, f"{tmp_path}/in", at(21, 3, 5), TURNS + ", ts timestamp")
    got = run(spark, tmp_path, **clock).where("conv_id = 1")
    assert sorted((r.turn, r.late) for r in got.collect()) == [(0, False), (1, False), (3, True), (4, False), (5, False)]


SAID = "ts timestamp, response string, context_text string, evidence string"


def count(spark, tmp):
    stream = W.flag_counts(spark.readStream.schema(SAID).parquet(f"{tmp}/in/*"), "10 minutes", "5 minutes", 0.4)
    query = W.start(stream, f"{tmp}/out", f"{tmp}/state")
    query.awaitTermination()
    got = W.read_batches(spark, f"{tmp}/out", "start timestamp, end timestamp, maxim string, n long, flagged long").where("maxim = 'quantity'")
    return sorted((r.start.minute, r.n, r.flagged) for r in got.collect()), W.dropped_late(query)


def test_watermark_late_rows_and_restart(spark, tmp_path):
    start = datetime(2024, 5, 1, 12)
    short, fine = "No.", "Well, there are about ten words in this one sentence."
    row = lambda minute, text: (start + timedelta(minutes=minute), text, "What is it?", None)
    put(spark, f"{tmp_path}/in", [row(1, short), row(2, fine), row(4, short), row(7, fine), row(16, fine)], SAID)
    assert count(spark, tmp_path) == ([(0, 3, 2)], 0)  # the first window ended at 5, and 16 - 10 is past it
    put(spark, f"{tmp_path}/in", [row(3, short), row(8, short), (None, short, None, None)], SAID)  # 3 is too late, 8 is not
    assert count(spark, tmp_path) == ([(0, 3, 2)], 4)  # one row by each of four maxims
    put(spark, f"{tmp_path}/in", [row(40, fine)], SAID)
    done = [(0, 3, 2), (5, 2, 1), (15, 1, 0)]
    assert count(spark, tmp_path)[0] == done
    commits = f"{tmp_path}/state/commits"  # the last batch was written, its commit was lost: it is written again, in its place
    last = max((f for f in os.listdir(commits) if f.isdigit()), key=int)
    for name in (last, f".{last}.crc"):
        os.remove(f"{commits}/{name}")
    assert count(spark, tmp_path)[0] == done


def test_event_counts_are_the_last_updates(spark, tmp_path):
    start = datetime(2024, 5, 1, 12)
    events = [(start + timedelta(hours=7 * k), "ab"[k % 2]) for k in range(20)]
    for k in range(2):
        put(spark, f"{tmp_path}/in", events[k::2], "ts timestamp_ntz, event_type string")
    got = {(r.start, r.event_type): r.n for r in W.event_counts(spark, f"{tmp_path}/in/*").collect()}
    want = {}
    for ts, kind in events:
        key = (datetime(ts.year, ts.month, ts.day), kind)
        want[key] = want.get(key, 0) + 1
    assert got == want


@pytest.mark.parametrize("turns", [1, 2])
def test_context_length(spark, tmp_path, turns):
    put(spark, f"{tmp_path}/in", [(1, t, "user", f"turn {t} says five words") for t in range(4)], TURNS)
    last = run(spark, tmp_path, turns=turns).where("turn = 3").first()
    assert last.context_text == " ".join(f"[user]: turn {t} says five words" for t in range(3 - turns, 3))
