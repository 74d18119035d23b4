"""Stateful contexts on a stream of turns (an extension): each turn with its predecessors, as row windows give them on a
table, where row windows are not allowed.

State is kept by conversation: the number of the last turn that was given out, the last few turns, and turns that came
before their predecessors. A turn that continues the conversation goes out at once and frees those that waited for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHAPE = "conv_id long, turn long, role string, response string, context_text string, evidence string, late boolean"


class Contexts(StatefulProcessor):
    """Turns of one conversation in the order of their numbers, from 0 without gaps.

    With a clock, what has waited for `patience` milliseconds (since the time stated with the turn, or since it came) goes
    out in order and the gaps before it are given up. A turn whose number is not above the last that went out is late: it goes out at once, marked, with the
    remembered turns below it as its context, and changes nothing for others. A number that comes twice at once keeps
    its first row in place, the others are late.
    """

    def __init__(self, turns: int, patience: int, clock: str):
        self.turns, self.patience, self.clock = turns, patience, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "last long, turns array<long>, roles array<string>, texts array<string>, waiting long")
        self.waiting = handle.getMapState("waiting", "turn long", "role string, text string")

    def _read(self) -> tuple[int, dict, dict]:
        """The last turn given out (-1 at first), remembered turns, and those that wait."""
        if not self.state.exists():
            return -1, {}, {}
        last, turns, roles, texts, n = self.state.get()
        waiting = {k[0]: tuple(v) for k, v in self.waiting.iterator()} if n else {}
        return last, dict(zip(turns, zip(roles, texts))), waiting

    def _write(self, last: int, recent: dict, before: dict, waiting: dict) -> None:
        for turn in before.keys() - waiting.keys():
            self.waiting.removeKey((turn,))
        for turn in waiting.keys() - before.keys():
            self.waiting.updateValue((turn,), waiting[turn])
        turns = sorted(recent)
        self.state.update((last, turns, [recent[t][0] for t in turns], [recent[t][1] for t in turns], len(waiting)))

    def _row(self, key, turn: int, said: tuple, recent: dict, late: bool) -> tuple:
        before = [recent[k] for k in sorted(recent) if k < turn][-self.turns :]
        parts = [f"[{role}]: {text}" for role, text in before if role is not None and text is not None]
        return (key, turn, *said, " ".join(parts), before[-1][1] if before else None, late)

    def _advance(self, key, turn: int, said: tuple, recent: dict) -> tuple:
        """Give a turn out and remember it in place of the oldest one."""
        row = self._row(key, turn, said, recent, False)
        recent[turn] = said
        while len(recent) > self.turns:
            del recent[min(recent)]
        return row

    def _given(self, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "role", "response", "context_text", "evidence", "late"]).astype({"conv_id": "int64", "turn": "int64", "late": "bool"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (last, recent, before), out = self._read(), []
        waiting = dict(before)
        came = pd.concat(list(rows), ignore_index=True)
        came = came.astype(object).where(came.notna(), None)
        for turn, role, text in sorted(zip(came["turn"], came["role"], came["text"]), key=lambda r: (r[0], r[1] or "", r[2] or "")):
            if turn <= last or turn in waiting:
                out.append(self._row(key[0], turn, (role, text), recent, True))
                continue
            waiting[turn] = (role, text)
            while last + 1 in waiting:
                last += 1
                out.append(self._advance(key[0], last, waiting.pop(last), recent))
        self._write(last, recent, before, waiting)
        if waiting and self.clock != "None" and not any(True for _ in self.handle.listTimers()):
            now = int(came["at"].max()) if self.clock == "EventTime" else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.patience)
        yield from self._given(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, recent, waiting = self._read()
        out = [self._advance(key[0], turn, waiting[turn], recent) for turn in sorted(waiting)]
        self._write(max(waiting, default=last), recent, waiting, {})
        yield from self._given(out)

    def close(self) -> None:
        pass


def contexts(stream: DataFrame, turns: int = 3, least_words: int = 5, patience: int | None = None, ts: str | None = None, late: str = "10 minutes") -> DataFrame:
    """stream (conv_id, turn, role, text) to conv_id, turn, role, response, context_text, evidence, late: what
    extract_examples() gives on a table, as turns come, in any order.

    Turns are numbered from 0. Rows without conv_id or turn have no place and are left out. The state of a conversation is
    its last `turns` turns and those that wait for a missing one: for ever, or, with `patience`, so many milliseconds by
    the event time `ts` (rows over `late` behind the newest are dropped by its watermark) or by the clock on the wall,
    whose query never ends by itself. Needs the RocksDB state store (start() sets it).
    """
    clock = "None" if patience is None else "EventTime" if ts else "ProcessingTime"
    stream = stream.withWatermark(ts, late) if clock == "EventTime" else stream
    at = F.unix_millis(ts) if clock == "EventTime" else F.lit(None).cast("long")
    own = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]
    placed = stream.where("conv_id is not null and turn is not null").select(*own, "role", "text", at.alias("at"), *([ts] if clock == "EventTime" else []))
    out = placed.groupBy("conv_id").transformWithStateInPandas(Contexts(turns, patience or 0, clock), SHAPE, "Append", clock)
    return out.where(T.n_words(F.col("response")) >= least_words)


def start(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Write a stateful stream to Parquet files under path; files of a batch count only when it is committed. A query that
    starts again from its checkpoint goes on after the last committed batch. once: take what is there now, then end."""
    spark, conf = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, ROCKSDB)  # a query keeps the settings it was started with
    try:
        writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start(path)
    finally:
        spark.conf.set(conf, before)


def turn_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The files of a path (a pattern) as a stream, `files` of them a batch at most."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
