"""Queries of the streaming extension: the tables as streams of files, with state, watermarks and tables as sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import MAXIMS, SQL_EXAMPLES, SQL_LABELS, examples, query
from .sources.tables import shared_path
from .streaming import contexts as C
from .streaming import turns as W


@query("w02_stream_contexts", f"WITH {SQL_EXAMPLES} SELECT conv_id, turn, role, md5(response) AS response, md5(context_text) AS context_text, md5(evidence) AS evidence FROM ex")
def w02(spark, sf):
    """p01 on a stream of turns: the same rows from keyed state, in whatever order the files bring them."""
    path = shared_path(spark, "contexts")
    stream = C.contexts(C.turn_stream(spark, f"{sf}/conversations.parque[t]"))
    C.start(stream, path, shared_path(spark, "stream")).awaitTermination()
    rows = spark.read.schema(C.SHAPE).parquet(path).where("not late")
    return rows.select("conv_id", "turn", "role", *(F.md5(c).alias(c) for c in ("response", "context_text", "evidence")))


_SAID = "ev AS (SELECT ts, quantity, quality, relation, manner FROM events JOIN la ON la.conv_id=user_id AND la.turn=event_id%4)"
_LONG = " UNION ALL ".join(f"SELECT ts, '{m}' AS maxim, {m} AS p FROM ev" for m in MAXIMS)
_CLOSED = "date_trunc('day',ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM ev) - INTERVAL 2 DAY"


@query(
    "w03_stream_flags",
    f"WITH {SQL_LABELS}, {_SAID}, lo AS ({_LONG}) SELECT date_trunc('day',ts) AS start, maxim, count(*) AS n, count(*) FILTER (p>0.5) AS flagged FROM lo WHERE {_CLOSED} GROUP BY 1, 2",
)
def w03(spark, sf):
    """Responses and flags by day and maxim: each event names a turn of its user's conversation, whose votes are columns of
    the stream. Days are given out when events two days past their end have come."""
    events = W.event_stream(spark, f"{sf}/events.parque[t]")
    said = examples(spark, sf).select(F.col("conv_id").alias("user_id"), F.col("turn").alias("k"), "response", "context_text", "evidence")
    stream = events.select("ts", "user_id", (F.col("event_id") % 4).alias("k")).join(said, ["user_id", "k"])
    out = shared_path(spark, "flag-counts")
    W.start(W.flag_counts(stream, "2 days", "1 day"), out, shared_path(spark, "stream")).awaitTermination()
    return W.read_batches(spark, out, "start timestamp, end timestamp, maxim string, n long, flagged long").select(F.col("start").cast("timestamp_ntz").alias("start"), "maxim", "n", "flagged")
