"""Windowed counts over streams of turns and events (an extension): watermarks, late rows, and tables as sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import heuristics as H
from ..sources.tables import shared_path


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """The files of a path (a pattern) as a stream, `files` of them a batch at most; ts, as watermarks need it, with the
    session's time zone."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    rows = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def flag_counts(stream: DataFrame, late: str = "10 minutes", size: str = "5 minutes", threshold: float = 0.5) -> DataFrame:
    """stream (ts, response, context_text, evidence; conv_id and turn are not needed) to start, end, maxim, n, flagged.

    The votes of each response are columns of the stream, without state; counts are kept by event-time window and maxim.
    A window is given out once, when the newest ts is `late` past its end; rows of windows that were given out are dropped
    (dropped_late() tells how many). Rows without ts belong to no window and are left out.
    """
    flags = [F.struct(F.lit(m).alias("maxim"), F.col(f"{m}.probability").alias("p")) for m in ("quantity", "quality", "relation", "manner")]
    labelled = H.weak_labels(stream.withWatermark("ts", late)).select("ts", F.explode(F.array(*flags)).alias("v")).select("ts", "v.*")
    counts = labelled.groupBy(F.window("ts", size).alias("w"), "maxim").agg(F.count("*").alias("n"), F.count_if(F.col("p") > threshold).alias("flagged"))
    return counts.select("w.start", "w.end", "maxim", "n", "flagged")


def table_of_batches(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a batch is the folder of its number, written whole or again, so one that is repeated after a
    failure replaces itself."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def start(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Write the batches of a stream as table_of_batches(); once: take what is there now, then end."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(table_of_batches(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What start() has written, with the number of the batch."""
    return spark.read.schema(f"{schema}, batch long").option("basePath", path).parquet(f"{path}/batch=*")


def latest(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Of each key the values of its last batch: the state of a stream in update mode."""
    last = F.max_by(F.struct(*values), "batch").alias("_v")
    return rows.groupBy(*keys).agg(last).select(*keys, *(F.col(f"_v.{v}").alias(v) for v in values))


def dropped_late(query: StreamingQuery) -> int:
    """Rows that came after their window had been given out, in the batches that the query still remembers."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def event_counts(spark: SparkSession, path: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, event_type, n of all events that the files of a path (a pattern) hold now: one run of a stream.

    Its state and its table of batches are in the shared folder. Counts are updates: the last one of a window and type
    holds. Windows `late` behind the newest event leave the state; events of theirs that come after that are dropped.
    """
    counts = event_stream(spark, path).withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    out = shared_path(spark, "event-counts")
    start(counts, out, shared_path(spark, "stream"), "update").awaitTermination()
    return latest(read_batches(spark, out, "start timestamp_ntz, event_type string, n long"), ["start", "event_type"], ["n"])
