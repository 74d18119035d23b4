"""From conversations to examples, model inputs and dialogue pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def extract_examples(turns: DataFrame, context_turns: int = 3, least_words: int = 5) -> DataFrame:
    """Turns of least_words or more with their up to context_turns predecessors (short ones included).

    The deal by conversation is the one that the windows need anyway. Its number of parts is stated, as the few bytes of
    a text can carry much work: parts merged by size would leave that to one task.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = turns.repartition(parts, "conv_id")
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = F.concat(F.lit("["), F.col("role"), F.lit("]: "), F.col("text"))
    context = F.array_join(F.collect_list(said).over(w.rowsBetween(-context_turns, -1)), " ")
    out = turns.select("conv_id", "turn", "role", F.col("text").alias("response"), context.alias("context_text"), F.lag("text").over(w).alias("evidence"))
    return out.where(T.n_words(F.col("response")) >= least_words)


def format_input() -> "F.Column":
    part = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    return F.concat(F.lit("[CONTEXT] "), part("context_text", 1024), F.lit(" [EVIDENCE] "), part("evidence", 512), F.lit(" [RESPONSE] "), part("response", 512))


def extract_components(c) -> dict:
    """Parts of a model input, stripped."""
    return {
        "context": T.strip(F.regexp_extract(c, r"(?s)\[CONTEXT\](.*?)\[EVIDENCE\]", 1)),
        "evidence": T.strip(F.regexp_extract(c, r"(?s)\[EVIDENCE\](.*?)\[RESPONSE\]", 1)),
        "response": T.strip(F.regexp_extract(c, r"(?s)\[RESPONSE\](.*)$", 1)),
    }


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", F.lag("text").over(w).alias("context"), F.col("text").alias("response")).where("context is not null")


def format_repair_input(types) -> "F.Column":
    """Control tokens of the task and of each violated maxim in types, then context, evidence and response."""
    known = F.filter(types, lambda m: m.isin("quantity", "quality", "relation", "manner"))
    tokens = F.transform(known, lambda m: F.concat(F.lit("[VIOLATION="), F.upper(m), F.lit("]")))
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    head = F.array_join(F.concat(F.array(F.lit("[REPAIR]")), tokens, F.array(F.lit("[CONTEXT]"))), " ")
    return F.concat_ws(" ", head, part("context_text"), F.lit("[EVIDENCE]"), part("evidence"), F.lit("[RESPONSE]"), part("response"))


def original_response(c) -> "F.Column":
    """The text after the last response mark; without one, the last piece between full stops, with a full stop."""
    last = T.strip(F.substring_index(T.strip(c), ".", -1))
    return F.when(c.contains("[RESPONSE]"), T.strip(F.substring_index(c, "[RESPONSE]", -1))).otherwise(F.concat(last, F.lit(".")))
