"""Exploration of conversations: lengths, turns, vocabulary, knowledge use, and thresholds that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .metrics import index_percentiles, linear_percentiles

#: Words that the sketch keeps count of, and words that are counted exactly.
TRACKED, CANDIDATES = 16_384, 1024
#: Frequencies of the sketch are out by no more than this share of the words, over TRACKED.
ERROR = 3.5


def top_words(words: DataFrame, k: int = 20) -> DataFrame:
    """word, n of the k most frequent words of rows (word); equal ones go by the word.

    A mergeable sketch finds CANDIDATES, whose exact counts follow. Where the sketch cannot prove that no other word
    belongs to the k best (few words, or many of the same frequency), all words are counted.
    """
    own = words.where(F.col("word").isNotNull()).select("word")
    first = own.agg(F.count("*").alias("total"), F.expr(f"approx_top_k(word, {CANDIDATES}, {TRACKED})").alias("t")).first()
    found = first["t"] or []
    exact = own.join(F.broadcast(words.sparkSession.createDataFrame([(r["item"],) for r in found], "word string")), "word", "left_semi") if found else own  # at most CANDIDATES words
    best = exact.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(k)
    if len(found) < CANDIDATES and first["total"] * ERROR < TRACKED:  # the sketch has every word
        return best
    others = max(found[-1]["count"] if len(found) == CANDIDATES else 0, ERROR * first["total"] / TRACKED)
    least = [r["n"] for r in best.collect()]  # k rows
    if len(least) == k and least[-1] > others:
        return best
    return own.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(k)


def overview(turns: DataFrame, knowledge: str) -> DataFrame:
    """One row about turns (conv_id, text, and a column with the knowledge of a turn).

    n_conversations, n_messages; mean, median, std (of a sample), least and most words of a message; mean, median, least
    and most turns of a conversation; n_words, n_tokens; with_knowledge, knowledge_rate; too_short (mean - 1.5 std),
    too_long (mean + 2 std), p10 and p95 (sorted[int(n q)]). A null text has no words; null conv_ids are one conversation.
    """
    own = turns.select("conv_id", F.coalesce("text", F.lit("")).alias("text"), F.col(knowledge).alias("k")).withColumn("words", T.words(F.lower("text")))
    n = F.size("words")
    used = F.coalesce(F.col("k") != "", F.lit(False))
    message = own.agg(
        F.count("*").alias("n_messages"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), F.min(n).cast("long").alias("least"), F.max(n).cast("long").alias("most"),
        F.sum(n).alias("n_tokens"), F.count_if(used).alias("with_knowledge"), F.avg(F.when(used, 1.0).otherwise(0.0)).alias("knowledge_rate"),
    )
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    talks = sizes.agg(F.count("*").alias("n_conversations"), F.avg("n").alias("mean_turns"), F.min("n").alias("least_turns"), F.max("n").alias("most_turns"))
    lengths = own.select(n.cast("double").alias("n"))
    half = lambda rows, name: linear_percentiles(rows, [], "n", [0.5]).select(F.col("value").alias(name))
    cuts = index_percentiles(lengths, "n", [10, 95]).agg(*(F.max(F.when(F.col("p") == p, F.col("value"))).cast("long").alias(f"p{p}") for p in (10, 95)))
    vocabulary = own.select(F.explode("words").alias("w")).agg(F.count_distinct("w").alias("n_words"))
    out = message
    for part in (talks, half(lengths, "median"), half(sizes.select(F.col("n").cast("double").alias("n")), "median_turns"), cuts, vocabulary):
        out = out.crossJoin(F.broadcast(part))  # one row each
    shown = lambda c, name: F.round(c, 6).alias(name)
    return out.select(
        "n_conversations", "n_messages", shown(F.col("mean"), "mean"), "median", shown(F.col("std"), "std"), "least", "most", shown(F.col("mean_turns"), "mean_turns"), "median_turns", "least_turns", "most_turns",
        "n_words", "n_tokens", "with_knowledge", shown(F.col("knowledge_rate"), "knowledge_rate"), shown(F.col("mean") - 1.5 * F.col("std"), "too_short"), shown(F.col("mean") + 2 * F.col("std"), "too_long"), "p10", "p95",
    )


def degeneracy_change(rows: DataFrame, before: str, after: str, original: str, key: str) -> DataFrame:
    """By key and for all: n, degenerate texts before and after, how many of the latter fell back to the original, their
    rates, and the fall of the rate, absolute and relative (in percent).

    after: what is made now; a degenerate one is replaced by the original, which is judged in its place.
    """
    bad, falls = T.is_degenerate(F.col(before)), T.is_degenerate(F.col(after))
    final = F.when(falls, F.col(original)).otherwise(F.col(after))
    judged = rows.select(F.explode(F.array(F.col(key), F.lit("all"))).alias(key), bad.alias("b"), falls.alias("f"), T.is_degenerate(final).alias("a"))
    by = judged.groupBy(key).agg(F.count("*").alias("n"), *(F.count_if(c).alias(name) for c, name in (("b", "before"), ("a", "after"), ("f", "fallback"))))
    rate = lambda c: F.col(c) / F.col("n")
    gain = rate("before") - rate("after")
    return by.select(key, "n", "before", "after", "fallback", F.round(rate("before"), 6).alias("before_rate"), F.round(rate("after"), 6).alias("after_rate"), F.round(rate("fallback"), 6).alias("fallback_rate"), F.round(gain, 6).alias("improvement"), F.round(100 * gain / F.greatest(rate("before"), F.lit(1e-10)), 6).alias("relative"))
