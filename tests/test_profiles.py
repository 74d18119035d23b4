"""Vocabulary, overview and comparisons before and after, by hand and against plain counts."""

import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talkspan.operators import profile as R


@pytest.mark.parametrize("tracked, candidates", [(16_384, 1024), (32, 8), (64, 30)])
def test_top_words_are_exact(spark, monkeypatch, tracked, candidates):
    """Whether the sketch proves the result or all words have to be counted."""
    monkeypatch.setattr(R, "TRACKED", tracked)
    monkeypatch.setattr(R, "CANDIDATES", candidates)
    steep = [f"w{k}" for k in range(300) for _ in range(1 + 4000 // (k + 1) ** 2)]
    flat = [f"w{k:03}" for k in range(300) for _ in range(3)]
    for words in (steep, flat, steep[:1], []):
        df = spark.createDataFrame([(w,) for w in words] + [(None,)], "word string").repartition(3)
        got = [(r.word, r.n) for r in R.top_words(df, 5).collect()]
        assert got == sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))[:5]


def test_overview_by_hand(spark):
    rows = [(1, "One two three", "k"), (1, "four", ""), (1, None, None), (2, "One  ONE five", "k"), (2, "a b c d e f g", None), (None, "six", "k")]
    r = R.overview(spark.createDataFrame(rows, "conv_id long, text string, k string"), "k").first()
    n = [3, 1, 0, 3, 7, 1]
    assert (r.n_conversations, r.n_messages, r.n_tokens, r.least, r.most, r.median) == (3, 6, 15, 0, 7, statistics.median(n))
    assert (r.mean_turns, r.median_turns, r.least_turns, r.most_turns) == (2.0, 2.0, 1, 3)
    assert r.std == pytest.approx(statistics.stdev(n), abs=1e-6) and r.too_short == pytest.approx(2.5 - 1.5 * statistics.stdev(n), abs=1e-6)
    assert (r.n_words, r.with_knowledge, r.knowledge_rate, r.p10, r.p95) == (13, 3, 0.5, 0, 7)


def test_degeneracy_before_and_after(spark):
    fine, bad = "a text of some words here", "!!!"
    rows = [("m", bad, fine, fine), ("m", bad, bad, fine), ("n", fine, bad, bad), ("n", fine, fine, fine)]
    got = {r.k: r for r in R.degeneracy_change(spark.createDataFrame(rows, "k string, b string, a string, o string"), "b", "a", "o", "k").collect()}
    assert [(got[k].n, got[k].before, got[k].after, got[k].fallback) for k in ("m", "n", "all")] == [(2, 2, 0, 1), (2, 0, 1, 1), (4, 2, 1, 2)]
    assert (got["m"].improvement, got["m"].relative, got["all"].improvement, got["all"].relative) == (1.0, 100.0, 0.25, 50.0)


def test_long_taxonomy_equals_the_expression(spark):
    """On the short lists the automaton gives what the expression gives; on long and odd ones, what a plain loop gives."""
    import re

    from talkspan.functions import topics

    texts = ["I will start the art class", "Hot food", "start starting STARTED", None, "", "zzz", "social media and media", "The weather, the weather and a job", "x" * 50_000 + " piano", "kids' play, plays and players playing"]
    df = spark.createDataFrame([(k, t, "mine") for k, t in enumerate(texts)], "id int, text string, words string")
    got = {r.id: r for r in topics.long_topics(df, "text", topics.TOPICS).collect()}
    want = {r.id: r.topic for r in df.select("id", topics.weighted_topic(F.col("text")).alias("topic")).collect()}
    assert {k: r.topic for k, r in got.items()} == want and got[0].words == "mine" and got[3].text is None
    odd = {"a": ["social media", "play", "art"], "b": ["media", "play", "start"], "c": []}

    def plain(t):
        low = (t or "").lower()
        words, score = set(re.findall(r"\b\w+\b", low)), {}
        for topic, ws in odd.items():
            for w in ws:
                if w in low:
                    score[topic] = score.get(topic, 0) + (10 + 5 * (len(w) > 6) + 3 * (low.find(w) < len(low) / 2) if w in words else 5)
        return max(score, key=score.get) if score else "general"

    assert {r.id: r.topic for r in topics.long_topics(df, "text", odd).collect()} == {k: plain(t) for k, t in enumerate(texts)}
    assert {r.topic for r in topics.long_topics(df, "text", {}).collect()} == {"general"}
    assert sum(map(len, topics.with_forms().values())) > 328
