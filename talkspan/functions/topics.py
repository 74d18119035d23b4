"""Topics of texts from keyword lists: column expressions over short ones, an automaton for long ones."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# Topics and their keywords, in order of precedence.
TOPICS = {
    "weather": ["weather", "rain", "sunny", "cold", "hot", "temperature", "storm"],
    "food": ["food", "eat", "restaurant", "cook", "meal", "dinner", "lunch", "breakfast"],
    "work": ["work", "job", "office", "boss", "meeting", "project", "career"],
    "family": ["family", "mother", "father", "sister", "brother", "parents", "kids"],
    "travel": ["travel", "trip", "vacation", "flight", "hotel", "visit", "beach"],
    "health": ["health", "doctor", "sick", "medicine", "hospital", "exercise"],
    "entertainment": ["movie", "film", "music", "game", "show", "concert", "book"],
    "sports": ["sport", "team", "play", "win", "match", "football", "basketball"],
    "education": ["school", "study", "learn", "class", "teacher", "student"],
    "technology": ["computer", "phone", "internet", "app", "software", "tech"],
    "pets": ["pet", "dog", "cat", "animal", "puppy"],
    "hobbies": ["hobby", "art", "painting", "music", "garden"],
    "shopping": ["shop", "buy", "store", "price", "sale"],
    "relationship": ["friend", "relationship", "date", "love", "partner"],
}


def first_topic(c: Column, topics: dict[str, list[str]] = TOPICS) -> Column:
    """The first topic one of whose keywords is a substring of the lower-cased text; 'general' if none or null."""
    found = [F.when(F.lower(c).rlike("|".join(words)), topic) for topic, words in topics.items()]
    return F.coalesce(*found, F.lit("general"))


def weighted_topic(c: Column, topics: dict[str, list[str]] = TOPICS) -> Column:
    """The topic with the greatest score, the first of equal ones; 'general' if no keyword occurs or the text is null.

    A keyword that is a word of the text scores 1, 0.5 more if over six letters long, 0.3 more if it is found before
    the middle; one that is only part of a word scores 0.5. Scores are kept in tenths, so that ties are exact.
    """
    table = F.array(*[F.struct(F.lit(k).alias("place"), F.lit(t).alias("topic"), F.array(*map(F.lit, ws)).alias("words")) for k, (t, ws) in enumerate(topics.items())])

    def judge(f):
        def points(w):
            whole = 10 + F.when(F.length(w) > 6, 5).otherwise(0) + F.when(F.instr(f["t"], w) - 1 < F.length(f["t"]) / 2, 3).otherwise(0)
            return F.when(F.array_contains(f["w"], w), whole).when(F.contains(f["t"], w), 5).otherwise(0)

        scored = F.transform(table, lambda x: F.struct(F.aggregate(x["words"], F.lit(0), lambda a, w: a + points(w)).alias("s"), (-x["place"]).alias("o"), x["topic"].alias("topic")))
        return T.let(F.array_max(scored), lambda m: F.when(m["s"] > 0, m["topic"]).otherwise("general"))

    low = F.lower(F.coalesce(c, F.lit("")))
    return T.let(F.struct(low.alias("t"), F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?U)\b\w+\b"), F.lit(0))).alias("w")), judge)


def with_forms(topics: dict[str, list[str]] = TOPICS) -> dict[str, list[str]]:
    """A long taxonomy by rule: each keyword with its forms in -s, -es, -ed, -er and -ing, each once in a topic."""

    def forms(w: str) -> list[str]:
        stem = w[:-1] if w.endswith("e") else w[:-1] + "i" if w.endswith("y") else w
        return [w, w + "s", stem + "es", stem + "ed", stem + "er", (w[:-1] if w.endswith("e") else w) + "ing"]

    return {t: list(dict.fromkeys(f for w in ws for f in forms(w))) for t, ws in topics.items()}


def long_topics(rows: DataFrame, text: str, topics: dict[str, list[str]], name: str = "topic") -> DataFrame:
    """rows with weighted_topic() of a column for a taxonomy of any length: one automaton of all keywords is walked along
    each text once, where an expression would look for every keyword by itself.

    The rule is that of weighted_topic(): ties go to the first topic, null texts and those without a keyword are
    'general'. A keyword may stand in several topics; one of several words is never a word of the text, so it scores 0.5.
    Columns of rows pass through.
    """
    names, columns, owners = list(topics), rows.columns, {}
    for k, t in enumerate(names):
        for w in dict.fromkeys(topics[t]):
            owners.setdefault(w, []).append(k)

    def judge(batches):
        automaton = ahocorasick.Automaton()
        for w, own in owners.items():
            automaton.add_word(w, (w, own))
        if owners:
            automaton.make_automaton()
        for b in batches:
            out = []
            for t in b.column(b.num_columns - 1).to_pylist():
                first: dict[str, int] = {}
                for end, (w, _) in automaton.iter(t or "") if owners else ():
                    first.setdefault(w, end - len(w) + 1)
                score: dict[int, int] = {}
                words = set(re.findall(r"\w+", t)) if first else set()
                for w, at in first.items():
                    points = 10 + 5 * (len(w) > 6) + 3 * (at < len(t) / 2) if w in words else 5
                    for k in owners[w]:
                        score[k] = score.get(k, 0) + points
                best = max(score, key=lambda k: (score[k], -k), default=None)
                out.append("general" if best is None else names[best])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.string())], [*columns, name])

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{name}` string"])
    return rows.select("*", F.lower(text).alias("_low")).mapInArrow(judge, shape)
