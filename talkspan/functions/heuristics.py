"""Weak-supervision heuristics: (response, context, evidence) to score and confidence, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T


class Parts:
    """What the heuristics need of a text. Built on a text column, or read from columns that prepare() has added, so
    that each is computed once however many heuristics use it. A part that nobody asks for is not built."""

    MAKERS = {"words": T.n_words, "sentences": T.sentences, "keywords": lambda c: F.array_distinct(T.keywords(c)), "entities": T.entities}

    def __init__(self, text: Column, prefix: str | None = None):
        self.text, self.prefix = text, prefix

    def __getattr__(self, name: str) -> Column:
        if name not in self.MAKERS:
            raise AttributeError(name)
        made = self.MAKERS[name](self.text) if self.prefix is None else F.col(f"{self.prefix}_{name}")
        setattr(self, name, made)
        return made

    def columns(self, prefix: str, names: list[str]) -> dict[str, Column]:
        return {f"{prefix}_{n}": getattr(self, n) for n in names}


def parts(text: Column | Parts) -> Parts:
    return text if isinstance(text, Parts) else Parts(text)


def vote(name: str, maxim: str, score: Column, confidence: Column | float) -> Column:
    confidence = F.lit(confidence) if isinstance(confidence, float) else confidence
    return F.struct(F.lit(name).alias("name"), F.lit(maxim).alias("maxim"), score.cast("double").alias("score"), confidence.cast("double").alias("confidence"))


def length_ratio(response: Column, context: Column) -> Column:
    context = context.text if isinstance(context, Parts) else context
    asked = F.size(F.regexp_extract_all(F.lower(context), F.lit(r"\b(who|what|when|where|why|how)\b"), F.lit(0)))
    expected = F.when(asked == 0, 10.0).when(asked == 1, 20.0).otherwise(30.0)
    many = F.substring(context, 1, F.greatest(F.length(context) - 1, F.lit(0))).contains("?") | F.lower(context).contains(" and ")
    ratio = parts(response).words / F.when(many, expected * 1.5).otherwise(expected)
    return vote("length_ratio", "quantity", F.when(ratio < 0.3, F.least(F.lit(1.0), (0.3 - ratio) / 0.3)).when(ratio > 3, F.least(F.lit(1.0), (ratio - 3) / 3)).otherwise(0.0), 0.7)


def redundancy(response: Column) -> Column:
    """Mean overlap of the trigram sets of sentence pairs; null under 20 words."""

    def mean_overlap(grams):
        def against(g, i):
            rest = F.filter(F.slice(grams, i + 2, F.size(grams)), lambda h: F.size(h) > 0)
            return F.transform(rest, lambda h: F.size(F.array_intersect(g, h)) / F.least(F.size(g), F.size(h)))

        shares = F.flatten(F.transform(grams, lambda g, i: F.when(F.size(g) > 0, against(g, i)).otherwise(F.array().cast("array<double>"))))
        return T.let(shares, lambda x: F.coalesce(F.try_divide(F.aggregate(x, F.lit(0.0), lambda a, y: a + y), F.size(x)), F.lit(0.0)))

    own = parts(response)
    grams = F.transform(own.sentences, lambda s: F.array_distinct(T.ngrams(T.words(F.lower(s)))))
    score = T.let(T.let(grams, mean_overlap), lambda m: F.when(m > 0.2, F.least(F.lit(1.0), m / 0.5)).otherwise(0.0))
    confidence = F.when(F.size(own.sentences) < 2, 0.3).otherwise(0.6)
    return F.when(own.words >= 20, vote("redundancy", "quantity", score, confidence))


def info_density(response: Column) -> Column:
    own = parts(response)
    n = F.size(own.sentences)
    density = F.size(own.keywords) / F.greatest(n, F.lit(1))
    score = F.when((n > 2) & (density < 2), (2 - density) / 2).otherwise(0.0)
    return vote("info_density", "quantity", score, F.when(n == 0, 0.3).otherwise(0.5))


def evidence_coverage(response: Column, evidence: Column) -> Column:
    r, e = parts(response).keywords, parts(evidence).keywords
    share = F.when((F.size(r) == 0) | (F.size(e) == 0), 0.5).otherwise(F.size(F.array_intersect(r, e)) / F.greatest(F.size(r), F.lit(1)))
    return vote("evidence_coverage", "quality", F.when(share < 0.3, 1 - share).otherwise(0.0), 0.4)


def entity_consistency(response: Column, evidence: Column) -> Column:
    r, e = parts(response).entities, parts(evidence).entities
    novel = F.size(F.array_except(r, e)) / F.greatest(F.size(r), F.lit(1))
    return vote("entity_consistency", "quality", F.when((F.size(r) > 0) & (novel > 0.5), novel).otherwise(0.0), F.when(F.size(r) == 0, 0.3).otherwise(0.5))


def no_evidence() -> Column:
    return vote("no_evidence", "quality", F.lit(0.0), 0.2)


def keyword_overlap(response: Column, context: Column) -> Column:
    c, r = parts(context).keywords, parts(response).keywords
    share = F.size(F.array_intersect(c, r)) / F.greatest(F.size(c), F.lit(1))
    score = F.when(F.size(c) == 0, 0.0).when(share == 0, 0.8).when(share < 0.2, 0.4).otherwise(0.0)
    return vote("keyword_overlap", "relation", score, F.when(F.size(c) == 0, 0.3).otherwise(0.6))


def ambiguous_pronouns(response: Column) -> Column:
    start = F.array(*[F.lit(w) for w in T.START_PRONOUNS])
    first = lambda x: F.regexp_replace(F.lower(F.coalesce(F.get(T.words(x), 0), F.lit(""))), r"[.,]+$", "")
    own = parts(response)
    facts = T.let(
        own.sentences,
        lambda s: F.struct(
            F.size(s).alias("n"), F.size(F.filter(s, lambda x: F.array_contains(start, first(x)))).alias("starts"),
            own.words.alias("w"), (F.size(T.pronouns(own.text)) / F.greatest(own.words, F.lit(1))).alias("ratio"),
        ),
    )
    score = lambda f: F.when(f["w"] < 5, 0.0).when((f["ratio"] > 0.15) & (f["starts"] > 1), F.least(F.lit(1.0), f["ratio"] / 0.3)).when((f["starts"] >= f["n"] * 0.5) & (f["n"] >= 2), 0.6).otherwise(0.0)
    return T.let(facts, lambda f: vote("ambiguous_pronouns", "manner", score(f), F.when(f["w"] < 5, 0.3).otherwise(0.5)))


def sentence_complexity(response: Column) -> Column:
    def judge(lengths):
        most = F.coalesce(F.array_max(lengths), F.lit(0))
        mean = F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(lengths), F.lit(1))
        score = F.when(most > 50, 0.8).when(mean > 35, 0.5).when((mean > 25) & (most > 40), 0.4).otherwise(0.0)
        return vote("sentence_complexity", "manner", score, F.when(F.size(lengths) == 0, 0.3).otherwise(0.6))

    return T.let(F.transform(parts(response).sentences, lambda s: T.n_words(s)), judge)


def combine(votes: Column) -> Column:
    """Struct (probability, agreement): mean weighted by confidence of the votes of 0.3 or more (else of all)."""

    def strong(v):
        return T.let(F.filter(v, lambda x: x["confidence"] >= 0.3), lambda s: F.when(F.size(s) > 0, s).otherwise(v))

    def sums(used):
        weight = F.aggregate(used, F.lit(0.0), lambda a, v: a + v["confidence"])
        mean = F.coalesce(F.try_divide(F.aggregate(used, F.lit(0.0), lambda a, v: a + v["score"] * v["confidence"]), weight), F.lit(0.0))
        return T.let(mean, lambda m: label(used, m))

    def label(used, m):
        spread = F.try_divide(F.aggregate(used, F.lit(0.0), lambda a, v: a + (v["score"] - m) * (v["score"] - m)), F.size(used))
        agree = F.when(F.size(used) == 0, 0.0).when(F.size(used) == 1, 1.0).otherwise(1 - F.least(F.lit(1.0), 4 * spread))
        return F.struct(m.alias("probability"), agree.alias("agreement"))

    return T.let(T.let(votes, strong), sums)


#: Builders of votes by name: (response, context, evidence) as columns or Parts. More can be added.
REGISTRY = {
    "length_ratio": lambda r, c, e: length_ratio(r, c),
    "redundancy": lambda r, c, e: redundancy(r),
    "info_density": lambda r, c, e: info_density(r),
    "evidence_coverage": lambda r, c, e: evidence_coverage(r, e),
    "entity_consistency": lambda r, c, e: entity_consistency(r, e),
    "no_evidence": lambda r, c, e: no_evidence(),
    "keyword_overlap": lambda r, c, e: keyword_overlap(r, c),
    "ambiguous_pronouns": lambda r, c, e: ambiguous_pronouns(r),
    "sentence_complexity": lambda r, c, e: sentence_complexity(r),
}


def prepare(rows: DataFrame) -> tuple[DataFrame, Parts, Parts, Parts]:
    """rows (response, context_text, evidence) with the parts of their texts as columns, and the three Parts."""
    r, c, e = F.col("response"), F.col("context_text"), F.col("evidence")
    made = Parts(r).columns("_r", ["words", "sentences", "keywords", "entities"]) | Parts(c).columns("_c", ["keywords"]) | Parts(e).columns("_e", ["keywords", "entities"])
    return rows.withColumns(made), Parts(r, "_r"), Parts(c, "_c"), Parts(e, "_e")


def weak_labels(rows: DataFrame) -> DataFrame:
    """rows with a struct (probability, agreement) for each maxim; evidence is null where a turn has none."""
    own, r, c, e = prepare(rows)
    vote_of = lambda *names: [REGISTRY[n](r, c, e) for n in names]
    votes = {
        "quantity": F.array_compact(F.array(*vote_of("length_ratio", "redundancy", "info_density"))),
        "quality": F.when(e.text.isNull(), F.array(*vote_of("no_evidence"))).otherwise(F.array(*vote_of("evidence_coverage", "entity_consistency"))),
        "relation": F.array(*vote_of("keyword_overlap")),
        "manner": F.array(*vote_of("ambiguous_pronouns", "sentence_complexity")),
    }
    return own.select(*rows.columns, *(combine(v).alias(m) for m, v in votes.items()))


def semantic_similarity(similarity: Column) -> Column:
    """A vote from the cosine of response and context."""
    return vote("semantic_similarity", "relation", F.when(similarity < 0.2, (0.2 - similarity) / 0.2).otherwise(0.0), 0.8)


def evidence_similarity(similarity: Column) -> Column:
    """A vote from the cosine of response and evidence."""
    return vote("evidence_similarity", "quality", F.when(similarity < 0.3, (0.3 - similarity) / 0.3).otherwise(0.0), 0.7)


def readability(response: Column) -> Column:
    """School grade over 16; null under ten words. Syllables are taken as groups of vowels, one a word at least."""

    def judge(w):
        syllables = F.aggregate(w, F.lit(0), lambda a, x: a + F.greatest(F.size(F.regexp_extract_all(F.lower(x), F.lit("[aeiouy]+"), F.lit(0))), F.lit(1)))
        n = F.greatest(F.size(w), F.lit(1))
        grade = 0.39 * n / F.greatest(F.size(T.sentences(response)), F.lit(1)) + 11.8 * syllables / n - 15.59
        score = T.let(grade, lambda g: F.when(g > 16, F.least(F.lit(1.0), (g - 16) / 4)).otherwise(0.0))
        return F.when(F.size(w) >= 10, vote("readability", "manner", score, 0.6))

    return T.let(T.words(response), judge)


def sentence_overlaps(response: Column) -> Column:
    """Overlaps (shared over the smaller) of the word sets of each two sentences of a text, as one array; 0 without words."""

    def all_(s):
        share = lambda x, y: F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.least(F.size(x), F.size(y))), F.lit(0.0))
        return F.flatten(F.transform(s, lambda x, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda y: share(x, y))))

    return T.let(F.transform(T.sentences(response), lambda x: F.array_distinct(T.words(F.lower(x)))), all_)
