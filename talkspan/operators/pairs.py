"""Preference pairs: margins (rejected - chosen violation, positive means chosen is better) and their filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAXIMS = ["quantity", "quality", "relation", "manner"]
M = [f"m_{m}" for m in MAXIMS]


def with_margins(pairs: DataFrame) -> DataFrame:
    """pairs: c_<maxim>, r_<maxim> scores of chosen and rejected; adds m_<maxim> and avg_margin."""
    out = pairs.withColumns({f"m_{m}": F.round(F.col(f"r_{m}") - F.col(f"c_{m}"), 6) for m in MAXIMS})
    return out.withColumn("avg_margin", F.round(sum((F.col(c) for c in M), F.lit(0.0)) / 4, 6))


def strict(pairs: DataFrame) -> DataFrame:
    return pairs.where(sum((F.when(F.coalesce(F.col(c), F.lit(0.0)) > 0, 0).otherwise(1) for c in M), F.lit(0)) == 0)


def relaxed(pairs: DataFrame, manner: float = -0.1) -> DataFrame:
    return pairs.where((F.col("m_quantity") > 0) & (F.col("m_quality") > 0) & (F.col("m_relation") > 0) & (F.col("m_manner") > manner))


def reject_reason(least: float = 0.15):
    """The first maxim under the least margin: <maxim>_negative or weak_signal; null if none."""
    return F.coalesce(*[F.when(F.col(f"m_{m}") < least, F.when(F.col(f"m_{m}") < 0, f"{m}_negative").otherwise("weak_signal")) for m in MAXIMS])


def conflict(limit: float = 0.15):
    r, m = F.col("m_relation"), F.col("m_manner")
    return F.when((r > limit) & (m < -limit), 1).when((m > limit) & (r < -limit), 2).otherwise(0)


def problem():
    return (F.col("m_manner") < -0.1) & ((F.col("m_relation") > 0.1) | (F.col("m_quantity") > 0.1))


def fix_inverted(pairs: DataFrame, keep_over: float = 0.05) -> DataFrame:
    """Pairs with three or more negative margins are swapped and kept if their average is then over keep_over."""
    inverted = sum((F.when(F.col(c) < 0, 1).otherwise(0) for c in M), F.lit(0)) >= 3
    return _swap(pairs, inverted, keep_over)


def quality(pairs: DataFrame) -> DataFrame:
    """Mean, shares positive, clear (over .2) and weak (under .1) of each maxim's margin."""
    long = pairs.select(F.explode(F.array(*[F.struct(F.lit(m).alias("maxim"), F.col(f"m_{m}").alias("v")) for m in MAXIMS])).alias("x")).select("x.*")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    v = F.col("v")
    return long.groupBy("maxim").agg(F.round(F.avg(v), 6).alias("mean"), share(v > 0).alias("positive"), share(F.abs(v) > 0.2).alias("clear"), share(F.abs(v) < 0.1).alias("weak"))


def best_maxim():
    """The maxim of the greatest margin; the first wins ties."""
    most = F.greatest(*M)
    return F.coalesce(*[F.when(F.col(f"m_{m}") == most, m) for m in MAXIMS])


def extract_labels(maxim, violation_type) -> dict:
    """0 or 1 of each maxim: the named one, or for 'multiple' those that violation_type contains."""
    return {m: F.when((maxim == m) | ((maxim == "multiple") & violation_type.contains(m)), 1).otherwise(0) for m in MAXIMS}


def violated_maxims(maxim, violation_type):
    """The maxims of a repair row as an array."""
    inside = F.filter(F.array(*map(F.lit, MAXIMS)), lambda m: F.contains(F.lower(violation_type), m))
    return F.when(maxim == "multiple", inside).otherwise(F.array(maxim))


def repairable(rows: DataFrame, original: str) -> DataFrame:
    """Rows with a violation and a text to repair; null kinds and texts go."""
    return rows.where((F.col("maxim") != "none") & (F.col("violation_type") != "none") & (F.col(original) != ""))


def uncertain_maxims(p: dict, low: float = 0.25, high: float = 0.75):
    """Comma-joined names of the probabilities from low to high; a missing one counts as certain."""
    return F.array_join(F.array_compact(F.array(*(F.when((c >= low) & (c <= high), m) for m, c in p.items()))), ",")


def manner_conflict(limit: float = 0.15):
    """True if manner is clearly on one side and another maxim clearly on the other."""
    m = F.col("m_manner")
    out = F.lit(False)
    for c in M[:3]:
        out = out | ((F.col(c) > limit) & (m < -limit)) | ((F.col(c) < -limit) & (m > limit))
    return out


def manner_filter(pairs: DataFrame, mild: float = -0.15, firm: float = 0.05) -> DataFrame:
    """Pairs with manner over mild; if their mean manner is not positive, those over firm. One number goes to the driver."""
    kept = pairs.where(F.col("m_manner") > mild)
    mean = kept.agg(F.avg("m_manner")).first()[0]
    return kept if mean is not None and mean > 0 else pairs.where(F.col("m_manner") > firm)


def fix_manner(pairs: DataFrame, keep_over: float = 0.05) -> DataFrame:
    """Pairs whose manner is bad where the rest is good, or that are negative throughout, are swapped and kept if then over keep_over."""
    rest = (F.col("m_quantity") + F.col("m_quality") + F.col("m_relation")) / 3
    every = (F.col("m_quantity") < 0) & (F.col("m_quality") < 0) & (F.col("m_relation") < 0) & (F.col("m_manner") < 0)
    return _swap(pairs, ((F.col("m_manner") < -0.2) & (rest > 0.1)) | every, keep_over)


def uncertainty(a: str, b: str):
    """Mean of the likeness of two texts in length and in words; two empty texts are of one length and share no word."""
    x, y = F.length(a), F.length(b)
    likeness = 1 - F.coalesce(F.try_divide(F.abs(x - y), F.greatest(x, y)), F.lit(0.0))
    return F.round((likeness + T.jaccard(F.array_distinct(T.words(F.lower(a))), F.array_distinct(T.words(F.lower(b))))) / 2, 6)


def _swap(pairs: DataFrame, which, keep_over: float) -> DataFrame:
    out = pairs.withColumn("swapped", F.coalesce(which, F.lit(False)))
    s = F.col("swapped")
    cols = {"chosen": F.when(s, F.col("rejected")).otherwise(F.col("chosen")), "rejected": F.when(s, F.col("chosen")).otherwise(F.col("rejected"))}
    cols |= {c: F.when(s, -F.col(c)).otherwise(F.col(c)) for c in [*M, "avg_margin"]}
    return out.withColumns(cols).where(~s | (F.col("avg_margin") > keep_over))


# Log and mail artefacts.
ARTIFACTS = [r"\[\d{2}:\d{2}:\d{2}\].*\[Server", r"From:.*@.*\.\w+", r"\[Client thread/INFO\]"]


def clean_annotated(rows: DataFrame, least_words: int = 8) -> DataFrame:
    """Adds chosen, rejected (stripped), strength and reason ('kept', or the first test failed) to (preference, a, b)."""
    first = F.col("preference").startswith("A")
    out = rows.withColumns({"chosen": T.strip(F.when(first, F.col("a")).otherwise(F.col("b"))), "rejected": T.strip(F.when(first, F.col("b")).otherwise(F.col("a")))})
    c, r = F.col("chosen"), F.col("rejected")
    reason = (
        F.when(F.col("preference") == "equal", "equal_skip")
        .when((F.coalesce(T.n_words(c), F.lit(0)) < least_words) | (F.coalesce(T.n_words(r), F.lit(0)) < least_words), "too_short")
        .when(c == r, "identical")
        .when(T.word_bang(c), "chosen_word_bang")
        .when(c.rlike("|".join(ARTIFACTS)), "chosen_artifact")
        .otherwise("kept")
    )
    return out.withColumn("strength", F.when(F.col("preference").contains("much"), 1.0).otherwise(0.6)).withColumn("reason", reason)


def route(violations) -> "F.Column":
    """The way to repair a response: retrieval for relation, editing for other maxims, none without a violation."""
    upper = F.transform(violations, lambda v: F.upper(v))
    return F.when(F.size(violations) == 0, "none").when(F.array_contains(upper, "RELATION"), "retrieve").otherwise("edit")


def repaired(way, response, edited, retrieved) -> "F.Column":
    """The repaired text: what was retrieved or edited, or the response where that is missing or degenerate."""
    made = F.when(way == "retrieve", retrieved).when(way == "edit", edited)
    return F.when(made.isNull() | T.is_degenerate(made), response).otherwise(made)


def length_guard(old, new, low: float = 0.6, high: float = 1.4) -> "F.Column":
    """Whether a rewritten text is about as long, in words, as the old one; false without words."""
    share = F.try_divide(T.n_words(new), T.n_words(old))
    return F.coalesce((share >= low) & (share <= high), F.lit(False))


def prompt(context, evidence) -> "F.Column":
    """The instruction of a preference pair, with or without evidence."""
    end = F.lit("\n\nGenerate a cooperative response:")
    head = F.concat(F.lit("Context: "), context)
    return F.when(F.coalesce(evidence, F.lit("")) != "", F.concat(head, F.lit("\nEvidence: "), evidence, end)).otherwise(F.concat(head, end))


def continuation_prompt(context) -> "F.Column":
    """The instruction to continue a conversation."""
    return F.concat(F.lit("Continue the following conversation naturally, following Gricean maxims (be relevant, truthful, clear, appropriately informative):\n\n"), context, F.lit("\n\nResponse:"))
