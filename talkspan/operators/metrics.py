"""Evaluation statistics over long-form score rows (id, maxim, p_base, p_tuned, y) and other typed inputs.

Every statistic is one pass of mergeable aggregates; thresholds are exploded from a literal array, not joined.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranges import running

KEYS = ["maxim"]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def confusion(rows: DataFrame, truth: Column, guess: Column, keys: list[str] = KEYS) -> DataFrame:
    return rows.groupBy(*keys).agg(
        count_if(truth & guess).alias("tp"), count_if(~truth & guess).alias("fp"), count_if(truth & ~guess).alias("fn"), count_if(~truth & ~guess).alias("tn")
    )


def multilabel(rows: DataFrame, truth: Column, guess: Column, keys: list[str] = KEYS) -> DataFrame:
    """Precision, recall, F1, accuracy, Cohen's kappa (1 only if p_o is, where p_e is 1) of each key."""
    c = confusion(rows, truth, guess, keys)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    po = ratio(F.col("tp") + F.col("tn"), n)
    pe = ratio((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("tn") + F.col("fn")) * (F.col("tn") + F.col("fp")), n * n)
    kappa = F.when(pe == 1, F.when(po == 1, 1.0).otherwise(0.0)).otherwise(F.try_divide(po - pe, 1 - pe))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return c.select(*keys, "tp", "fp", "fn", "tn", *(F.round(x, 6).alias(a) for x, a in ((p, "precision"), (r, "recall"), (f1, "f1"), (po, "accuracy"), (kappa, "kappa"))))


def class_weights(rows: DataFrame, y: Column, keys: list[str] = KEYS) -> DataFrame:
    pos, n = count_if(y), F.count("*")
    out = rows.groupBy(*keys).agg(pos.alias("pos"), n.alias("n"))
    some = (F.col("pos") > 0) & (F.col("pos") < F.col("n"))
    weight = lambda c: F.when(some, F.round(ratio(F.col("n"), 2 * c), 6)).otherwise(1.0)
    return out.select(*keys, "pos", "n", weight(F.col("pos")).alias("w_pos"), weight(F.col("n") - F.col("pos")).alias("w_neg"))


def rates(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Violation rates of both systems and the improvement, by maxim."""
    base, tuned = F.avg(F.when(F.col("p_base") > threshold, 1.0).otherwise(0.0)), F.avg(F.when(F.col("p_tuned") > threshold, 1.0).otherwise(0.0))
    out = rows.groupBy("maxim").agg(base.alias("b"), tuned.alias("t"))
    return out.select("maxim", F.round("b", 6).alias("base_rate"), F.round("t", 6).alias("tuned_rate"), F.round(F.col("b") - F.col("t"), 6).alias("absolute"), F.round(ratio(F.col("b") - F.col("t"), F.col("b")), 6).alias("relative"))


def cooperation(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """joint_rate: no maxim violated; mean_compliance: one minus the mean violation rate."""
    own = rows.groupBy("id").agg(*(F.max(F.when(F.col(c) > threshold, 1).otherwise(0)).alias(f"any_{c}") for c in ("p_base", "p_tuned")), *(F.avg(F.when(F.col(c) > threshold, 1.0).otherwise(0.0)).alias(f"r_{c}") for c in ("p_base", "p_tuned")))
    return own.agg(*(F.round(f(c), 6).alias(a) for f, c, a in ((lambda c: 1 - F.avg(f"any_{c}"), "p_base", "joint_base"), (lambda c: 1 - F.avg(f"any_{c}"), "p_tuned", "joint_tuned"), (lambda c: 1 - F.avg(f"r_{c}"), "p_base", "compliance_base"), (lambda c: 1 - F.avg(f"r_{c}"), "p_tuned", "compliance_tuned"))))


def sweep(rows: DataFrame, percents: list[int]) -> DataFrame:
    """Rates at each threshold (in hundredths)."""
    t = rows.withColumn("t", F.explode(F.array(*[F.lit(p) for p in percents])))
    over = lambda c: F.round(F.avg(F.when(F.col(c) > F.col("t") / 100, 1.0).otherwise(0.0)), 6)
    return t.groupBy("maxim", "t").agg(over("p_base").alias("base_rate"), over("p_tuned").alias("tuned_rate"))


def best_f1_threshold(rows: DataFrame, percents: list[int]) -> DataFrame:
    """The first threshold with the greatest F1 (guess: p >= t) of each maxim."""
    t = rows.withColumn("t", F.explode(F.array(*[F.lit(p) for p in percents])))
    f = multilabel(t, F.col("y") == 1, F.col("p_base") >= F.col("t") / 100, ["maxim", "t"])
    best = F.max_by(F.struct("t", "f1"), F.struct("f1", -F.col("t"))).alias("b")
    return f.groupBy("maxim").agg(best).select("maxim", "b.t", "b.f1")


def linear_percentiles(rows: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """keys, share, value: percentiles with linear interpolation, from running counts of distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    run = running(counts, keys, "v", ["n"]).join(totals, keys) if keys else running(counts, keys, "v", ["n"]).crossJoin(totals)
    want = run.withColumn("share", F.explode(F.array(*map(F.lit, shares)))).withColumn("h", (F.col("total") - 1) * F.col("share"))
    at = lambda k: F.min(F.when(F.col("below_n") + F.col("n") > k, F.col("v")))
    got = want.groupBy(*keys, "share").agg(at(F.floor("h")).alias("a"), at(F.ceil("h")).alias("b"), F.any_value("h").alias("h"))
    return got.select(*keys, "share", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("h") - F.floor("h"))).alias("value"))


def auc(rows: DataFrame) -> DataFrame:
    """Rank statistic with average ranks by maxim; 0 where undefined. Ranks come from counts of distinct scores."""
    ties = running(rows.groupBy("maxim", "p_base").agg(F.count("*").alias("n"), F.sum("y").alias("pos")), ["maxim"], "p_base", ["n"])
    rank = F.col("below_n") + (F.col("n") + 1) / 2
    out = ties.withColumn("r", rank).groupBy("maxim").agg(F.sum(F.col("r") * F.col("pos")).alias("s"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    return out.select("maxim", F.round(ratio(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p"))), 6).alias("auc"))


def describe(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Moments, median and shares of a score by key, and the flags compressed (std under .1 or range under .3) and discrete."""
    c = F.col(column)
    by = rows.groupBy(*keys).agg(
        F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_pop(c).alias("s"), F.min(c).alias("least"), F.max(c).alias("most"),
        F.round(F.avg(F.when((c > 0.4) & (c < 0.6), 1.0).otherwise(0.0)), 6).alias("middle_share"),
    )
    values = rows.groupBy(*keys, column).agg(F.lit(1).alias("one")).groupBy(*keys).agg(F.count(column).alias("n_values"))
    half = linear_percentiles(rows, keys, column, [0.5]).select(*keys, F.round("value", 6).alias("median"))
    out = by.join(values, keys).join(half, keys)
    flags = [((F.col("s") < 0.1) | (F.col("most") - F.col("least") < 0.3)).alias("compressed"), (F.col("n_values") <= 10).alias("discrete")]
    return out.select(*keys, "n", F.round("m", 6).alias("mean"), F.round("s", 6).alias("std"), "least", "most", "median", "middle_share", "n_values", *flags)


def histogram(rows: DataFrame, column: str, edges: list[float], keys: list[str]) -> DataFrame:
    """Counts by bin [edge, next edge); the last bin is closed."""
    c, last = F.col(column), len(edges) - 2
    bin_ = F.coalesce(*[F.when((c >= edges[k]) & ((c < edges[k + 1]) if k < last else (c <= edges[k + 1])), k) for k in range(last + 1)])
    return rows.withColumn("bin", bin_).where("bin is not null").groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def mcnemar(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Discordant counts, chi-square with continuity correction, and its p-value (one row a maxim goes to Python)."""
    b, t = F.col("p_base") > threshold, F.col("p_tuned") > threshold
    c = rows.groupBy("maxim").agg(count_if(b & t).alias("both"), count_if(b & ~t).alias("base_only"), count_if(~b & t).alias("tuned_only"), count_if(~b & ~t).alias("neither"))
    d = F.col("base_only") + F.col("tuned_only")
    chi = F.when(d == 0, 0.0).otherwise(F.pow(F.abs(F.col("base_only") - F.col("tuned_only")) - 1, F.lit(2.0)) / d)

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2)))

    return c.withColumn("chi2", F.round(chi, 6)).withColumn("p_value", tail(chi))


def cooccurrence(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs of maxims violated together, by one array a response."""
    hit = rows.where(F.col("p_base") > threshold).groupBy("id").agg(F.array_sort(F.collect_set("maxim")).alias("m"))
    pairs = hit.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def index_percentiles(rows: DataFrame, column: str, percents: list[int]) -> DataFrame:
    """sorted[int(n * p / 100)] from running counts of distinct values; nulls are left out."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    run = running(counts, [], "v", ["n"]).crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))  # one row
    want = run.withColumn("p", F.explode(F.array(*[F.lit(p) for p in percents]))).withColumn("k", F.floor(F.col("total") * F.col("p") / 100))
    return want.where("below_n <= k and k < below_n + n").select("p", F.col("v").alias("value"))


def latency_profile(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, n, mean, std, p50, p95, p99, least, most and per_second of times in milliseconds."""
    v, shares = F.col(column), [0.5, 0.95, 0.99]
    at = linear_percentiles(rows, keys, column, shares)
    wide = at.groupBy(*keys).agg(*(F.round(F.max(F.when(F.col("share") == p, F.col("value"))), 6).alias(f"p{int(p * 100)}") for p in shares))
    rate = F.try_divide(F.count(v).cast("double"), F.sum(v) / 1000)
    own = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(rate, 6).alias("per_second"))
    return own.join(wide, keys)


def mann_whitney(rows: DataFrame, key: str, value: str, system: str, first: str, second: str) -> DataFrame:
    """U of the first system over the second for each key, ties as half. Counts of distinct values are ranked, not rows."""
    c = rows.groupBy(key, value).agg(F.count_if(F.col(system) == first).alias("a"), F.count_if(F.col(system) == second).alias("b"))
    u = running(c, [key], value, ["b"]).withColumn("u", F.col("a") * (F.col("below_b") + F.col("b") / 2))
    return u.groupBy(key).agg(F.sum("a").alias("n_first"), F.sum("b").alias("n_second"), F.sum("u").alias("u"))


def baseline_scores(c: Column) -> dict[str, Column]:
    """quantity by number of words, clarity by share of distinct words; a null text has no words."""
    w = T.words(F.lower(F.coalesce(c, F.lit(""))))
    quantity = F.when(F.size(w) < 15, 0.5).when(F.size(w) <= 150, 1.0).otherwise(0.7)
    clarity = F.when(F.size(w) == 0, 0.0).otherwise(F.least(F.lit(1.0), 1.2 * F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))))
    return {"quantity": quantity, "clarity": clarity}


def repair_success(rows: DataFrame, before: str, after: str, text: str) -> DataFrame:
    """Adds v_before, v_after, v_new, removal and success: something fixed, nothing new, no word-bang text."""
    n = lambda c: F.size(F.filter(c, lambda x: x)).cast("long")
    b, a = F.col(before), F.col(after)
    new, fixed = F.zip_with(b, a, lambda x, y: ~x & y), F.zip_with(b, a, lambda x, y: x & ~y)
    out = rows.withColumns({"v_before": n(b), "v_after": n(a), "v_new": n(new)})
    removal = F.round(1 - F.col("v_after") / F.greatest("v_before", F.lit(1)), 6)
    return out.withColumns({"removal": removal, "success": (n(fixed) > 0) & (F.col("v_new") == 0) & ~T.word_bang(F.col(text))})


def artifact_counts(rows: DataFrame, text: str, marks: list[str], keys: list[str]) -> DataFrame:
    """Texts with each mark, and texts in which a phrase of three words (but the last four) occurs three times or more."""
    c = F.col(text)

    def thrice(w):
        phrases = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 6, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " ")))
        often = F.exists(phrases, lambda p: F.floor((F.length(c) - F.length(F.replace(c, p, F.lit("")))) / F.length(p)) >= 3)
        return (F.size(w) > 6) & often

    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(c.contains(m)).alias(f"mark{k}") for k, m in enumerate(marks)), F.count_if(T.let(T.words(c), thrice)).alias("repeating"))


def with_pooled(rows: DataFrame, key: str = "maxim", name: str = "overall") -> DataFrame:
    """Every row by its key and once more under `name`, for reports with a pooled line."""
    return rows.withColumn(key, F.explode(F.array(F.col(key), F.lit(name))))


def match_rates(rows: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """One row (n, exact, partial): shares of responses with all, with any of their labels right."""
    own = rows.groupBy("id").agg(F.bool_and(truth == guess).alias("all"), F.bool_or(truth == guess).alias("any"))
    share = lambda c: F.round(F.avg(F.when(F.col(c), 1.0).otherwise(0.0)), 6)
    return own.agg(F.count("*").alias("n"), share("all").alias("exact"), share("any").alias("partial"))


def sweep_winner(rows: DataFrame, percents: list[int], start: int = 50) -> DataFrame:
    """The threshold with most maxims improved, then most cooperative responses, then the smallest; start if none improves."""
    by = sweep(rows, percents).groupBy("t").agg(F.count_if(F.col("base_rate") > F.col("tuned_rate")).alias("improved"))
    t = rows.withColumn("t", F.explode(F.array(*[F.lit(p) for p in percents])))
    clean = t.groupBy("id", "t").agg(F.max(F.when(F.col("p_tuned") > F.col("t") / 100, 1).otherwise(0)).alias("v")).groupBy("t").agg(F.round(1 - F.avg("v"), 6).alias("cooperative"))
    best = by.join(clean, "t").agg(F.max_by(F.struct("t", "improved", "cooperative"), F.struct("improved", "cooperative", -F.col("t"))).alias("b"))
    none = (F.col("b.improved") == 0) & (F.col("b.cooperative") == 0)
    return best.select(F.when(none, start).otherwise(F.col("b.t")).alias("t"), "b.improved", "b.cooperative")


def optimal_thresholds(rows: DataFrame, percents: list[int], start: int = 50) -> DataFrame:
    """By maxim the first threshold with the greatest relative improvement at a tuned rate between .1 and .8; start if none."""
    s = sweep(rows, percents)
    fit = (F.col("base_rate") > 0) & (F.col("tuned_rate") > 0.1) & (F.col("tuned_rate") < 0.8)
    gain = F.when(fit, F.round((F.col("base_rate") - F.col("tuned_rate")) / F.col("base_rate"), 6))
    best = s.withColumn("gain", gain).groupBy("maxim").agg(F.max_by(F.struct("t", "gain"), F.when(F.col("gain").isNotNull(), F.struct("gain", -F.col("t")))).alias("b"))
    return best.select("maxim", F.coalesce("b.t", F.lit(start)).alias("t"), F.col("b.gain").alias("improvement"))


def independence(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """maxim, total, solo (violated alone) and solo over total."""
    hit = rows.where(F.col("p_base") > threshold).groupBy("id").agg(F.collect_set("maxim").alias("m"))
    by = hit.select(F.explode("m").alias("maxim"), (F.size("m") == 1).alias("alone")).groupBy("maxim").agg(F.count("*").alias("total"), F.count_if("alone").alias("solo"))
    return by.withColumn("independence", F.round(F.col("solo") / F.col("total"), 6))


def calibrated(p: Column, temperature: Column) -> Column:
    """sigmoid(logit(p) / T), of a probability kept off 0 and 1."""
    x = F.ln(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6)))
    return 1 / (1 + F.exp(-x / temperature))


def preference_loss(logit: Column, margins: dict[str, Column], weights: dict[str, float]) -> Column:
    """Mean over maxims, by weight, of -log sigmoid(logit) times the margin, which counts 0.01 at least."""
    loss = F.greatest(-logit, F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit)))
    return sum((loss * F.greatest(m, F.lit(0.01)) * weights[k] for k, m in margins.items()), F.lit(0.0)) / sum(weights.values())


def focal_loss(p: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """alpha (1 - pt)^gamma times the cross-entropy, pt the probability given to the truth."""
    pt = F.greatest(F.when(y == 1, p).otherwise(1 - p), F.lit(1e-6))
    return alpha * F.pow(1 - pt, F.lit(gamma)) * -F.ln(pt)
