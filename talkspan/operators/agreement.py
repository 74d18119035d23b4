"""Agreement of annotators, translation scores, calibration and intervals over long-form rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from .ranges import running


@F.pandas_udf(DoubleType())
def _normal_tails(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if pd.notna(v) else None)


def krippendorff_ordinal(ratings: DataFrame, unit: str, value: str, categories: Sequence[int]) -> DataFrame:
    """One row (n_units, n_values, alpha): ordinal alpha from a coincidence matrix; null without disagreement to expect.

    A unit's ratings become one count a category, so any number of raters of a unit costs one aggregate. Null ratings
    and units with fewer than two ratings are left out.
    """
    counts = [F.count_if(F.col(value) == c).alias(f"n{c}") for c in categories]
    units = ratings.where(F.col(value).isin(*categories)).groupBy(unit).agg(F.count("*").alias("m"), *counts).where("m >= 2")
    cell = lambda a, b: F.col(f"n{a}") * (F.col(f"n{b}") - (1 if a == b else 0)) / (F.col("m") - 1)
    pairs = [(a, b) for a in categories for b in categories]
    sums = units.agg(F.count("*").alias("n_units"), F.sum("m").alias("n_values"), *(F.coalesce(F.sum(cell(a, b)), F.lit(0.0)).alias(f"o_{a}_{b}") for a, b in pairs))
    total = {a: sum((F.col(f"o_{a}_{b}") for b in categories), F.lit(0.0)) for a in categories}

    def distance(a: int, b: int) -> Column:
        between = sum((total[c] for c in categories if min(a, b) <= c <= max(a, b)), F.lit(0.0))
        return F.pow(between - (total[a] + total[b]) / 2, F.lit(2.0)) if a != b else F.lit(0.0)

    seen = sum((F.col(f"o_{a}_{b}") * distance(a, b) for a, b in pairs), F.lit(0.0))
    expected = sum((total[a] * total[b] * distance(a, b) for a, b in pairs), F.lit(0.0))
    return sums.select("n_units", "n_values", F.round(1 - (F.col("n_values") - 1) * F.try_divide(seen, expected), 6).alias("alpha"))


def annotator_pairs(ratings: DataFrame, unit: str, annotator: str, value: str) -> DataFrame:
    """Rows (unit, first, second, a, b) of annotators first < second who both rated the unit."""
    rated = ratings.where(F.col(value).isNotNull())
    a = rated.select(unit, F.col(annotator).alias("first"), F.col(value).alias("a"))
    b = rated.select(unit, F.col(annotator).alias("second"), F.col(value).alias("b"))
    return a.join(b, unit).where("first < second")


def mean_pairwise_correlation(pairs: DataFrame, least: int = 3) -> DataFrame:
    """One row (n_pairs, mean_corr) over the annotator pairs with least or more common units and a defined correlation."""
    c = pairs.groupBy("first", "second").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r")).where((F.col("n") >= least) & F.col("r").isNotNull() & ~F.isnan("r"))
    return c.agg(F.count("*").alias("n_pairs"), F.round(F.avg("r"), 6).alias("mean_corr"))


def bleu(rows: DataFrame, key: str, hypothesis: str, reference: str, epsilon: float = 0.1, order: int = 4) -> DataFrame:
    """Rows (key, bleu): sentence BLEU of lower-cased words; an order without a match counts epsilon, no common word is 0.

    N-grams are counted by aggregates that combine before the shuffle, so long texts cost no more than their length.
    A null text has no words.
    """
    tokens = lambda c: T.words(F.lower(F.coalesce(F.col(c), F.lit(""))))
    t = rows.select(key, tokens(hypothesis).alias("h"), tokens(reference).alias("r"))

    def grams(c: str, side: int, n: int) -> Column:
        return F.transform(T.ngrams(F.col(c), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(side).alias("side")))

    both = [grams(c, side, n) for side, c in enumerate("hr") for n in range(1, order + 1)]
    long = t.select(key, F.explode(F.concat(*both)).alias("x")).select(key, "x.*")
    counts = long.groupBy(key, "n", "g").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    hits = counts.groupBy(key).agg(*(F.sum(F.when(F.col("n") == n, F.least("a", "b")).otherwise(0)).alias(f"hit{n}") for n in range(1, order + 1)))
    sizes = t.select(key, F.size("h").alias("hn"), F.size("r").alias("rn"))
    j = sizes.join(hits, key, "left")
    share = lambda n: F.coalesce(F.nullif(F.col(f"hit{n}").cast("double"), F.lit(0.0)), F.lit(epsilon)) / F.greatest(F.col("hn") - n + 1, F.lit(1))
    brevity = F.when(F.col("hn") > F.col("rn"), 0.0).otherwise(1 - F.col("rn") / F.col("hn"))
    score = F.exp(brevity + sum((F.ln(share(n)) for n in range(1, order + 1)), F.lit(0.0)) / order)
    return j.select(key, F.when(F.coalesce("hit1", F.lit(0)) == 0, 0.0).otherwise(F.round(score, 6)).alias("bleu"))


def fit_temperature(rows: DataFrame, key: str, p: str, y: str, steps: int = 100, low: float = 0.1) -> DataFrame:
    """The first T on the grid low, 2 low, ... with the least log-loss of sigmoid(logit(p) / T), by key.

    Rows are counted by (p, y) first, then each meets the grid; both aggregates combine before their shuffles.
    """
    logit = F.ln(F.greatest(F.col(p), F.lit(1e-6)) / F.greatest(1 - F.col(p), F.lit(1e-6)))
    own = rows.groupBy(key, F.col(p), F.col(y)).agg(F.count("*").alias("n")).select(key, logit.alias("x"), F.col(y), "n")
    grid = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    z = F.when(F.col(y) == 1, F.col("x")).otherwise(-F.col("x")) / (F.col("k") * low)
    loss = F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    by = grid.groupBy(key, "k").agg(F.round(F.sum(loss * F.col("n")) / F.sum("n"), 8).alias("loss"))
    best = by.groupBy(key).agg(F.min(F.struct("loss", "k")).alias("b"))
    return best.select(key, F.round(F.col("b.k") * low, 6).alias("temperature"), F.round("b.loss", 6).alias("loss"))


def mann_whitney_p(rows: DataFrame, key: str, value: str, system: str, first: str, second: str) -> DataFrame:
    """Two-sided p of U by the normal approximation with tie and continuity corrections; null if all values are equal."""
    c = rows.groupBy(key, value).agg(F.count_if(F.col(system) == first).alias("a"), F.count_if(F.col(system) == second).alias("b"))
    t = (F.col("a") + F.col("b")).cast("double")
    s = running(c, [key], value, ["b"]).withColumn("u", F.col("a") * (F.col("below_b") + F.col("b") / 2)).groupBy(key).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2"), F.sum("u").alias("u"), F.sum(t * t * t - t).alias("ties"))
    n, area = (F.col("n1") + F.col("n2")).cast("double"), F.col("n1") * F.col("n2").cast("double")
    var = area / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    z = F.greatest(F.abs(F.col("u") - area / 2) - 0.5, F.lit(0.0)) / F.nullif(F.sqrt(var), F.lit(0.0))
    return s.select(key, "u", _normal_tails(z).alias("p_value"))


def kappa_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, agreement, kappa of rows (keys, a, b, n): multi-class; where chance alone agrees fully kappa is 1 only if all do."""
    rows = cells.groupBy(*keys, "a").agg(F.sum("n").alias("x")).withColumnRenamed("a", "c")
    cols = cells.groupBy(*keys, "b").agg(F.sum("n").alias("y")).withColumnRenamed("b", "c")
    chance = rows.join(cols, [*keys, "c"]).groupBy(*keys).agg(F.sum(F.col("x") * F.col("y").cast("double")).alias("xy"))
    seen = cells.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    j = (seen.join(chance, keys, "left") if keys else seen.crossJoin(chance)).withColumns({"po": F.col("same") / F.col("n"), "pe": F.coalesce("xy", F.lit(0.0)) / (F.col("n") * F.col("n"))})
    kappa = F.when(F.col("pe") == 1, F.when(F.col("po") == 1, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")))
    return j.select(*keys, "n", F.round("po", 6).alias("agreement"), F.round(kappa, 6).alias("kappa"))


def kappa(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Multi-class Cohen's kappa of rows with two ratings; rows without both are left out."""
    own = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return kappa_counts(own.groupBy(*keys, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")), keys)


def band(c: Column, limits: list[tuple[float, str]], below: str) -> Column:
    """The name of the first limit that c reaches."""
    return F.coalesce(*(F.when(c >= x, name) for x, name in limits), F.lit(below))
