"""Ranges of nearly equal counts by a number, from a mergeable quantile sketch: what ranks, percentiles and places need so
that no task sorts a whole group, however the values are spread."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 1024
#: The size of the sketch: ranks are out by about 0.03 % of the rows, a third of a range.
SKETCH = 8192


def borders(rows: DataFrame, by: Column, parts: int = PARTS) -> list[float]:
    """Up to parts - 1 rising numbers that cut the rows into about equal ranges; they go to the driver."""
    ranks = F.expr(f"array({', '.join(f'{k / parts}D' for k in range(1, parts))})")
    x = by.cast("double")
    sketch = rows.where(x.isNotNull() & ~F.isnan(x)).agg(F.kll_sketch_agg_double(x, SKETCH).alias("s"), F.count("*").alias("n"))
    got = sketch.where("n > 0").select(F.kll_sketch_get_quantile_double("s", ranks).alias("q")).first()
    return sorted({float(x) for x in got["q"] if abs(x) != float("inf")}) if got else []


def cut(rows: DataFrame, by: Column, name: str = "_p", parts: int = PARTS) -> DataFrame:
    """rows with the number of the range of `by` (an int, from 0; NaN is in the last one, nulls have none)."""
    inside = borders(rows, by, parts)
    splits = [float("-inf"), *inside, float("inf")] if inside else [float("-inf"), 0.0, float("inf")]
    own = rows.withColumn("_x", by.cast("double"))
    found = Bucketizer(splits=splits, inputCol="_x", outputCol=name, handleInvalid="keep").transform(own)
    return found.withColumn(name, F.col(name).cast("int")).drop("_x")


def running(counts: DataFrame, keys: list[str], value: str, sums: list[str], parts: int = PARTS) -> DataFrame:
    """counts (a row a distinct value of each key) with below_<c>: the sum of c over the key's smaller values.

    Sums of ranges come first, then those inside a range, so no task holds all values of a key. Rows with a null value are
    left out.
    """
    own = cut(counts.where(F.col(value).isNotNull()), F.col(value), parts=parts)
    w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # at most PARTS + 1 rows a key
    ranges = own.groupBy(*keys, "_p").agg(*(F.sum(c).alias(c) for c in sums)).select(*keys, "_p", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_before_{c}") for c in sums))
    inner = Window.partitionBy(*keys, "_p").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = own.join(ranges, [*keys, "_p"])
    return joined.withColumns({f"below_{c}": F.col(f"_before_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in sums}).drop("_p", *(f"_before_{c}" for c in sums))


def following(rows: DataFrame, keys: list[str], by: str, name: str) -> DataFrame:
    """rows with the next value of `by` (a number without ties) in their group; null for the last one.
    Rows without a value are left out."""
    own = cut(rows, F.col(by))
    w = Window.partitionBy(*keys).orderBy("_p").rowsBetween(1, Window.unboundedFollowing)
    firsts = own.groupBy(*keys, "_p").agg(F.min(by).alias("_f")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_p").alias("_q"), F.first("_f", ignorenulls=True).over(w).alias("_after"))
    same = own["_p"] == firsts["_q"]
    for i, k in enumerate(keys):
        same = same & own[k].eqNullSafe(firsts[f"_k{i}"])
    inner = Window.partitionBy(*keys, "_p").orderBy(by)
    joined = own.join(firsts, same)
    return joined.withColumn(name, F.coalesce(F.lead(by).over(inner), F.col("_after"))).drop("_p", "_q", "_after", *(f"_k{i}" for i in range(len(keys))))
