"""Bootstrap weights and intervals, ranges of equal counts, and what is ranked with them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkspan.operators import bootstrap as B
from talkspan.operators import metrics as A
from talkspan.operators import ranges
from talkspan.operators import sampling as S

SCORES = "id long, maxim string, x double"


def test_weights_are_poisson():
    rng = np.random.default_rng(0)
    w = B.weights(rng.integers(1, B.PRIME, 400), B.resample_numbers(2000))
    share = np.bincount(w.astype(int).ravel(), minlength=8) / w.size
    assert share[:7] == pytest.approx([math.exp(-1) / math.factorial(k) for k in range(7)], abs=0.002)
    assert w.mean() == pytest.approx(1, abs=0.005) and w.var() == pytest.approx(1, abs=0.01)
    apart = np.corrcoef(w)[np.triu_indices(400, 1)]  # rows do not move together, nor do resamples
    assert abs(apart.mean()) < 0.001 and np.abs(apart).max() < 0.15
    assert abs(np.corrcoef(w.T[:300])[np.triu_indices(300, 1)].mean()) < 0.002


def test_resamples_do_not_depend_on_partitions(spark):
    rows = [(k if k % 17 else None, "ab"[k % 2] if k % 5 else None, float(k % 7) if k % 11 else None) for k in range(90)]
    df = spark.createDataFrame(rows, SCORES)
    one, many = ({(r.maxim, r.b): (r.weight, r.x) for r in B.resampled(df.repartition(n), ["maxim"], ["x"], 300).collect()} for n in (1, 7))
    assert one == many and len(one) == 900
    import hashlib

    number = lambda i: int(hashlib.md5(f"{'' if i is None else i}|{B.SALT}".encode()).hexdigest()[:8], 16) % (B.PRIME - 1) + 1
    own = [r for r in rows if r[1] == "a" and r[2] is not None]
    w = B.weights(np.array([number(r[0]) for r in own]), B.resample_numbers(300))
    for b in (0, 1, 249, 250, 299):
        assert one["a", b] == (w[:, b].sum(), pytest.approx(sum(x * r[2] for x, r in zip(w[:, b], own))))
    assert B.resampled(df.limit(0), ["maxim"], ["x"], 10).count() == 0


def test_mean_interval_has_the_right_width(spark):
    rows = spark.range(400).select("id", F.lit("m").alias("maxim"), (F.col("id") % 10 / 10).alias("p"))
    r = B.mean_interval(rows, "p", ["maxim"]).first()
    spread = math.sqrt(sum((k / 10 - 0.45) ** 2 for k in range(10)) / 10 / 400)  # the standard error of the mean
    assert r["mean"] == pytest.approx(0.45, abs=spread / 10) and r["high"] - r["low"] == pytest.approx(2 * 1.96 * spread, rel=0.05)
    whole = B.mean_interval(rows, "p", [], by_index=True).first()
    assert whole["low"] == pytest.approx(r["low"], abs=spread / 10)


def test_f1_interval_brackets_the_estimate(spark):
    rows = spark.range(400).select("id", F.lit("m").alias("maxim"), (F.col("id") % 2 == 0).alias("y"), (F.col("id") % 4 < 3).alias("g"))
    got = {r["maxim"]: r for r in B.f1_interval(rows, F.col("y"), F.col("g")).collect()}
    exact = 2 * 200 / (2 * 200 + 100)
    assert set(got) == {"m", "macro"} and got["m"]["low"] < exact < got["m"]["high"] and abs(got["m"]["mean"] - exact) < 0.005


@pytest.mark.parametrize("spread", ["x", "case when x = 7 then 1e12 else x end", "exp(x / 100)", "-1 / (x + 1)"])
def test_ranges_are_even_however_values_lie(spark, spread):
    """With one value of 1e12, ranges of equal width would leave all others in one."""
    rows = spark.range(40_000).selectExpr("id as x").selectExpr(f"cast({spread} as double) as v")
    sizes = [r["count"] for r in ranges.cut(rows, F.col("v"), parts=200).groupBy("_p").count().collect()]
    assert max(sizes) < 2.5 * 40_000 / 200 and len(sizes) > 150


def test_ranges_of_odd_values(spark):
    rows = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),), (float("-inf"),), (1.0,), (2.0,)], "v double")
    got = {str(r.v): r["_p"] for r in ranges.cut(rows, F.col("v")).collect()}
    assert got["-inf"] <= got["1.0"] < got["2.0"] <= got["inf"] < got["nan"] and got["None"] is None
    assert ranges.cut(rows.limit(0), F.col("v")).count() == 0 == ranges.running(rows.limit(0).withColumn("n", F.lit(1)), [], "v", ["n"]).count()


def test_running_sums_and_ranks_with_an_outlier(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.exponential(size=3000), 3)
    values[5] = 1e12
    rows = spark.createDataFrame([(k, "ab"[k % 2], float(v), int(k % 3 == 0)) for k, v in enumerate(values)], "id int, maxim string, p_base double, y int")
    counts = rows.groupBy("maxim", "p_base").agg(F.count("*").alias("n"))
    got = {(r.maxim, r.p_base): r.below_n for r in ranges.running(counts, ["maxim"], "p_base", ["n"]).collect()}
    for k in range(0, 3000, 50):
        assert got["ab"[k % 2], values[k]] == (values[k % 2 :: 2] < values[k]).sum()
    auc = {r.maxim: r.auc for r in A.auc(rows).collect()}
    for k in range(2):
        own, y = values[k::2], np.arange(3000)[k::2] % 3 == 0
        pairs = own[y][:, None] - own[~y][None, :]
        assert auc["ab"[k]] == pytest.approx(((pairs > 0) + (pairs == 0) / 2).mean(), abs=1e-6)


def test_percentiles_and_latencies(spark):
    values = [3.0, 1.0, 2.0, 2.0, 1e12, 5.0, 8.0]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 4.0), ("b", None), ("c", 0.0)], "k string, v double")
    got = {r.k: r for r in A.latency_profile(rows, ["k"], "v").collect()}
    assert got["a"]["p50"] == 3.0 and got["a"]["p95"] == pytest.approx(np.percentile(values, 95)) and (got["a"]["least"], got["a"]["most"]) == (1.0, 1e12)
    assert (got["b"]["p50"], got["b"]["per_second"], got["b"]["n"]) == (4.0, 250.0, 2) and got["c"]["per_second"] is None
    at = {r.p: r.value for r in A.index_percentiles(rows.where("k = 'a'"), "v", [0, 10, 50, 99]).collect()}
    assert at == {p: sorted(values)[int(7 * p / 100)] for p in (0, 10, 50, 99)}


def test_following_and_placed(spark):
    rows = [(k * 37 % 1009, "ab"[k % 2] if k % 7 else None) for k in range(900)]
    df = spark.createDataFrame(rows, "v long, g string")
    got = {r.v: r.after for r in ranges.following(df, ["g"], "v", "after").collect()}
    for g in ("a", "b", None):
        own = sorted(v for v, x in rows if x == g)
        assert [got[v] for v in own] == [*own[1:], None]
    placed = {r.v: (r["_k"], r["_n"]) for r in S.placed(df, ["g"], F.col("v"), "v").collect()}
    own = sorted(v for v, x in rows if x is None)
    assert [placed[v] for v in own] == [(k + 1, len(own)) for k in range(len(own))]
