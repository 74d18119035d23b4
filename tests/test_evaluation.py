"""Evaluation queries: hand-worked and brute-force cases, and each checked query against its SQL on the smallest tables."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from talkspan import catalog, catalog_evaluation
from talkspan.functions import topics
from talkspan.operators import agreement as G
from talkspan.operators import pairs as P
from test_dialogue import one, test_query_matches_sql

OWN = sorted(k for k, f in catalog.QUERIES.items() if f.__module__ == catalog_evaluation.__name__)


@pytest.mark.parametrize("name", [k for k in OWN if k in catalog.SQL])
def test_own_query_matches_sql(spark, name):
    test_query_matches_sql(spark, name)


def _bleu(h, r):
    h, r = h.lower().split(), r.lower().split()
    logs = 0.0
    for n in range(1, 5):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
        hits = sum((a & b).values())
        if n == 1 and not hits:
            return 0.0
        logs += math.log((hits or 0.1) / max(1, sum(a.values())))
    return math.exp(logs / 4) * (1.0 if len(h) > len(r) else math.exp(1 - len(r) / len(h)))


def test_bleu(spark):
    rows = [(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b", "a b c d e"), (3, "the the the the", "the cat"), (4, "x", "y"), (5, "", "a"), (6, None, None), (7, "long word " * 300, "word long " * 200)]
    got = {r["id"]: r["bleu"] for r in G.bleu(spark.createDataFrame(rows, "id long, h string, r string"), "id", "h", "r").collect()}
    assert set(got) == set(range(1, 8))
    for i, h, r in rows:
        assert got[i] == pytest.approx(_bleu(h or "", r or ""), abs=1e-6)


def test_krippendorff(spark):
    same = [(i, a, 1 + i % 3) for i in range(9) for a in "xyz"]
    alpha = lambda rows: G.krippendorff_ordinal(spark.createDataFrame(rows, "id int, who string, v int"), "id", "v", [1, 2, 3]).first()
    assert alpha(same)["alpha"] == 1.0
    assert alpha([(1, "x", 1), (1, "y", 1)])["alpha"] is None
    assert alpha([(1, "x", None), (2, "y", 3)])["n_units"] == 0
    # units (1,2) and (2,1): with n=4, both distances are equal, so alpha = 1 - 3 * 4 / 8
    assert alpha([(1, "x", 1), (1, "y", 2), (2, "x", 2), (2, "y", 1)])["alpha"] == pytest.approx(-0.5)


def test_mann_whitney_p(spark):
    rows = [("k", "a", v) for v in (1.0, 2.0, 3.0, 4.0)] + [("k", "b", v) for v in (3.0, 5.0, 6.0, 7.0)]
    r = G.mann_whitney_p(spark.createDataFrame(rows, "key string, s string, v double"), "key", "v", "s", "a", "b").first()
    assert r["u"] == 1.5
    z = (abs(1.5 - 8) - 0.5) / math.sqrt(16 / 12 * (9 - 6 / 56))
    assert r["p_value"] == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_topics(spark):
    # art: a word, first found inside "start" before the middle, so 1.3; class: a word after the middle, so 1
    assert one(spark, "I will start the art class", topics.weighted_topic) == "hobbies"
    assert one(spark, "I will start the class", topics.weighted_topic) == "education"
    assert one(spark, "zzz", topics.weighted_topic) == "general" == one(spark, None, topics.weighted_topic)
    assert one(spark, "Hot food", topics.first_topic) == "weather"


def test_labels_of_odd_rows(spark):
    rows = spark.createDataFrame([("multiple", "multi_Quality_manner"), ("manner", "x"), (None, None), ("none", "none")], "m string, v string")
    out = rows.select(*(c.alias(k) for k, c in P.extract_labels(F.col("m"), F.col("v")).items())).collect()
    assert [tuple(r) for r in out] == [(0, 0, 0, 1), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert P.repairable(rows.toDF("maxim", "violation_type"), "violation_type").count() == 2


def test_samples_of_the_reference_size(spark):
    sf = "/root/testdata/sf0.01"
    pairs = catalog.preference_pairs(spark, sf).count()
    assert pairs > 50 and catalog.QUERIES["a41_uncertainty_top"](spark, sf).count() == min(500, pairs)
    got = Counter(r["category"] for r in catalog.QUERIES["t11_annotation_sample"](spark, sf).collect())
    assert 20 < got["clean"] <= 200 and got["random"] <= 100 and all(20 < got[m] <= 200 for m in catalog.MAXIMS)
