"""Makers of violated responses: SQL, hand-worked cases and properties that hold for every choice."""

import pytest
from pyspark.sql import functions as F

from talkspan import catalog, catalog_makers  # noqa: F401
from talkspan.functions import makers as K
from test_dialogue import test_query_matches_sql

TEXT = "The river Amazon is long. It has 1,250 species of fish! Many People visit Brazil every year. Boats help."
ROWS = [(i, TEXT, "Tell me about the river please.") for i in range(40)] + [(40, None, None), (41, "", ""), (42, "Hi", None), (43, "!!! ... ???", "x")]


@pytest.mark.parametrize("name", ["i13_i14_i16_phrases", "i06_relation_drift", "i03_quality_unsupported", "i18_i21_short", "i22_adversarial", "i23_mined_patterns", "i24_schedule", "i25_obvious_pairs"])
def test_maker_matches_sql(spark, name):
    test_query_matches_sql(spark, name)


@pytest.fixture(scope="module")
def made(spark):
    rows = spark.createDataFrame(ROWS, "k long, t string, c string")
    k, t, c = F.col("k"), F.col("t"), F.col("c")
    cols = K.singles(k, t, c) | {f"b_{n}": x for n, x in (K.realistic_text(k, t) | K.realistic_words(k, t)).items()}
    cols |= {"multi": K.multiple(k, t, ["quality", "quantity"]), "about": K.multiple(k, t, ["quality", "relation"])}
    return {r["k"]: r for r in rows.select("k", *(x.alias(n) for n, x in cols.items())).collect()}


def test_single_violations(made):
    whole = [made[i] for i in range(40)]
    assert {r["quantity_under"] for r in whole} == {"river... that's interesting to consider.", "Regarding river, there are various aspects.", "Yes, river is quite something."}
    assert all(r["quantity_over"].endswith("Boats help. So, to summarize, the river amazon is long. That's right - 1,250.") for r in whole if r["quantity_over"])
    numbers = {r["quality_contradiction"].split(" species")[0].split()[-1] for r in whole}
    assert numbers == {"1,375", "1,125", "625"}
    for r in whole:
        assert r["relation_off_topic"] in sum(K.OFF_TOPIC.values(), [])
        assert sorted(r["manner_shuffled"].split()) == sorted(TEXT.split()) and r["manner_shuffled"] != TEXT
        assert r["manner_runon"] == "The river Amazon is long It has 1,250 species of fish Many People visit Brazil every year Boats help"
        if r["manner_ambiguous"]:
            changed = [(a, b) for a, b in zip(TEXT.split(), r["manner_ambiguous"].split()) if a != b]
            assert 1 <= len(changed) <= 3 and all(b in K.SUBJECTS and a in ("Amazon", "Many", "People", "Brazil", "Boats") for a, b in changed)
        assert r["about"] in sum(K.OFF_TOPIC.values(), [])
    assert len({r["manner_ambiguous"] for r in whole}) > 3


def test_realistic_violations(made):
    for r in (made[i] for i in range(40)):
        assert r["b_relation_agenda"].startswith("The river Amazon is long. But honestly, ")
        assert r["b_manner_bury"].endswith("Boats help. The river Amazon is long.")
        words = [w for w in r["b_manner_pronouns"].split() if w in ("it", "it.", "it,")]
        assert len(words) <= 2
        assert r["b_manner_jargon"].split(" ")[-1] in ("help.", "facilitate.")
        assert TEXT.lower().replace(".", "").replace("!", "").split()[-1] in r["b_manner_runon"].lower()
        kept = r["b_manner_hedging"]
        for h in sorted(K.HEDGES, key=len, reverse=True):
            kept = kept.replace(f" {h} ", " ").replace(f" {h} ", " ")
        assert kept == TEXT
        for s in ("The river Amazon is long.", "Boats help."):
            assert s in r["b_manner_disorganized"]


def test_odd_texts(made):
    for n, v in made[40].asDict().items():
        assert n == "k" or v is None, n
    singles = ["quantity_under", "quantity_over", "quality_unsupported", "quality_contradiction", "relation_off_topic", "relation_drift", "manner_ambiguous", "manner_shuffled", "manner_jargon", "manner_runon"]
    assert all(made[k][n] is None for k in (40, 41, 42) for n in singles)


def test_notebook_makers(spark):
    r = spark.createDataFrame([(1, "One thing. Two.", "ctx"), (2, "", None)], "k long, t string, c string")
    out = r.select("k", *(c.alias(n) for n, c in K.short_texts(F.col("k"), F.col("t"), F.col("c")).items())).orderBy("k").collect()
    assert out[0]["relation_tangential"].startswith("Right, one thing. ") and out[0]["quality_weasel"].endswith(" one thing. Two.")
    assert out[0]["quality_overgeneral"].startswith("One thing. Two ") and out[0]["manner_lede"].endswith("One thing. Two.")
    assert all(v is not None for v in out[1])


def test_schedule(spark):
    rows = catalog.QUERIES["i24_schedule"](spark, "/root/testdata/sf0.001").select("maxim", "method").collect()
    assert {(r["maxim"], r["method"]) for r in rows} == {(m, g) for m in ("quantity", "quality", "relation", "manner") for g in ("injector", "mined", "adversarial")}


def test_unknown_maxims_are_an_error(spark):
    with pytest.raises(ValueError):
        K.multiple(F.lit(1), F.lit("text"), ["quality", "style"])
