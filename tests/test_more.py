"""Edge rows of texts, readers and writers, plans without one-task windows, and statistics by hand."""

import math

import pytest
from pyspark.sql import functions as F

from talkspan import catalog_more  # noqa: F401
from talkspan.functions import heuristics as H
from talkspan.functions import text as T
from talkspan.operators import agreement as G
from talkspan.operators import metrics as A
from talkspan.operators import pairs as P
from talkspan.operators import retrieval as R
from talkspan.operators import sampling as S
from talkspan.sources import tables as IO

EDGE = ["", "   ", "   ", "schpfö getz", "one\ntwo three", "no terminator here", "[agent_1]: hello there", "cost 1,234.5 now", "A.  . B", None, "É x12 12x 3"]


def rows_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


def test_edge_rows_do_not_crash(spark):
    made = [c(F.col("t")) for c in (T.words, T.sentences, T.keywords, T.pronouns, T.numbers, T.entities, T.named_entities, T.jargon, T.is_degenerate, T.word_bang, T.quality_response, T.clean_artifacts, H.sentence_overlaps)]
    got = rows_of(spark, EDGE).select("id", *(c.alias(f"c{k}") for k, c in enumerate(made)), P.uncertainty("t", "t").alias("u")).orderBy("id").collect()
    assert len(got) == len(EDGE)
    assert got[3]["c2"] == ["getz"] and got[7]["c4"] == ["1,234.5"] and got[10]["c4"] == ["3"]
    assert got[0]["u"] == 0.5 and got[5]["u"] == 1.0 and got[10]["c6"] == []
    assert got[8]["c12"] == [0.0, 0.0, 0.0]


def test_registry_and_labels_agree(spark):
    rows = spark.createDataFrame([(1, "The answer is fine. It is long enough to count as one.", "[user]: what is it", None), (2, "", "", "x"), (3, "Paris is big. They say so. It is so.", "where", "Rome is old")], "id int, response string, context_text string, evidence string")
    out = {r["id"]: r for r in H.weak_labels(rows).collect()}
    assert out[1]["quality"]["probability"] == 0 and out[1]["quality"]["agreement"] == 1  # no evidence: its only vote counts
    assert all(0 <= out[k][m]["probability"] <= 1 for k in out for m in ("quantity", "quality", "relation", "manner"))
    own, r, c, e = H.prepare(rows)
    direct = rows.select("id", H.keyword_overlap(F.col("response"), F.col("context_text"))["score"].alias("s"))
    read = own.select("id", H.REGISTRY["keyword_overlap"](r, c, e)["score"].alias("s"))
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, read.collect()))


def test_percentiles_and_running_counts(spark):
    values = [3.0, 1.0, 2.0, 2.0, 10.0, 7.5]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 4.0), ("c", None)], "k string, v double")
    got = {(r["k"], r["share"]): r["value"] for r in A.linear_percentiles(rows, ["k"], "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    s = sorted(values)
    for p in (0.0, 0.5, 0.9, 1.0):
        h = (len(s) - 1) * p
        assert got["a", p] == pytest.approx(s[math.floor(h)] + (s[math.ceil(h)] - s[math.floor(h)]) * (h - math.floor(h)))
        assert got["b", p] == 4.0
    counts = rows.where("v is not null").groupBy("k", "v").agg(F.count("*").alias("n"))
    for parts in (1, 3, 4096):
        run = {(r["k"], r["v"]): r["below_n"] for r in A.running(counts, ["k"], "v", ["n"], parts).collect()}
        assert run == {("a", 1.0): 0, ("a", 2.0): 1, ("a", 3.0): 3, ("a", 7.5): 4, ("a", 10.0): 5, ("b", 4.0): 0}


def test_places_need_no_task_with_all_rows(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 2).alias("g"))
    for keys in ([], ["g"]):
        placed = S.placed(rows, keys, F.col("id"), "id", parts=7).collect()
        for r in placed:
            assert r["_k"] == (r["id"] // 2 + 1 if keys else r["id"] + 1) and r["_n"] == (500 if keys else 1000)
    kept = [r["id"] for r in S.every_nth(rows, ["g"], "id", 50).collect()]
    assert sorted(kept) == [x for x in range(1000) if (x // 2) % 10 == 0]
    parts = {r["split"] for r in S.stratified_split(rows, [], "id", "s").collect()}
    assert parts == {"train", "val", "test"} and S.stratified_split(rows.limit(0), [], "id", "s").count() == 0


def test_kappa_by_hand(spark):
    rows = spark.createDataFrame([("m", 1, 1), ("m", 1, 2), ("m", 2, 2), ("m", 3, 3), ("m", None, 3), ("same", 1, 1), ("same", 1, 1)], "k string, a int, b int")
    got = {r["k"]: r for r in G.kappa(rows, ["k"]).collect()}
    po, pe = 3 / 4, (2 * 1 + 1 * 2 + 1 * 1) / 16
    assert got["m"]["n"] == 4 and got["m"]["kappa"] == pytest.approx((po - pe) / (1 - pe), abs=1e-6) and got["same"]["kappa"] == 1.0


def test_thresholds_by_hand(spark):
    rows = spark.createDataFrame([(i, "m", b, t, 0) for i, (b, t) in enumerate([(0.9, 0.41), (0.8, 0.42), (0.7, 0.95), (0.2, 0.1), (0.6, 0.3)])], "id int, maxim string, p_base double, p_tuned double, y int")
    best = A.optimal_thresholds(rows, list(range(40, 80))).first()
    assert (best["t"], best["improvement"]) == (42, 0.75)  # 4 of 5 over .42 at first, 1 of 5 after
    none = A.optimal_thresholds(rows.withColumn("p_tuned", F.lit(0.0)), [40, 50]).first()
    assert none["t"] == 50 and none["improvement"] is None


def test_nearest_vectors(spark, monkeypatch):
    vectors = [(k, [math.cos(k / 7), math.sin(k / 7), 0.5]) for k in range(40)] + [(50, [0.0, 0.0, 0.0]), (60, None)]
    e = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    want = {(r["query_id"], r["rank"]): r["vec_id"] for r in R.top_k(e.where("vec_id < 5"), e, 3).collect()}
    for q in range(5):
        near = sorted((x for x in range(40) if x != q), key=lambda x: (-round(math.cos((x - q) / 7), 5), x))
        assert want[q, 1] == near[0]
    monkeypatch.setattr(R, "QUERY_BLOCK", 2)
    monkeypatch.setattr(R, "SCORES", 8)
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in R.top_k(e.where("vec_id < 5"), e, 3).collect()} == want
    assert R.top_k(e.limit(0), e).count() == 0
    top = R.top_k(e.where("vec_id in (0, 50)"), e, 1)
    kept = {r["query_id"]: r["retrieved"] for r in R.retrieve_or_keep(top, e.where("vec_id in (0, 50)"), 0.3).collect()}
    assert kept == {0: True, 50: False}


def test_files_come_back_as_they_were(spark, tmp_path):
    texts = [' "quoted", and spaced ', "line\nbreak", "plain"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, chosen string")
    IO.write_pairs(rows, f"file://{tmp_path}/pairs", ["id", "chosen"])
    back = spark.read.schema("id long, chosen string").option("header", True).option("multiLine", True).option("escape", '"').csv(f"file://{tmp_path}/pairs")
    assert [r["chosen"] for r in back.orderBy("id").collect()] == texts
    with pytest.raises(FileNotFoundError):
        IO.first_existing(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/b"])
    with pytest.raises(ValueError):
        IO.require_columns(rows, ["id", "score"])
    with pytest.raises(Exception, match="missing values: chosen"):
        IO.require_columns(rows.unionByName(spark.createDataFrame([(9, None)], "id long, chosen string")), ["id", "chosen"]).collect()


def test_router(spark):
    rows = spark.createDataFrame([(1, ["relation", "manner"], "old text of some length", None, "found text of some length"), (2, ["quality"], "old text of some length", "OK", None), (3, ["manner"], "old text of some length", "new text of some length", None), (4, [], "old text of some length", "x", "y")], "id int, v array<string>, t string, e string, r string")
    got = {x["id"]: (x["w"], x["o"]) for x in rows.select("id", P.route(F.col("v")).alias("w"), P.repaired(P.route(F.col("v")), F.col("t"), F.col("e"), F.col("r")).alias("o")).collect()}
    assert got == {1: ("retrieve", "found text of some length"), 2: ("edit", "old text of some length"), 3: ("edit", "new text of some length"), 4: ("none", "old text of some length")}
    assert [r[0] for r in rows_of(spark, ["a b c d e", ""]).select(P.length_guard(F.col("t"), F.lit("a b c d"))).collect()] == [True, False]


def test_mcnemar_p_by_hand(spark):
    pairs = [(0.9, 0.1)] * 12 + [(0.1, 0.9)] * 3 + [(0.9, 0.9)] * 5
    r = A.mcnemar(spark.createDataFrame([("m", a, b) for a, b in pairs], "maxim string, p_base double, p_tuned double")).first()
    assert (r["base_only"], r["tuned_only"], r["both"], r["neither"]) == (12, 3, 5, 0)
    assert r["chi2"] == pytest.approx((9 - 1) ** 2 / 15, abs=1e-6)
    assert r["p_value"] == pytest.approx(math.erfc(math.sqrt(64 / 15 / 2)), abs=1e-6)  # 0.0389: chi-square of one degree
    assert r["p_value"] == pytest.approx(0.0389, abs=1e-3)
