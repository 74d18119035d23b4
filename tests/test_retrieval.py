"""The vector index and the text join against brute force: bounds, blocks, copies, ties, nulls, and measured recall."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from talkspan import catalog_retrieval  # noqa: F401  (adds its queries)
from talkspan.catalog import QUERIES
from talkspan.functions import text as T
from talkspan.operators import retrieval as R
from talkspan.operators import text_retrieval as X
from talkspan.operators import vector_index as V

SCHEMA = "vec_id long, embedding array<float>, label string"


def brute(rows, k, least=-2.0):
    """The k best others of each row by (score to six places, id)."""
    out = set()
    unit = {}
    for i, v, _ in rows:
        x = np.array(v if v else [0.0], np.float32).astype(float)
        unit[i] = x / np.sqrt((x * x).sum()) if (x * x).sum() > 0 else None
    for i in unit:
        scores = [(-(0.0 if unit[i] is None or unit[j] is None else round(float(unit[i] @ unit[j]), 6)), j) for j in unit if j != i]
        out |= {(i, j, r + 1) for r, (s, j) in enumerate(sorted(x for x in scores if -x[0] >= least)[:k])}
    return out


def most_rows(frame):
    """The most rows that any operator of a plan gave out, as the run of frame counted them."""
    frame.collect()

    def walk(p):
        inner = {"AdaptiveSparkPlan": "executedPlan"}.get(p.nodeName(), "plan" if p.nodeName().endswith("QueryStage") else None)
        if inner:
            return walk(getattr(p, inner)())
        own, below = p.metrics().get("numOutputRows"), p.children()
        return max([own.get().value() if own.isDefined() else 0] + [walk(below.apply(k)) for k in range(below.size())])

    return walk(frame._jdf.queryExecution().executedPlan())


def vectors(n=120, dims=19):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=dims).tolist(), "ab"[i % 2]) for i in range(n)]
    copies = [(500 + i, rows[4][1], "c") for i in range(30)]  # one vector thirty times more
    return rows + copies + [(900, [0.0] * dims, "z"), (901, None, "z")]


def test_index_is_exact_with_all_cells(spark, tmp_path, monkeypatch):
    """In small blocks, with copies, a zero and a null vector, and a number of components that has no equal parts."""
    monkeypatch.setattr(V, "ROW_BLOCK", 16)
    monkeypatch.setattr(V, "QUERY_BLOCK", 8)
    rows = vectors()
    df = spark.createDataFrame(rows + [(None, [1.0] * 19, "x")], SCHEMA).withColumn("cell", F.lit("a name of the index"))
    V.write_index(df, f"file://{tmp_path}/ix", metadata=["label"], cells=5)
    assert V.read_cells(spark, f"file://{tmp_path}/ix").agg(F.sum("n")).first()[0] == len(rows)
    got = V.search(df, f"file://{tmp_path}/ix", k=4, metadata=["label"]).collect()
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == brute(rows, 4)
    names = {i: label for i, _, label in rows}
    assert all(r.label == names[r.vec_id] for r in got)
    some = V.search(df.where("vec_id < 9"), f"file://{tmp_path}/ix", k=3, least=0.3).collect()
    assert {(r.query_id, r.vec_id, r["rank"]) for r in some} == {x for x in brute(rows, 3, 0.3) if x[0] < 9}


def test_index_of_few_and_no_rows(spark, tmp_path):
    rows = vectors()[:2]
    V.write_index(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/two")
    got = V.search(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/two", k=10)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got.collect()} == {(0, 1, 1), (1, 0, 1)}
    V.write_index(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none")
    assert V.search(spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/none").count() == 0


def test_recall_grows_with_probes(spark, tmp_path):
    """On the given vectors, which hardly cluster, two thirds of the cells hold nine tenths of the answers; on vectors in
    clusters a tenth of them will do."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    V.write_index(e, f"file://{tmp_path}/ix")
    cells, exact = V.read_cells(spark, f"file://{tmp_path}/ix").count(), R.top_k(e, e).cache()
    share = lambda df, p, want: V.recall(V.search(df, f"file://{tmp_path}/{p[0]}", probes=p[1]), want)
    few, most = share(e, ("ix", max(1, cells // 8)), exact), share(e, ("ix", math.ceil(cells * 2 / 3)), exact)
    assert few < most and most >= 0.9
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    near = spark.createDataFrame([(i, (centres[i % 20] + 0.1 * rng.normal(size=16)).tolist(), "x") for i in range(600)], SCHEMA)
    V.write_index(near, f"file://{tmp_path}/near", cells=20)
    assert share(near, ("near", 2), R.top_k(near, near).cache()) >= 0.9


def test_top_k_by_blocks_keeps_no_block(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 25)
    rows = vectors(60)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in R.top_k(df, df, 3).collect()} == brute(rows, 3)


def test_search_makes_few_rows(spark, tmp_path):
    """Vectors without clusters: codes as bounds let most of 360,000 pairs through, which were rows of a shuffle."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, rng.normal(size=64).tolist(), "x") for i in range(600)], SCHEMA)
    V.write_index(df, f"file://{tmp_path}/ix")
    assert most_rows(V.search(df, f"file://{tmp_path}/ix", k=3)) < 30 * 600


def test_probed_cells_are_searched_exactly(spark, tmp_path, monkeypatch):
    """In blocks smaller than a cell and blocks of several cells, by brute force over the rows of the probed cells."""
    rows = [r for r in vectors() if r[1]]
    df = spark.createDataFrame(rows, SCHEMA)
    V.write_index(df, f"file://{tmp_path}/ix", cells=7, metadata=["label"])
    cell = {r.id: r.cell for r in V.read_rows(spark, f"file://{tmp_path}/ix").collect()}
    centres = np.array([r.v for r in spark.read.parquet(f"file://{tmp_path}/ix/centroids").orderBy("cell").collect()])
    x = R.unit(df.select("embedding").toArrow().column(0))
    closest = np.argsort((centres**2).sum(axis=1) / 2 - x @ centres.T, axis=1, kind="stable")[:, :2]
    score = np.round(x @ x.T, 6) + 0.0
    want = set()
    for i, (a, _, _) in enumerate(rows):
        found = sorted((-score[i, j], b) for j, (b, _, _) in enumerate(rows) if b != a and cell[b] in closest[i])
        want |= {(a, b, r + 1) for r, (_, b) in enumerate(found[:4])}
    for block in (11, 40, 65_536):
        monkeypatch.setattr(V, "ROW_BLOCK", block)
        monkeypatch.setattr(V, "LEAST_BLOCK", block)
        got = V.search(df, f"file://{tmp_path}/ix", k=4, probes=2, metadata=["label"]).collect()
        assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want


def test_block_of_rows_in_small_steps(monkeypatch):
    """Copies, own ids and ties, with few scores and queries at once, and cells that the radius leaves out."""
    monkeypatch.setattr(V, "SCORES", 40)
    monkeypatch.setattr(V, "QUERY_STEP", 7)
    rows = [r for r in vectors() if r[1]]
    rng = np.random.default_rng(4)
    far = np.zeros(19)
    far[3] = 5.0
    rows += [(2000 + i, (far + 0.1 * rng.normal(size=19)).tolist(), "far") for i in range(40)]
    x = np.array([np.array(v, np.float32) for _, v, _ in rows], float)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    ids, cell = np.array([i for i, _, _ in rows]), np.array([0 if c == "far" else 1 + i % 3 for i, _, c in rows], np.int32)
    centres = np.array([x[cell == c].mean(axis=0) for c in range(4)])
    for least in (None, 0.3):
        got = list(V._nearest_rows(x, ids, cell, x, ids, None, centres, 5, least))
        pairs = {(int(q), int(i)) for who, found, _, _ in got for q, i in zip(who, found)}
        assert pairs == {(q, i) for q, i, _ in brute(rows, 5, -2.0 if least is None else least)}


def test_cells_share_blocks():
    assert V._blocks([(0, 3), (2, 4), (3, 20), (5, 2), (6, 8)], 8) == ([(0, 0, 1), (2, 0, 1), (3, 1, 3), (5, 4, 1), (6, 5, 1)], 6)


# ---- texts -----------------------------------------------------------------------------------------------------


def answers_of(spark, queries, answers, least):
    q = spark.createDataFrame([(*r, "n") for r in queries], "id long, owner string, text string, word string")
    a = spark.createDataFrame([(*r, "n") for r in answers], "id long, owner string, text string, word string")
    return {r.id: (r.answer_id, r.score) for r in X.best_answers(q, a, least).collect()}


def by_brute_force(spark, queries, answers, least):
    texts = [t for _, _, t in queries + answers]
    words = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.keywords(F.coalesce("t", F.lit(""))).alias("w"))
    sets = {texts[r.i]: set(r.w) for r in words.collect()}
    held = [(i, o or "", sets[t]) for i, o, t in answers if i is not None and sets[t]]
    count = {}
    for _, _, w in held:
        for x in w:
            count[x] = count.get(x, 0) + 1
    square = {x: math.log((len(held) + 1) / (n + 1) + 1) ** 2 for x, n in count.items()}
    size = lambda w: math.sqrt(sum(square.get(x, 0) for x in w))
    out = {}
    for i, o, t in queries:
        scored = [(round(sum(square[x] for x in sets[t] & w) / (size(sets[t]) * size(w)), 6), -j) for j, p, w in held if p != (o or "") and sets[t] & w]
        best = max((s for s in scored if s[0] >= least), default=None)
        if best and i is not None:
            out[i] = (-best[1], best[0])
    return out


def invented(seed, n, first):
    rng = np.random.default_rng(seed)
    vocabulary = [f"word{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(100)]
    pick = lambda: " ".join(vocabulary[min(99, int(rng.exponential(12)))] for _ in range(rng.integers(1, 12)))
    return [(first + k, f"c{k % 9}" if k % 11 else None, pick()) for k in range(n)]


@pytest.mark.parametrize("least", [0.05, 0.3, 0.7, 1.0])
def test_text_join_equals_brute_force(spark, least):
    queries, held = invented(1, 60, 0), invented(2, 80, 1000)
    held += [(2000 + k, f"c{k % 3}", held[3][2]) for k in range(12)]  # copies, some by the owner of a query
    queries += [(500, "c0", held[3][2]), (501, "c1", held[3][2]), (502, None, held[3][2].upper()), (503, "c1", None), (504, "c1", ""), (505, "c1", "nothing alike anywhere"), (None, "c1", held[3][2])]
    held += [(None, "c9", held[3][2]), (3000, "c9", None), (3001, "c9", "the of to"), (3002, "c9", "x" * 50_000)]
    got = answers_of(spark, queries, held, least)
    assert got == by_brute_force(spark, queries, held, least)
    assert 500 in got and 503 not in got and 505 not in got


def test_text_join_of_nothing(spark):
    some = [(1, "a", "several ordinary words")]
    assert answers_of(spark, [], some, 0.3) == {} == answers_of(spark, some, [], 0.3) == answers_of(spark, some, some, 0.3)
    assert answers_of(spark, some, [(2, "b", "several ordinary words")], 0.3) == {1: (2, 1.0)}


def test_no_pair_of_texts_is_a_row(spark):
    """Common words at a low threshold: every text is a candidate of every other, 90,000 pairs."""
    letters = lambda k: "own" + "".join("abcdefghij"[int(d)] for d in f"{k:03}")
    rows = [(k, f"c{k}", f"several ordinary words {letters(k)}") for k in range(300)]
    df = spark.createDataFrame(rows, "id long, owner string, text string")
    out = X.best_answers(df, df, 0.05)
    assert most_rows(out) < 20 * len(rows)
    assert {r.id: (r.answer_id, r.score) for r in out.collect()} == by_brute_force(spark, rows, rows, 0.05)


@pytest.mark.parametrize("block", [8, 32_768])
def test_text_join_in_small_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    monkeypatch.setattr(X, "LEAST_BLOCK", 4)
    queries, held = invented(3, 50, 0), invented(4, 60, 1000)
    assert answers_of(spark, queries, held, 0.05) == by_brute_force(spark, queries, held, 0.05)


def test_texts_are_not_sent_by_block(spark, monkeypatch):
    """Ten blocks a side: a text was a row of a shuffle once for each block of the other side, 3000 rows of each side."""
    monkeypatch.setattr(X, "BLOCK", 30)
    letters = lambda k: "own" + "".join("abcdefghij"[int(d)] for d in f"{k:03}")
    rows = [(k, f"c{k}", f"several ordinary words {letters(k)}") for k in range(300)]
    df = spark.createDataFrame(rows, "id long, owner string, text string")
    assert most_rows(X.best_answers(df, df, 1.0)) <= len(rows)


def test_dense_words_and_postings_agree(monkeypatch):
    """The same block with all words dense, some, and none, and with few products at once."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    sets = [np.unique(np.minimum(rng.exponential(9, rng.integers(1, 15)).astype(int), 60)) for _ in range(90)]
    n = np.bincount(np.concatenate(sets), minlength=61)
    square = np.log((len(sets) + 1) / (n + 1) + 1) ** 2
    length = [float(np.sqrt(square[s].sum())) for s in sets]
    owners = [f"c{k % 13}" for k in range(90)]
    own = pa.table({"id": pa.array(range(90), pa.int64()), "owner": owners, "length": length, "ids": [s.tolist() for s in sets], "counts": [n[s].tolist() for s in sets]})
    want = set()
    for i, s in enumerate(sets):
        best = {}
        for j, t in enumerate(sets):
            score = round(float(square[np.intersect1d(s, t)].sum() / (length[i] * length[j])), 6)
            best[owners[j]] = max(best.get(owners[j], (-1.0, 0)), (score, -j))
        want |= {(i, -j, score) for score, j in sorted(best.values(), reverse=True)[:2] if score >= 0.2}
    for dense, share, scores in ((256, 0.0, 1 << 22), (256, 0.05, 1 << 10), (4, 0.0, 1 << 8), (0, 0.0, 50)):
        monkeypatch.setattr(X, "DENSE", dense)
        monkeypatch.setattr(X, "DENSE_SHARE", share)
        monkeypatch.setattr(X, "SCORES", scores)
        assert {(int(i), int(j), float(s)) for i, j, s in X._nearest(own, own, len(sets), 0.2)} == want


def test_text_query_makes_no_pairs(spark):
    """n04_text_retrieval: 2121 contexts and as many answers of 88 words; the words are rows, pairs that share one are not."""
    assert most_rows(QUERIES["n04_text_retrieval"](spark, "/root/testdata/sf0.1")) < 400_000


def test_query_set_makes_no_pairs(spark):
    """n05_retrieve: 40 queries against 2000 vectors, of which 80,000 pairs come."""
    assert most_rows(QUERIES["n05_retrieve"](spark, "/root/testdata/sf0.1")) < 10_000


def test_few_queries_send_rows_once(spark, tmp_path, monkeypatch):
    """150 queries against 3000 vectors: with tasks made of blocks of queries, a vector was a row of a shuffle three times."""
    monkeypatch.setattr(V, "LEAST_BLOCK", 64)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist(), "a") for i in range(3000)], SCHEMA)
    V.write_index(df, f"file://{tmp_path}/ix")
    out = V.search(df.where("vec_id % 20 = 0"), f"file://{tmp_path}/ix", k=1)
    assert most_rows(out) <= 3000
    assert out.count() == 150
