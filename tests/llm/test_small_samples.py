"""Languages with hardly any labelled text must not take over the texts of others."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talkspan.llm import langid

SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(SF)
    samples = langid.training_sample(docs)
    texts = [r.text for r in docs.where("text is not null").orderBy("doc_id").limit(160).collect()]
    return samples, pa.array([*texts, "", "12 34", "ok", "Ελληνικά κείμενα", "ok ok ok"]), langid.Model(samples).predict


@pytest.mark.parametrize("extra", ["", "ok", "the quick brown fox.", "12345 678", "e", "a b c d e f g h i j k l m n o p q r s t u v w x y z"])
def test_tiny_samples_change_no_prediction(learned, extra):
    samples, texts, predict = learned
    lang, score = predict(texts)
    got, more = langid.Model(samples | {"xx": extra}).predict(texts)
    assert got[:160] == lang[:160] and (more[:160] >= 0).all() and (more <= 1).all()
    assert got[160:162] == ["und", "und"]


def test_tiny_samples_through_the_table(spark, learned):
    docs = spark.read.parquet(SF).select("doc_id", "text", "lang")
    few = spark.createDataFrame([(10_000_000 + k, "ok", "xx") for k in range(12)], "doc_id long, text string, lang string")
    before = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    after = {r.doc_id: r.lang_pred for r in langid.identify(docs.unionByName(few)).collect()}
    assert {k: after[k] for k in before} == before


def test_bytes_no_language_knows_cost_more_than_letters_it_knows():
    """A language pays its literal bits for every byte that its sample lacks."""
    model = langid.Model({"ab": "ab" * 3000, "cd": "cd" * 3000, "none": ""})
    count, strange = model.counts(pa.array(["abab", "cdxx", "", "xxxx"]))
    assert strange.tolist() == [[0, 4, 4], [4, 2, 4], [0, 0, 0], [4, 4, 4]]
    assert model.predict(pa.array(["abab", "dcdc"]))[0] == ["ab", "cd"]


def test_a_first_document_of_any_size_is_cut(spark):
    long = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("Ein langer Satz. "), 200_000).alias("text"), F.lit("de").alias("lang"))
    own = long.where(langid.fold_of() != 2)
    samples = langid.training_sample(own)
    if samples:  # doc_id 1 may be of the held-out fold
        assert len(samples["de"]) == langid.LANGUAGE_BYTES
    assert len(langid.Model({"de": "ö" * 100_000}).automata[0].table) <= 2 * langid.LANGUAGE_BYTES * 4
    many = langid.Model({f"l{k}": "abc " * 30_000 for k in range(32)})
    assert (2 ** many.log_size).round().max() == langid.TOTAL_BYTES // 32
