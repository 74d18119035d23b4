"""Dialogue operators: hand-worked cases, and every checked query against its SQL on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from talkspan import catalog
from talkspan.functions import text as T

SF = "/root/testdata/sf0.001"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, bad",
    [
        ("", True),
        ("ok", True),
        ("This answer is fine and has nothing odd about it.", False),
        ("What is this!!! really now", True),
        ("one two three one two three one two three", True),
        ("wow! such! text! many! marks!", True),
    ],
)
def test_degenerate(spark, text, bad):
    assert one(spark, text, T.is_degenerate) is bad


def test_text_primitives(spark):
    assert one(spark, "One. Two?  Three! four", T.sentences) == ["One.", "Two?", "Three!", "four"]
    assert one(spark, "", T.sentences) == []
    assert one(spark, "The Quick brown schpfö foxes", T.keywords) == ["quick", "brown", "foxes"]
    assert one(spark, "It was 1,234.5 or 7", T.numbers) == ["1,234.5", "7"]
    assert one(spark, "Add water and salt, air and fire", T.jargon) == "Add H2O and sodium chloride, atmospheric gases and fire"
    assert one(spark, "A b. C d! E", T.runon) == "A b C d E"
    assert one(spark, "One sentence.", T.runon) is None


def _key(row):
    return tuple(f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "as_tuple") else str(v) for v in row)


@pytest.mark.parametrize("name", ["p01_context_examples", "h08_keyword_overlap", "a10_a11_multilabel", "a12_auc", "a31_cooperation", "p17_fix_inverted", "t02_hash_dedup", "t17_blinding", "j09_nearest", "i10_runon", "a02_distribution", "a04_a05_weights", "a19_system_comparison", "a20_mann_whitney", "a36_relevance_summary", "a37_quantity_clarity", "t07_t14_holdout", "t09_ratio_balance", "t10_balance_to_least", "t16_pair_dedup", "j02_unblinding", "j11_response_pairs", "x19_match"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(catalog.SQL[name])
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(_key([r[c] for c in cols]) for r in df.collect()) == sorted(_key([r[i] for i in at]) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
