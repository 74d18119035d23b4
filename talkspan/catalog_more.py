"""Queries of readers and writers, audits, reports, model outputs and batches, registered in the catalog.

Queries of readers and writers write their table's rows in the format and read them back. As in catalog, values that
come from models or people are stand-ins by md5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import makers_sql as Q
from .catalog import _CM, _M, _ML, _NEXT, MAXIMS, SQL_EXAMPLES, SQL_PAIRS, SQL_SCORES, SQL_VOTES, _sql_u, _u, examples, preference_pairs, query, scores, turns
from .catalog_evaluation import _ID, KINDS, SQL_RATINGS, SQL_VIOLATED, _of, _pick, _sql_of, id_, ratings, violated
from .catalog_makers import SQL_MAKER_INPUT, _id, sql_by_strategy, sql_realistic
from .functions import heuristics as H
from .functions import makers as K
from .functions import text as T
from .operators import agreement as G
from .operators import examples as E
from .operators import metrics as A
from .operators import pairs as P
from .operators import retrieval as R
from .operators import sampling as S
from .sources import tables as IO
from .sources.tables import table
from .streaming.turns import event_counts

# ---- readers and writers ---------------------------------------------------------------------------------------


@query("s01_json_conversations", "SELECT conv_id::VARCHAR AS conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn)-1)::INT AS turn, role, md5(text) AS text FROM conversations")
def s01(spark: SparkSession, sf: str) -> DataFrame:
    path = IO.shared_path(spark, "conversations")
    IO.write_conversations(turns(spark, sf), path)
    return IO.read_conversations(spark, path).select("conv_id", "turn", "role", F.md5("text").alias("text"))


_SPLIT = "CASE WHEN ('0x'||substr(md5(doc_id::VARCHAR||'|io'),1,8))::BIGINT % 100 < 80 THEN 'train' WHEN ('0x'||substr(md5(doc_id::VARCHAR||'|io'),1,8))::BIGINT % 100 < 90 THEN 'val' ELSE 'test' END"


def _splits(spark: SparkSession, sf: str) -> str:
    path = IO.shared_path(spark, "splits")
    IO.write_splits(table(spark, sf, "documents").select("doc_id", "lang", "text", S.hashed_split("doc_id", "io").alias("split")), path)
    return path


@query("s02_read_one_split", f"SELECT doc_id, lang FROM documents WHERE {_SPLIT}='val'")
def s02(spark, sf):
    return IO.read_splits(spark, _splits(spark, sf), "doc_id long, lang string, text string", "val").select("doc_id", "lang")


@query("k01_written_splits", f"SELECT {_SPLIT} AS split, count(*) AS n, count(DISTINCT md5(text)) AS n_texts FROM documents GROUP BY 1")
def k01(spark, sf):
    rows = IO.read_splits(spark, _splits(spark, sf), "doc_id long, lang string, text string")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct(F.md5("text")).alias("n_texts"))


_RAW = ["3", "", "None", "1.0", " 2 "]


@query("s04_annotation_scores", f"SELECT {_ID} AS id, CASE {_pick(_ID, 'raw', 5)} WHEN 0 THEN 3 WHEN 4 THEN 2 END::INT AS quantity_score FROM conversations")
def s04(spark, sf):
    """Scores as people type them: an integer is a score, all else is none."""
    blank = F.lit("")
    rows = turns(spark, sf).select(
        id_().cast("string").alias("annotation_id"), blank.alias("violation_type"), blank.alias("context"), blank.alias("evidence"), F.col("text").alias("response"),
        _of(_RAW, T.pick(id_(), "raw", 5)).alias("quantity_score"), *(blank.alias(c) for c in ("quality_score", "relation_score", "manner_score", "annotator_notes")),
    )
    path = IO.shared_path(spark, "scores")
    rows.write.option("header", True).options(**IO.AS_IS).csv(path)
    return IO.read_annotations(spark, path).select(F.col("annotation_id").cast("long").alias("id"), "quantity_score")


@query("k02_annotation_sheet", f"WITH {SQL_EXAMPLES} SELECT {_ID} AS id, md5(substr(context_text,1,500)) AS context, md5(substr(coalesce(evidence,''),1,300)) AS evidence, md5(substr(response,1,500)) AS response, true AS unscored FROM ex")
def k02(spark, sf):
    rows = examples(spark, sf).select(id_().cast("string").alias("annotation_id"), F.lit("none").alias("violation_type"), F.col("context_text").alias("context"), "evidence", "response")
    path = IO.shared_path(spark, "sheet")
    IO.write_annotations(rows, path)
    back = IO.read_annotations(spark, path)
    md5 = lambda c: F.md5(F.coalesce(c, F.lit(""))).alias(c)
    none = F.coalesce("quantity_score", "quality_score", "relation_score", "manner_score").isNull()
    return back.select(F.col("annotation_id").cast("long").alias("id"), md5("context"), md5("evidence"), md5("response"), none.alias("unscored"))


@query("s05_annotation_folder", f"WITH {SQL_RATINGS} SELECT annotator, count(*) AS n, count(rating) AS n_rated, sum(rating)::BIGINT AS total FROM ra GROUP BY annotator")
def s05(spark, sf):
    """A folder of files, a folder a person, with a file that cannot be read."""
    path = IO.shared_path(spark, "ratings")
    ratings(spark, sf).withColumn("person", F.col("annotator")).write.partitionBy("person").json(path)
    spark.createDataFrame([("{broken",)], "value string").coalesce(1).write.text(f"{path}/broken")
    rows = IO.read_folder(spark, path, "id long, annotator string, rating long")
    return rows.groupBy("annotator").agg(F.count("*").alias("n"), F.count("rating").alias("n_rated"), F.sum("rating").alias("total"))


@query("s06_first_existing", "SELECT count(*) AS n FROM documents")
def s06(spark, sf):
    return IO.first_existing(spark, [f"{sf}/no_such_table.parquet", f"{sf}/documents.parquet", f"{sf}/pages.parquet"]).agg(F.count("*").alias("n"))


@query("s08_maxim_map", " UNION ALL ".join(f"SELECT conv_id, '{m}' AS source_maxim, md5(text) AS item FROM conversations WHERE {_pick(_ID, 'kind', 6)} IN ({k + 1})" for k, m in enumerate(MAXIMS)))
def s08(spark, sf):
    rows = turns(spark, sf).select("conv_id", "text", _of(KINDS, T.pick(id_(), "kind", 6)).alias("maxim")).where(F.col("maxim").isin(*MAXIMS))
    lists = rows.groupBy("conv_id", "maxim").agg(F.collect_list("text").alias("texts")).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("maxim", "texts"))).alias("groups"))
    return IO.explode_by_maxim(lists, "groups").select("conv_id", "source_maxim", F.md5("item").alias("item"))


@query("s09_clean_examples", f"WITH {SQL_VIOLATED} SELECT id FROM vi WHERE maxim NOT IN ('quantity','quality','relation','manner') AND NOT (maxim='multiple' AND (contains(violation_type,'quantity') OR contains(violation_type,'quality') OR contains(violation_type,'relation') OR contains(violation_type,'manner'))) ORDER BY md5(id::VARCHAR||'|clean'), id LIMIT 200")
def s09(spark, sf):
    """The first 200, in hashed order, of the rows without a label; the limit is the feature."""
    labels = sum(P.extract_labels(F.col("maxim"), F.col("violation_type")).values(), F.lit(0))
    return violated(spark, sf).where(labels == 0).orderBy(S.order_key("id", "clean"), "id").limit(200).select("id")


@query("k03_pairs_csv", f"WITH {SQL_PAIRS} SELECT {_M}, md5(chosen) AS chosen FROM pr")
def k03(spark, sf):
    path = IO.shared_path(spark, "pairs")
    columns = ["id", "chosen", *_M.split(", ")[1:]]
    IO.write_pairs(preference_pairs(spark, sf), path, columns)
    shape = ", ".join(f"{c} {'long' if c == 'id' else 'string' if c == 'chosen' else 'double'}" for c in columns)
    return spark.read.schema(shape).option("header", True).option("multiLine", True).option("escape", '"').csv(path).withColumn("chosen", F.md5("chosen"))


@query("k04_index_table", "SELECT vec_id, len(embedding)::INT AS size, 1.0::DOUBLE AS norm FROM embeddings")
def k04(spark, sf):
    """The index of a retrieval, written once and read by later sessions."""
    path = IO.shared_path(spark, "index")
    table(spark, sf, "embeddings").select("vec_id", R.normalised(F.col("embedding")).alias("v")).write.parquet(path)
    return spark.read.parquet(path).select("vec_id", F.size("v").alias("size"), F.round(F.sqrt(T.dot(F.col("v"), F.col("v"))), 6).alias("norm"))


@query("k05_blinded_files", "SELECT id, row_number() OVER (ORDER BY md5(id::VARCHAR||'|blind'), id)-1 AS sample_id, system FROM (SELECT conv_id*1000+turn AS id, CASE WHEN turn%2=0 THEN 'base' ELSE 'tuned' END AS system FROM conversations WHERE role='assistant')")
def k05(spark, sf):
    """What raters see and the key are written apart, and joined again."""
    rows = turns(spark, sf).where("role = 'assistant'").select(id_().alias("id"), F.when(F.col("turn") % 2 == 0, "base").otherwise("tuned").alias("system"), "text")
    blind = S.ranked(rows, [], "id", "blind").withColumn("sample_id", F.col("_k") - 1).drop("_k", "_n")
    sample, hidden = IO.shared_path(spark, "sample"), IO.shared_path(spark, "key")
    IO.write_blinded(blind, ["id", "system"], sample, hidden)
    seen = spark.read.schema("sample_id long, text string").json(sample)
    return spark.read.schema("sample_id long, id long, system string").json(hidden).join(seen.select("sample_id"), "sample_id").select("id", "sample_id", "system")


_LE = [10, 25, 50, 75, 100]


@query("k07_counters", "SELECT event_type, count(*) AS requests, " + ", ".join(f"count(*) FILTER (value<={b}) AS le_{b}" for b in _LE) + ", round(sum(value),4) AS total FROM events GROUP BY event_type")
def k07(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("requests"), *(F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in _LE), F.round(F.sum("value"), 4).alias("total"))


# ---- inputs, audits and samples --------------------------------------------------------------------------------

_INPUT = "'[CONTEXT] '||substr(context_text,1,1024)||' [EVIDENCE] '||substr(coalesce(evidence,''),1,512)||' [RESPONSE] '||substr(response,1,512)"
_PART = lambda p: f"regexp_replace(regexp_extract(t,'{p}',1),'^\\s+|\\s+$','','g')"


@query(
    "p08_preference_dataset",
    f"WITH {SQL_EXAMPLES}, i AS (SELECT {_ID} AS id, turn, response, CASE WHEN turn%2=0 THEN {_INPUT} ELSE replace({_INPUT}, substr(coalesce(evidence,''),1,512)||' [RESPONSE]', ' [RESPONSE]') END AS t FROM ex), "
    f"c AS (SELECT id, response AS target, {_PART(r'(?s)\[CONTEXT\](.*?)\[EVIDENCE\]')} AS c, {_PART(r'(?s)\[EVIDENCE\](.*?)\[RESPONSE\]')} AS e, {_PART(r'(?s)\[RESPONSE\](.*)$')} AS r FROM i), "
    "k AS (SELECT *, row_number() OVER (ORDER BY id) AS k, count(*) OVER () AS n FROM c WHERE c<>'' AND r<>'') "
    "SELECT id, md5('Context: '||c||CASE WHEN e<>'' THEN chr(10)||'Evidence: '||e ELSE '' END||chr(10)||chr(10)||'Generate a cooperative response:') AS prompt, md5(target) AS chosen, md5(r) AS rejected, CASE WHEN k<=floor(n*0.9) THEN 'train' ELSE 'val' END AS split FROM k",
)
def p08(spark, sf):
    """From repair inputs and their targets to prompts (with evidence where there is any), chosen and rejected texts."""
    part = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    whole = E.format_input()
    less = F.replace(whole, F.concat(part("evidence", 512), F.lit(" [RESPONSE]")), F.lit(" [RESPONSE]"))
    i = examples(spark, sf).select(id_().alias("id"), F.col("response").alias("target"), F.when(F.col("turn") % 2 == 0, whole).otherwise(less).alias("t"))
    c = i.select("id", "target", *(x.alias(n) for n, x in E.extract_components(F.col("t")).items())).where((F.col("context") != "") & (F.col("response") != ""))
    k = S.placed(c, [], F.col("id"), "id")
    split = F.when(F.col("_k") <= F.floor(F.col("_n") * 0.9), "train").otherwise("val")
    return k.select("id", F.md5(P.prompt(F.col("context"), F.col("evidence"))).alias("prompt"), F.md5("target").alias("chosen"), F.md5("response").alias("rejected"), split.alias("split"))


_CHECKS = [("relation rows", 200), ("gold labels", 500), ("corpus rows", 10_000)]


@query(
    "p25_audit",
    f"WITH {SQL_VIOLATED}, c AS (SELECT 'relation rows' AS name, count(*) AS found, 200 AS needed FROM vi WHERE maxim='relation' UNION ALL SELECT 'gold labels', count(*), 500 FROM labels UNION ALL SELECT 'corpus rows', count(*), 10000 FROM documents), "
    "f AS (SELECT length(text) AS n FROM documents ORDER BY doc_id LIMIT 1000) SELECT name, found, needed, found>=needed AS enough, (SELECT round(avg(n),6) FROM f) AS mean_chars, (SELECT max(n)::BIGINT FROM f) AS most_chars FROM c",
)
def p25(spark, sf):
    """Sizes against what is needed, and lengths of the first 1000 texts (the audit's own sample)."""
    docs = table(spark, sf, "documents")
    counted = [violated(spark, sf).where("maxim = 'relation'"), table(spark, sf, "labels"), docs]
    rows = [r.agg(F.count("*").alias("found")).select(F.lit(n).alias("name"), "found", F.lit(need).alias("needed")) for r, (n, need) in zip(counted, _CHECKS)]
    first = docs.orderBy("doc_id").limit(1000).select(F.length("text").alias("n")).agg(F.round(F.avg("n"), 6).alias("mean_chars"), F.max("n").cast("long").alias("most_chars"))
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.withColumn("enough", F.col("found") >= F.col("needed")).crossJoin(F.broadcast(first))  # one row


@query("p26_required_keys", "SELECT count(*) AS n FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
def p26(spark, sf):
    return IO.require_columns(table(spark, sf, "labels"), ["doc_id", "quality", "toxic"]).agg(F.count("*").alias("n"))


@query("t05_row_split", f"WITH r AS (SELECT {_ID} AS id, row_number() OVER (ORDER BY md5(({_ID})::VARCHAR||'|rows'), {_ID}) AS k, count(*) OVER () AS n FROM conversations) SELECT id, CASE WHEN k<=floor(n*0.7) THEN 'train' WHEN k<=floor(n*0.7)+floor(n*0.15) THEN 'val' ELSE 'test' END AS split FROM r")
def t05(spark, sf):
    return S.stratified_split(turns(spark, sf).select(id_().alias("id")), [], "id", "rows", 0.7, 0.15).select("id", "split")


@query("t19_corpus_sample", "SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR||'|corpus'), doc_id LIMIT 10000")
def t19(spark, sf):
    """10,000 rows in hashed order, or all; the sample is the feature."""
    return table(spark, sf, "documents").select("doc_id").orderBy(S.order_key("doc_id", "corpus"), "doc_id").limit(10_000)


_BIG = "list_filter(list_transform(list_filter(regexp_extract_all(text,'\\S+'), lambda x: length(x)>1 AND regexp_matches(x,'^\\p{Lu}')), lambda x: regexp_replace(x,'[^\\p{L}\\p{M}\\p{N}_]','','g')), lambda x: x<>'')"


@query("x06_named_entities", f"SELECT conv_id, turn, len({_BIG}) AS n, md5(array_to_string({_BIG},' ')) AS names FROM conversations")
def x06(spark, sf):
    names = T.named_entities(F.col("text"))
    return turns(spark, sf).select("conv_id", "turn", F.size(names).alias("n"), F.md5(F.array_join(names, " ")).alias("names"))


@query("x24_prompts", f"WITH {SQL_EXAMPLES} SELECT {_ID} AS id, md5('Continue the following conversation naturally, following Gricean maxims (be relevant, truthful, clear, appropriately informative):'||chr(10)||chr(10)||context_text||chr(10)||chr(10)||'Response:') AS prompt FROM ex")
def x24(spark, sf):
    return examples(spark, sf).select(id_().alias("id"), F.md5(P.continuation_prompt(F.col("context_text"))).alias("prompt"))


@query("x25_rounding", "SELECT event_id, round(floor(value)/8,2)::DOUBLE AS half_up, round_even(floor(value)/8,2)::DOUBLE AS half_even FROM events")
def x25(spark, sf):
    v = F.floor("value") / F.lit(8.0)
    return table(spark, sf, "events").select("event_id", F.round(v, 2).alias("half_up"), F.bround(v, 2).alias("half_even"))


@query("m01_maps_and_json", f"WITH {SQL_SCORES} SELECT id, '{{' || string_agg('\"'||maxim||'\":'||(p_base*1000)::INT::VARCHAR, ',' ORDER BY maxim) || '}}' AS scores, max(CASE WHEN maxim='manner' THEN (p_base*1000)::INT END) AS manner FROM sc GROUP BY id")
def m01(spark, sf):
    entries = F.sort_array(F.collect_list(F.struct("maxim", F.round(F.col("p_base") * 1000).cast("int").alias("p"))))
    rows = scores(spark, sf).groupBy("id").agg(F.map_from_entries(entries).alias("m")).select("id", F.to_json("m").alias("scores"))
    return rows.select("id", "scores", F.element_at(F.from_json("scores", "map<string,int>"), "manner").alias("manner"))


# ---- reports ---------------------------------------------------------------------------------------------------

_PAIRED = "rp AS (SELECT x.annotator AS first, y.annotator AS second, x.rating AS a, y.rating AS b FROM ra x JOIN ra y ON x.id=y.id AND x.annotator<y.annotator AND x.rating IS NOT NULL AND y.rating IS NOT NULL)"


def _sql_kappa(source: str, keys: str) -> str:
    on = " AND ".join(f"r.{k}=c.{k}" for k in keys.split(", "))
    return f"""kc AS (SELECT {keys}, count(*) AS n, sum(CASE WHEN a=b THEN 1 ELSE 0 END) AS same FROM {source} GROUP BY {keys}), ka AS (SELECT {keys}, a AS c, count(*) AS x FROM {source} GROUP BY ALL), kb AS (SELECT {keys}, b AS c, count(*) AS x FROM {source} GROUP BY ALL),
 ke AS (SELECT {', '.join('r.' + k for k in keys.split(', '))}, sum(r.x*c.x) AS xy FROM ka r JOIN kb c ON {on} AND r.c=c.c GROUP BY ALL),
 kk AS (SELECT {keys}, n, same/n AS po, coalesce(xy,0)/(n*n) AS pe FROM kc LEFT JOIN ke USING ({keys})), kr AS (SELECT {keys}, n, round(po,6) AS agreement, round(CASE WHEN pe=1 THEN (CASE WHEN po=1 THEN 1 ELSE 0 END) ELSE (po-pe)/(1-pe) END,6)::DOUBLE AS kappa FROM kk)"""


@query("a07_kappa_classes", f"WITH {SQL_RATINGS}, {_PAIRED}, {_sql_kappa('rp', 'first, second')} SELECT * FROM kr")
def a07(spark, sf):
    return G.kappa(G.annotator_pairs(ratings(spark, sf), "id", "annotator", "rating"), ["first", "second"])


def _sql_band(c: str, limits: list, below: str) -> str:
    return "CASE " + " ".join(f"WHEN {c}>={x} THEN '{n}'" for x, n in limits) + f" ELSE '{below}' END"


AGREEMENT = [(0.8, "almost perfect"), (0.6, "substantial"), (0.4, "moderate")]
VERDICT = [(0.8, "excellent"), (0.7, "good"), (0.5, "moderate")]
_POOLED = "po AS (SELECT id, maxim, y, p_base, p_tuned FROM sc UNION ALL SELECT id, 'overall', y, p_base, p_tuned FROM sc)"


@query("a09_agreement_report", f"WITH {SQL_SCORES}, {_POOLED}, jj AS (SELECT maxim, (p_base>0.4)::INT + (p_base>0.8)::INT AS a, (p_base>0.5)::INT + (p_base>0.8)::INT AS b FROM po), {_sql_kappa('jj', 'maxim')} SELECT maxim, n, round(agreement,3) AS agreement, round(kappa,3) AS kappa, {_sql_band('kappa', AGREEMENT, 'poor')} AS band FROM kr")
def a09(spark, sf):
    """Two raters on three grades, by maxim and over all of them."""
    level = lambda low: (F.col("p_base") > low).cast("int") + (F.col("p_base") > 0.8).cast("int")
    k = G.kappa(A.with_pooled(scores(spark, sf)).select("maxim", level(0.4).alias("a"), level(0.5).alias("b")), ["maxim"])
    return k.select("maxim", "n", F.round("agreement", 3).alias("agreement"), F.round("kappa", 3).alias("kappa"), G.band(F.col("kappa"), AGREEMENT, "poor").alias("band"))


@query("a10_detector_agreement", f"WITH {SQL_SCORES}, {_POOLED}, cm AS (SELECT maxim, {_CM} FROM po GROUP BY maxim), ml AS ({_ML}) SELECT *, {_sql_band('kappa', VERDICT, 'poor')} AS verdict FROM ml")
def a10d(spark, sf):
    m = A.multilabel(A.with_pooled(scores(spark, sf)), F.col("y") == 1, F.col("p_base") > 0.5)
    return m.withColumn("verdict", G.band(F.col("kappa"), VERDICT, "poor"))


@query("a11_macro_means", f"WITH {SQL_SCORES}, cm AS (SELECT maxim, {_CM} FROM sc GROUP BY maxim), ml AS ({_ML}), o AS (SELECT id, bool_and((y=1)=(p_base>0.5)) AS x, bool_or((y=1)=(p_base>0.5)) AS p FROM sc GROUP BY id), e AS (SELECT count(*) AS n, round(avg(CASE WHEN x THEN 1.0 ELSE 0.0 END),6) AS exact, round(avg(CASE WHEN p THEN 1.0 ELSE 0.0 END),6) AS partial FROM o) SELECT n, exact, partial, (SELECT round(avg(precision),6) FROM ml) AS precision, (SELECT round(avg(recall),6) FROM ml) AS recall, (SELECT round(avg(f1),6) FROM ml) AS f1, (SELECT sum(tp+fn)::BIGINT FROM ml) AS support FROM e")
def a11(spark, sf):
    s, truth, guess = scores(spark, sf), F.col("y") == 1, F.col("p_base") > 0.5
    means = A.multilabel(s, truth, guess).agg(*(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")), F.sum(F.col("tp") + F.col("fn")).alias("support"))
    return A.match_rates(s, truth, guess).crossJoin(F.broadcast(means))  # one row


@query("a11_support", f"WITH {SQL_SCORES} SELECT maxim, sum(y)::BIGINT AS support FROM sc GROUP BY maxim")
def a11s(spark, sf):
    return scores(spark, sf).groupBy("maxim").agg(F.sum("y").alias("support"))


_RATES = lambda grid: f"sw AS (SELECT maxim, t::INT AS t, round(avg(CASE WHEN p_base>t/100 THEN 1.0 ELSE 0.0 END),6) AS b, round(avg(CASE WHEN p_tuned>t/100 THEN 1.0 ELSE 0.0 END),6) AS d FROM sc, unnest({grid}) AS g(t) GROUP BY maxim, t)"


@query("a22_sweep_winner", f"WITH {SQL_SCORES}, {_RATES('[45,50,55,60,65,70]')}, i AS (SELECT t, count(*) FILTER (b>d) AS improved FROM sw GROUP BY t), c AS (SELECT t::INT AS t, round(1-avg(v),6) AS cooperative FROM (SELECT id, t, max(CASE WHEN p_tuned>t/100 THEN 1 ELSE 0 END) AS v FROM sc, unnest([45,50,55,60,65,70]) AS g(t) GROUP BY id, t) GROUP BY t) SELECT t, improved, cooperative FROM i JOIN c USING (t) ORDER BY improved DESC, cooperative DESC, t LIMIT 1")
def a22w(spark, sf):
    return A.sweep_winner(scores(spark, sf), [45, 50, 55, 60, 65, 70])


@query("a23_optimal_thresholds", f"WITH {SQL_SCORES}, {_RATES('range(40,80)')}, g AS (SELECT maxim, t, CASE WHEN b>0 AND d>0.1 AND d<0.8 THEN round((b-d)/b,6) END AS gain FROM sw), r AS (SELECT *, row_number() OVER (PARTITION BY maxim ORDER BY gain DESC NULLS LAST, t) AS r FROM g) SELECT maxim, CASE WHEN gain IS NULL THEN 50 ELSE t END AS t, gain::DOUBLE AS improvement FROM r WHERE r=1")
def a23(spark, sf):
    return A.optimal_thresholds(scores(spark, sf), list(range(40, 80)))


@query("a29_health", f"WITH {SQL_SCORES} SELECT maxim, avg(CASE WHEN p_base>=0.3 AND p_base<0.7 THEN 1.0 ELSE 0.0 END)>0.7 AS middle, avg(CASE WHEN p_base<0.1 OR p_base>=0.9 THEN 1.0 ELSE 0.0 END)>0.8 AS extreme, var_pop(p_base)<0.01 AS flat FROM sc GROUP BY maxim")
def a29h(spark, sf):
    p = F.col("p_base")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return scores(spark, sf).groupBy("maxim").agg((share((p >= 0.3) & (p < 0.7)) > 0.7).alias("middle"), (share((p < 0.1) | (p >= 0.9)) > 0.8).alias("extreme"), (F.var_pop(p) < 0.01).alias("flat"))


_TARGET = _sql_of(MAXIMS, _pick("id", "target", 4))
_BEST = "CASE greatest(m_quantity,m_quality,m_relation,m_manner) WHEN m_quantity THEN 'quantity' WHEN m_quality THEN 'quality' WHEN m_relation THEN 'relation' ELSE 'manner' END"


@query("a30_match_matrix", f"WITH {SQL_PAIRS}, t AS (SELECT {_TARGET} AS target, {_BEST} AS best FROM pr) SELECT target, best, count(*) AS n, target=best AS matches FROM t GROUP BY target, best")
def a30m(spark, sf):
    """The maxim a pair was made for against the one of its greatest margin."""
    t = preference_pairs(spark, sf).select(_of(MAXIMS, T.pick(F.col("id"), "target", 4)).alias("target"), P.best_maxim().alias("best"))
    return t.groupBy("target", "best").agg(F.count("*").alias("n")).withColumn("matches", F.col("target") == F.col("best"))


@query("a33_independence", f"WITH {SQL_SCORES}, h AS (SELECT id, maxim, count(*) OVER (PARTITION BY id) AS k FROM sc WHERE p_base>0.5) SELECT maxim, count(*) AS total, count(*) FILTER (k=1) AS solo, round(count(*) FILTER (k=1)/count(*),6) AS independence FROM h GROUP BY maxim")
def a33i(spark, sf):
    return A.independence(scores(spark, sf))


_VOTE_COLUMNS = {"length_ratio": "lr", "redundancy": "rd", "info_density": "id", "evidence_coverage": "ec", "entity_consistency": "en", "keyword_overlap": "ko", "ambiguous_pronouns": "ap", "sentence_complexity": "sc"}


@query("h13_all_votes", f"WITH {SQL_VOTES}, a AS (" + " UNION ALL ".join(f"SELECT conv_id, turn, '{n}' AS name, round({c},6)::DOUBLE AS score FROM vo WHERE {c} IS NOT NULL AND evidence IS NOT NULL" for n, c in _VOTE_COLUMNS.items()) + ") SELECT name, count(*) AS n, round(sum(score),4) AS total, count(*) FILTER (score IS NULL) AS n_failed FROM a GROUP BY name")
def h13(spark, sf):
    """Every vote of the examples with evidence; a vote that has no score would be counted as failed, not dropped."""
    own, r, c, e = H.prepare(examples(spark, sf).where("evidence is not null"))
    votes = [H.REGISTRY[n](r, c, e) for n in _VOTE_COLUMNS]
    rows = own.select(F.explode(F.array_compact(F.array(*votes))).alias("v")).select("v.name", F.round("v.score", 6).alias("score"))
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"), F.count_if(F.col("score").isNull()).alias("n_failed"))


# ---- what models give and take ---------------------------------------------------------------------------------


@query("n01_detector_output", f"WITH {SQL_SCORES} SELECT id, coalesce(string_agg(CASE WHEN p_base>0.5 THEN maxim END, ',' ORDER BY maxim),'') AS violations, count(*) FILTER (p_base>0.5)=0 AS cooperative FROM sc GROUP BY id")
def n01(spark, sf):
    hit = F.array_compact(F.collect_list(F.when(F.col("p_base") > 0.5, F.col("maxim"))))
    return scores(spark, sf).groupBy("id").agg(F.array_join(F.array_sort(hit), ",").alias("violations"), (F.count_if(F.col("p_base") > 0.5) == 0).alias("cooperative"))


@query("n02_calibrated", f"WITH {SQL_SCORES} SELECT id, maxim, round(1/(1+exp(-ln(greatest(p_base,1e-6)/greatest(1-p_base,1e-6))/1.5)),6) AS p, 1/(1+exp(-ln(greatest(p_base,1e-6)/greatest(1-p_base,1e-6))/1.5))>0.6 AS flagged FROM sc")
def n02(spark, sf):
    p = A.calibrated(F.col("p_base"), F.lit(1.5))
    return scores(spark, sf).select("id", "maxim", F.round(p, 6).alias("p"), (p > 0.6).alias("flagged"))


@query("n05_retrieve_or_keep", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v),6) AS score FROM e q, e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) SELECT query_id, CASE WHEN score>=0.7 THEN vec_id ELSE query_id END AS answer_id, score>=0.7 AS retrieved FROM r WHERE r=1")
def n05(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    q = e.where("vec_id % 50 = 0")
    return R.retrieve_or_keep(R.top_k(q, e, 1), q, 0.7)


_LOGIT = f"0.1*(({_sql_u('id', 'pc')}-{_sql_u('id', 'pr')})-({_sql_u('id', 'fc')}-{_sql_u('id', 'fr')}))*100"
_WEIGHTS = {"quantity": 1.0, "quality": 1.0, "relation": 1.5, "manner": 0.5}


@query("n06_preference_loss", f"WITH {SQL_PAIRS}, l AS (SELECT *, {_LOGIT} AS x FROM pr) SELECT id, round((" + "+".join(f"{w}*greatest(m_{m},0.01)" for m, w in _WEIGHTS.items()) + f")*(greatest(-x,0)+ln(1+exp(-abs(x))))/{sum(_WEIGHTS.values())},6) AS loss FROM l")
def n06(spark, sf):
    key = F.col("id")
    logit = 0.1 * ((_u(key, "pc") - _u(key, "pr")) - (_u(key, "fc") - _u(key, "fr"))) * 100
    return preference_pairs(spark, sf).select("id", F.round(A.preference_loss(logit, {m: F.col(f"m_{m}") for m in _WEIGHTS}, _WEIGHTS), 6).alias("loss"))


@query("n07_focal_loss", f"WITH {SQL_SCORES}, t AS (SELECT maxim, greatest(CASE WHEN y=1 THEN p_base ELSE 1-p_base END,1e-6) AS pt FROM sc) SELECT maxim, round(avg(0.25*pow(1-pt,2)*-ln(pt)),6) AS loss FROM t GROUP BY maxim")
def n07(spark, sf):
    return scores(spark, sf).groupBy("maxim").agg(F.round(F.avg(A.focal_loss(F.col("p_base"), F.col("y"))), 6).alias("loss"))


@query("n08_length_guard", f"SELECT id, coalesce(len(regexp_extract_all(rejected,'\\S+'))/nullif(len(regexp_extract_all(chosen,'\\S+')),0) BETWEEN 0.6 AND 1.4, false) AS kept FROM ({_NEXT}) WHERE rejected IS NOT NULL")
def n08(spark, sf):
    return preference_pairs(spark, sf).select("id", P.length_guard(F.col("chosen"), F.col("rejected")).alias("kept"))


# ---- batches of made violations --------------------------------------------------------------------------------

def batch(rows: DataFrame, per_maxim: int, strategies: dict[str, dict[str, Column]], salt: str) -> DataFrame:
    """rows (id, text): of each maxim a violation of the first per_maxim texts of 20 characters or more, by one strategy
    each, with a 0/1 label a maxim; and the texts of the first per_maxim // 2 rows as they are, but empty ones.

    First is by hashed order, the same for all maxims, so a batch does not depend on how rows lie.
    """
    order = (S.order_key("id", salt), F.col("id"))
    first = rows.where(F.length("text") >= 20).orderBy(*order).limit(per_maxim)
    made = []
    for maxim, own in strategies.items():
        chosen = K.choose(F.col("id"), f"strategy_{maxim}", list(own))
        text = F.coalesce(*[F.when(chosen == n, F.coalesce(c, F.col("text"))) for n, c in own.items()])
        made.append(F.struct(F.lit(maxim).alias("maxim"), chosen.alias("strategy"), text.alias("violated")))
    violated = first.select("id", F.explode(F.array(*made)).alias("m")).select("id", "m.*")
    clean = rows.orderBy(*order).limit(per_maxim // 2).where("text <> ''").select("id", F.lit("clean").alias("maxim"), F.lit("clean").alias("strategy"), F.col("text").alias("violated"))
    return violated.unionByName(clean).select("*", *(F.when(F.col("maxim") == m, 1).otherwise(0).alias(m) for m in MAXIMS))


#: Violations a maxim.
PER_MAXIM = 1000
_ORDERED = "ORDER BY md5(id::VARCHAR||'|batch'), id LIMIT"
_BATCH = f"b AS (SELECT conv_id, turn, {_ID} AS id, text FROM conversations), fb AS (SELECT * FROM b WHERE length(text)>=20 {_ORDERED} {PER_MAXIM}), cb AS (SELECT * FROM (SELECT * FROM b {_ORDERED} {PER_MAXIM // 2}) WHERE text<>'')"
_KINDS = ", ".join(f"(maxim='{m}')::INT AS {m}" for m in MAXIMS)
_MAXIMS = "[" + ", ".join(f"'{m}'" for m in MAXIMS) + "]"


def _strategies() -> dict[str, dict[str, Column]]:
    made = K.realistic_text(F.col("id"), F.col("text")) | K.realistic_words(F.col("id"), F.col("text"))
    return {m: {n: c for n, c in made.items() if n.startswith(m)} for m in MAXIMS}


@query("i17_batch", f"WITH {_BATCH}, r AS (SELECT id, unnest({_MAXIMS}) AS maxim FROM fb UNION ALL SELECT id, 'clean' FROM cb) SELECT id, maxim, {_KINDS} FROM r")
def i17c(spark, sf):
    """The quotas and the labels of a batch; what the strategies make is in i17_batch_texts."""
    return batch(turns(spark, sf).select(id_().alias("id"), "text"), PER_MAXIM, _strategies(), "batch").select("id", "maxim", *MAXIMS)


_BATCH_TEXTS = " UNION ALL ".join(f"SELECT id, '{m}' AS maxim, m_{m} AS strategy, md5({sql_by_strategy(m)}) AS violated FROM st" for m in MAXIMS)


@query("i17_batch_texts", f"WITH {_BATCH}, {sql_realistic('fb')} {_BATCH_TEXTS} UNION ALL SELECT id, 'clean', 'clean', md5(text) FROM cb")
def i17t(spark, sf):
    return batch(turns(spark, sf).select(id_().alias("id"), "text"), PER_MAXIM, _strategies(), "batch").select("id", "maxim", "strategy", F.md5("violated").alias("violated"))


_AFTER_MANNER = f"ma AS (SELECT conv_id, turn, id, {Q.FIRST_MANNER} AS text, context FROM si WHERE {Q.FIRST_MANNER} IS NOT NULL)"


@query("i11_multiple_relation", f"WITH {SQL_MAKER_INPUT}, {Q.singles('xm', 'si')}, {_AFTER_MANNER}, {Q.singles('ma', 'mr')} SELECT conv_id, turn, coalesce(relation_off_topic, relation_drift) AS violated FROM mr WHERE coalesce(relation_off_topic, relation_drift) IS NOT NULL")
def i11r(spark, sf):
    """Two violations in one text, one of them of relation."""
    made = K.multiple(_id(), F.col("response"), ["manner", "relation"], F.col("context_text"))
    return examples(spark, sf).select("conv_id", "turn", made.alias("violated")).where("violated is not null")


# ---- streams ---------------------------------------------------------------------------------------------------


@query("w01_stream_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def w01(spark, sf):
    """An extension: the events as a stream of files, counted by day and type as they come."""
    return event_counts(spark, f"{sf}/events.parque[t]")
