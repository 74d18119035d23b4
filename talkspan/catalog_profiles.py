"""Queries of exploration profiles, whole detector results, directions of pairs and comparisons before and after."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import MAXIMS, SQL_PAIRS, SQL_SCORES, _grams, preference_pairs, query, scores, sql_degenerate, turns
from .catalog_evaluation import SQL_VIOLATED, violated
from .functions import text as T
from .functions import topics
from .operators import examples as E
from .operators import metrics as A
from .operators import profile as R
from .sources import reports as O
from .sources.tables import shared_path, table

_WORDS = "regexp_extract_all(lower(text),'\\S+')"


@query("a01_vocabulary", f"SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS}) AS word FROM conversations) GROUP BY word ORDER BY n DESC, word LIMIT 20")
def a01v(spark, sf):
    """The twenty most frequent words."""
    return R.top_words(turns(spark, sf).select(F.explode(T.words(F.lower("text"))).alias("word")))


@query(
    "a01_overview",
    f"""WITH t AS (SELECT conv_id, {_WORDS} AS w, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), n AS (SELECT conv_id, len(w) AS n, coalesce(k<>'',false) AS used FROM t), c AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
 m AS (SELECT count(*) AS n_messages, avg(n) AS mean, quantile_cont(n,0.5) AS median, stddev_samp(n) AS std, min(n) AS least, max(n) AS most, sum(n)::BIGINT AS n_tokens, count(*) FILTER (used) AS with_knowledge, avg(used::INT) AS knowledge_rate, list_sort(list(n)) AS s FROM n)
 SELECT n_conversations, n_messages, round(mean,6) AS mean, median, round(std,6) AS std, least, most, mean_turns, median_turns, least_turns, most_turns, n_words, n_tokens, with_knowledge, round(knowledge_rate,6) AS knowledge_rate, round(mean-1.5*std,6) AS too_short, round(mean+2*std,6) AS too_long, s[n_messages*10//100+1] AS p10, s[n_messages*95//100+1] AS p95
 FROM m, (SELECT count(*) AS n_conversations, round(avg(n),6) AS mean_turns, quantile_cont(n,0.5) AS median_turns, min(n) AS least_turns, max(n) AS most_turns FROM c), (SELECT count(DISTINCT x) AS n_words FROM (SELECT unnest(w) AS x FROM t))""",
)
def a01o(spark, sf):
    """One row about all messages; the turn before one is its knowledge."""
    rows = E.extract_examples(turns(spark, sf), least_words=0).select("conv_id", F.col("response").alias("text"), "evidence")
    return R.overview(rows, "evidence")


_P = lambda m: f"max(CASE WHEN maxim='{m}' THEN p_base END)"


@query("n01_detector_result", f"WITH {SQL_SCORES} SELECT id, {', '.join(f'{_P(m)} AS {m}_prob, {_P(m)}>0.5 AS {m}_violated' for m in MAXIMS)}, max(p_base)>0.5 AS any_violation, max(p_base)<=0.5 AS cooperative FROM sc GROUP BY id")
def n01r(spark, sf):
    """All that the detector says of a response: probabilities, flags, any violation, cooperative."""
    p = lambda m: F.max(F.when(F.col("maxim") == m, F.col("p_base")))
    each = [c for m in MAXIMS for c in (p(m).alias(f"{m}_prob"), (p(m) > 0.5).alias(f"{m}_violated"))]
    return scores(spark, sf).groupBy("id").agg(*each, (F.max("p_base") > 0.5).alias("any_violation"), (F.max("p_base") <= 0.5).alias("cooperative"))


@query("a30_chosen_better", f"WITH {SQL_PAIRS}, f AS (SELECT * FROM pr ORDER BY id LIMIT 100) SELECT count(*) FILTER (avg_margin>0) AS better, count(*) FILTER (avg_margin<0) AS worse, count(*) FILTER (avg_margin=0) AS equal, count(*) FILTER (avg_margin<0) > count(*) FILTER (avg_margin>0) AS inverted FROM f")
def a30c(spark, sf):
    """Whether the chosen texts of the first 100 pairs violate less; the limit is the reference's."""
    m = F.col("avg_margin")
    count = [F.count_if(c).alias(n) for c, n in ((m > 0, "better"), (m < 0, "worse"), (m == 0, "equal"))]
    return preference_pairs(spark, sf).orderBy("id").limit(100).agg(*count).withColumn("inverted", F.col("worse") > F.col("better"))


_SIGNS = " UNION ALL ".join(f"SELECT '{m}' AS maxim, count(*) FILTER (m_{m}>0.05) AS positive, count(*) FILTER (m_{m}<-0.05) AS negative, count(*) FILTER (m_{m} BETWEEN -0.05 AND 0.05) AS near_zero FROM pr" for m in MAXIMS)


@query("a30_sign_buckets", f"WITH {SQL_PAIRS}, s AS ({_SIGNS}) SELECT *, round(positive/(positive+negative+near_zero),6) AS positive_share, negative>positive AS inverted FROM s")
def a30s(spark, sf):
    """Margins over 0.05, under -0.05 and between, by maxim."""
    x = F.col("x")
    rows = preference_pairs(spark, sf).select(F.explode(F.array(*(F.struct(F.lit(m).alias("maxim"), F.col(f"m_{m}").alias("x")) for m in MAXIMS))).alias("m")).select("m.*")
    by = rows.groupBy("maxim").agg(F.count_if(x > 0.05).alias("positive"), F.count_if(x < -0.05).alias("negative"), F.count_if(x.between(-0.05, 0.05)).alias("near_zero"))
    total = F.col("positive") + F.col("negative") + F.col("near_zero")
    return by.select("*", F.round(F.col("positive") / total, 6).alias("positive_share"), (F.col("negative") > F.col("positive")).alias("inverted"))


_W3 = ", ".join(f"regexp_extract_all({c},'\\S+') AS {c}_w" for c in ("b", "a", "o"))
_G3 = ", ".join(f"{_grams(c + '_w')} AS {c}_g" for c in ("b", "a", "o"))
_BAD = {c: sql_degenerate(c, f"{c}_w", f"{c}_g") for c in ("b", "a", "o")}


@query(
    "a38_before_after",
    f"WITH {SQL_VIOLATED}, x AS (SELECT maxim, text AS o, CASE WHEN id%5=0 THEN text||' !!!' ELSE text END AS b, CASE WHEN id%10=0 THEN text||' !!!' ELSE text END AS a FROM vi WHERE maxim<>'none'), w3 AS (SELECT *, {_W3} FROM x), g3 AS (SELECT *, {_G3} FROM w3), j AS (SELECT maxim, {_BAD['b']} AS b, {_BAD['a']} AS f, {_BAD['o']} AS o FROM g3), y AS (SELECT maxim, b, f, CASE WHEN f THEN o ELSE f END AS a FROM j), z AS (SELECT maxim, b, f, a FROM y UNION ALL SELECT 'all', b, f, a FROM y), "
    'c AS (SELECT maxim, count(*) AS n, count(*) FILTER (b) AS "before", count(*) FILTER (a) AS "after", count(*) FILTER (f) AS fallback FROM z GROUP BY maxim) '
    'SELECT *, round("before"/n,6) AS before_rate, round("after"/n,6) AS after_rate, round(fallback/n,6) AS fallback_rate, round("before"/n-"after"/n,6) AS improvement, round(100*("before"/n-"after"/n)/greatest("before"/n,1e-10),6) AS relative FROM c',
)
def a38b(spark, sf):
    """Degenerate repairs before and after a fallback; every fifth and every tenth text stand in for what a model makes."""
    rows = violated(spark, sf).where("maxim <> 'none'")
    made = lambda k: F.when(F.col("id") % k == 0, F.concat("text", F.lit(" !!!"))).otherwise(F.col("text"))
    return R.degeneracy_change(rows.select("maxim", "text", made(5).alias("b"), made(10).alias("a")), "b", "a", "text", "maxim")


_LONG = topics.with_forms()
_KEYWORDS = ", ".join(f"({k}, '{n}', '{w}')" for k, (n, ws) in enumerate(_LONG.items()) for w in ws)


@query(
    "x16_long_taxonomy",
    f"WITH k(o, topic, w) AS (VALUES {_KEYWORDS}), t AS (SELECT doc_id, lower(text) AS t, list_distinct(regexp_extract_all(lower(text),'[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS ws FROM documents), h AS (SELECT doc_id, o, topic, w, t, ws FROM t JOIN k ON contains(t, w)), "
    "s AS (SELECT doc_id, o, topic, sum(CASE WHEN list_contains(ws,w) THEN 10+(CASE WHEN length(w)>6 THEN 5 ELSE 0 END)+(CASE WHEN instr(t,w)-1<length(t)/2 THEN 3 ELSE 0 END) ELSE 5 END) AS s FROM h GROUP BY 1,2,3), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, o) AS r FROM s) "
    "SELECT t.doc_id, coalesce(r.topic, 'general') AS topic FROM t LEFT JOIN r ON r.doc_id=t.doc_id AND r.r=1",
)
def x16l(spark, sf):
    """Topics of all documents by some 400 keywords."""
    return topics.long_topics(table(spark, sf, "documents").select("doc_id", "text"), "text", _LONG).select("doc_id", "topic")


# ---- report files ----------------------------------------------------------------------------------------------


@query("k06_markdown_report", f"WITH {SQL_SCORES}, r AS (SELECT maxim, avg(CASE WHEN p_base>0.5 THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN p_tuned>0.5 THEN 1.0 ELSE 0.0 END) AS t FROM sc GROUP BY maxim) SELECT maxim, round(b,6) AS base_rate, round(t,6) AS tuned_rate, round(b-t,6) AS absolute, round(CASE WHEN b=0 THEN 0 ELSE (b-t)/b END,6) AS relative FROM r")
def k06(spark, sf):
    """The table of violation rates as a Markdown file, read back."""
    path = f"{shared_path(spark, 'report')}.md"
    O.write_report(A.rates(scores(spark, sf)).orderBy("maxim"), path, title="Violation rates")
    return O.read_markdown(spark, path, "maxim string, base_rate double, tuned_rate double, absolute double, relative double")


@query("k06_latex_report", "SELECT event_type||' & '||count(*)::VARCHAR||' \\\\' AS line FROM events GROUP BY event_type")
def k06l(spark, sf):
    """Counts of events as a LaTeX table: the lines of its body."""
    path = f"{shared_path(spark, 'report')}.tex"
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    O.write_report(counts, path, "latex", title="Events")
    return spark.read.text(path).where("value like '% & %' and value not like '%type & n%'").select(F.col("value").alias("line"))


@query("k07_metrics_file", f"WITH {SQL_SCORES} SELECT 'detections_total{{maxim=\"'||maxim||'\"}} '||(count(*) FILTER (p_base>0.5))::VARCHAR AS line FROM sc GROUP BY maxim")
def k07m(spark, sf):
    """Detections by maxim as counters in text exposition."""
    path = f"{shared_path(spark, 'metrics')}.prom"
    rows = scores(spark, sf).groupBy("maxim").agg(F.count_if(F.col("p_base") > 0.5).alias("total"))
    O.write_report(rows, path, "metrics", prefix="detections_", type="counter", title="Responses over the threshold")
    return spark.read.text(path).where("value not like '#%'").select(F.col("value").alias("line"))
