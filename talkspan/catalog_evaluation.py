"""More queries of inputs, pair cleaning, agreement, repair scores and samples, registered in the catalog.

As in catalog, values that come from models or people (ratings, preferences, kinds of violation) are stand-ins by md5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .catalog import _M, _NEXT, MAXIMS, _grams, SQL_EXAMPLES, SQL_PAIRS, SQL_SCORES, _sent, _sql_u, _u, examples, preference_pairs, query, scores, sql_degenerate, sql_weights, system_scores, turns
from .functions import heuristics as H
from .functions import text as T
from .functions import topics
from .operators import agreement as G
from .operators import bootstrap as B
from .operators import examples as E
from .operators import metrics as A
from .operators import pairs as P
from .operators import sampling as S
from .sources.tables import table

KINDS = ["none", "quantity", "quality", "relation", "manner", "multiple"]
TYPES = ["none", "quantity_over", "quality_unsupported", "relation_drift", "manner_runon", "multi_quality_quantity"]
PREFERENCES = ["A_much", "A_slightly", "equal", "B_slightly", "B_much"]
_ID = "conv_id*1000+turn"


def _pick(key: str, salt: str, n: int) -> str:
    return f"('0x'||substr(md5(({key})::VARCHAR||'|{salt}'),1,8))::BIGINT % {n}"


def _of(values: list[str], place: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), place.cast("int"))


def _sql_of(values: list[str], place: str) -> str:
    return "(" + repr(values) + f")[({place})+1]"


def id_() -> Column:
    return F.col("conv_id") * 1000 + F.col("turn")


def violated(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (id, text, maxim, violation_type)."""
    t = turns(spark, sf).select(id_().alias("id"), "text")
    k = T.pick(F.col("id"), "kind", 6)
    return t.select("id", "text", _of(KINDS, k).alias("maxim"), _of(TYPES, k).alias("violation_type"))


SQL_VIOLATED = f"vi AS (SELECT {_ID} AS id, text, {_sql_of(KINDS, _pick(_ID, 'kind', 6))} AS maxim, {_sql_of(TYPES, _pick(_ID, 'kind', 6))} AS violation_type FROM conversations)"


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (id, preference, a, b) of pairs that people compared."""
    p = preference_pairs(spark, sf)
    return p.select("id", _of(PREFERENCES, T.pick(F.col("id"), "pref", 5)).alias("preference"), F.col("chosen").alias("a"), F.col("rejected").alias("b"))


SQL_ANNOTATED = f"an AS (SELECT id, {_sql_of(PREFERENCES, _pick('id', 'pref', 5))} AS preference, chosen AS a, rejected AS b FROM ({_NEXT}) WHERE rejected IS NOT NULL)"


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (id, annotator, rating 1..5 or null) of three annotators."""
    t = turns(spark, sf).where("role = 'assistant'").select(id_().alias("id"))
    r = [F.struct(F.lit(a).alias("annotator"), F.when(T.pick(F.col("id"), a, 10) > 0, 1 + T.pick(F.col("id"), "true", 4) + T.pick(F.col("id"), a + "x", 2)).alias("rating")) for a in ("ann1", "ann2", "ann3")]
    return t.select("id", F.explode(F.array(*r)).alias("r")).select("id", "r.*")


SQL_RATINGS = "ra AS (" + " UNION ALL ".join(f"SELECT id, '{a}' AS annotator, CASE WHEN {_pick('id', a, 10)} > 0 THEN 1 + {_pick('id', 'true', 4)} + {_pick('id', a + 'x', 2)} END AS rating FROM (SELECT {_ID} AS id FROM conversations WHERE role='assistant')" for a in ("ann1", "ann2", "ann3")) + ")"
_BOTH = "rp AS (SELECT x.id, x.annotator AS first, y.annotator AS second, x.rating AS a, y.rating AS b FROM ra x JOIN ra y ON x.id=y.id AND x.annotator<y.annotator AND x.rating IS NOT NULL AND y.rating IS NOT NULL)"


def system_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (id, text, before, after): arrays of flags in the order of MAXIMS, before and after a repair."""
    s = scores(spark, sf)
    flag = lambda c, m: F.max(F.when(F.col("maxim") == m, F.col(c) > 0.5))
    wide = s.groupBy("id").agg(F.array(*(flag("p_base", m) for m in MAXIMS)).alias("before"), F.array(*(flag("p_tuned", m) for m in MAXIMS)).alias("after"))
    return wide.join(turns(spark, sf).select(id_().alias("id"), "text"), "id")


# ---- inputs and labels -----------------------------------------------------------------------------------------

_TOKENS = ", ".join(f"CASE WHEN {_sql_u(_ID, 'v_' + m)} < 0.4 THEN '[VIOLATION={m.upper()}]' END" for m in MAXIMS)


@query("p03_repair_input", f"WITH {SQL_EXAMPLES} SELECT conv_id, turn, md5(concat_ws(' ', '[REPAIR]', {_TOKENS}, '[CONTEXT]', context_text, '[EVIDENCE]', coalesce(evidence,''), '[RESPONSE]', response)) AS input FROM ex")
def p03(spark, sf):
    types = F.array_compact(F.array(*(F.when(_u(id_(), f"v_{m}") < 0.4, m) for m in MAXIMS)))
    return examples(spark, sf).select("conv_id", "turn", F.md5(E.format_repair_input(types)).alias("input"))


_LABELS = ", ".join(f"(CASE WHEN maxim='{m}' OR (maxim='multiple' AND contains(violation_type,'{m}')) THEN 1 ELSE 0 END)::INT AS {m}" for m in MAXIMS)


@query("p04_labels", f"WITH {SQL_VIOLATED} SELECT id, {_LABELS} FROM vi")
def p04(spark, sf):
    return violated(spark, sf).select("id", *(c.alias(m) for m, c in P.extract_labels(F.col("maxim"), F.col("violation_type")).items()))


@query("p05_violated_maxims", f"WITH {SQL_VIOLATED} SELECT id, array_to_string(CASE WHEN maxim='multiple' THEN list_filter(['quantity','quality','relation','manner'], lambda m: contains(lower(violation_type), m)) ELSE [maxim] END, ',') AS maxims FROM vi WHERE maxim<>'none'")
def p05(spark, sf):
    return P.repairable(violated(spark, sf), "text").select("id", F.array_join(P.violated_maxims(F.col("maxim"), F.col("violation_type")), ",").alias("maxims"))


@query("p06_repair_rows", f"WITH {SQL_VIOLATED} SELECT id FROM vi WHERE maxim<>'none' AND violation_type<>'none' AND text IS NOT NULL AND text<>''")
def p06(spark, sf):
    return P.repairable(violated(spark, sf), "text").select("id")


_SURE = f"WITH {SQL_SCORES}, w AS (SELECT id, " + ", ".join(f"max(CASE WHEN maxim='{m}' THEN p_base END) AS {m}" for m in MAXIMS) + " FROM sc GROUP BY id)"
_UNSURE = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {m}<=0.75 AND {m}>=0.25 THEN '{m}' END" for m in MAXIMS) + "], lambda x: x IS NOT NULL), ',')"


@query("p09_confident_labels", f"{_SURE} SELECT id, {_UNSURE} AS uncertain, " + ", ".join(f"(CASE WHEN {_UNSURE}='' THEN (CASE WHEN {m}>0.5 THEN 1 ELSE 0 END) END)::INT AS {m}" for m in MAXIMS) + " FROM w")
def p09(spark, sf):
    wide = scores(spark, sf).groupBy("id").agg(*(F.max(F.when(F.col("maxim") == m, F.col("p_base"))).alias(m) for m in MAXIMS))
    reason = P.uncertain_maxims({m: F.col(m) for m in MAXIMS})
    return wide.withColumn("uncertain", reason).select("id", "uncertain", *(F.when(F.col("uncertain") == "", (F.col(m) > 0.5).cast("int")).alias(m) for m in MAXIMS))


@query("p23_valid_rows", f"WITH {SQL_VIOLATED} SELECT id, maxim<>'none' AS violated FROM vi WHERE length(text)>50")
def p23(spark, sf):
    v = violated(spark, sf).where(F.length("text") > 50)
    flags = sum(P.extract_labels(F.col("maxim"), F.col("violation_type")).values(), F.lit(0))
    bad = v.where(flags > 0).select("id", F.lit(True).alias("violated"))
    return bad.unionByName(v.where("maxim = 'none'").select("id", F.lit(False).alias("violated")))


@query("p21_context_pool", "SELECT context FROM (SELECT DISTINCT substr(context,1,300) AS context FROM (SELECT lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context FROM conversations) WHERE length(context)>20) ORDER BY md5(context||'|pool'), context LIMIT 500")
def p21(spark, sf):
    c = E.adjacent_pairs(turns(spark, sf)).where(F.length("context") > 20).select(F.substring("context", 1, 300).alias("context")).distinct()
    return c.orderBy(S.order_key("context", "pool"), "context").limit(500)


# ---- pair filters ----------------------------------------------------------------------------------------------

_CONFLICT6 = " OR ".join([f"(m_{m}>0.15 AND m_manner<-0.15) OR (m_{m}<-0.15 AND m_manner>0.15)" for m in MAXIMS[:3]])


@query("p15_manner_conflicts", f"WITH {SQL_PAIRS}, c AS (SELECT {_M}, ({_CONFLICT6}) AS conflict, (SELECT avg(m_manner) FROM pr WHERE m_manner>-0.15) > 0 AS mild FROM pr) SELECT {_M}, conflict FROM c WHERE CASE WHEN mild THEN m_manner>-0.15 ELSE m_manner>0.05 END")
def p15(spark, sf):
    return P.manner_filter(preference_pairs(spark, sf)).select(*_M.split(", "), P.manner_conflict().alias("conflict"))


_SWAP18 = "CASE WHEN m_manner<-0.2 AND (m_quantity+m_quality+m_relation)/3>0.1 THEN true WHEN m_quantity<0 AND m_quality<0 AND m_relation<0 AND m_manner<0 THEN true ELSE false END"


@query("p18_fix_manner", f"WITH {SQL_PAIRS}, s AS (SELECT *, {_SWAP18} AS swapped FROM pr) SELECT id, swapped, md5(CASE WHEN swapped THEN rejected ELSE chosen END) AS chosen, CASE WHEN swapped THEN -avg_margin ELSE avg_margin END AS avg_margin FROM s WHERE NOT swapped OR -avg_margin>0.05")
def p18(spark, sf):
    return P.fix_manner(preference_pairs(spark, sf)).select("id", "swapped", F.md5("chosen").alias("chosen"), "avg_margin")


_W = lambda c: f"regexp_extract_all({c},'\\S+')"
_TRIM = lambda c: f"regexp_replace({c},'^\\s+|\\s+$','','g')"
_CLEANED = f"""WITH {SQL_ANNOTATED}, o AS (SELECT id, preference, {_TRIM("CASE WHEN preference LIKE 'A%' THEN a ELSE b END")} AS c, {_TRIM("CASE WHEN preference LIKE 'A%' THEN b ELSE a END")} AS r FROM an),
 f AS (SELECT id, CASE WHEN contains(preference,'much') THEN 1.0 ELSE 0.6 END::DOUBLE AS strength, CASE WHEN preference='equal' THEN 'equal_skip' WHEN len({_W('c')})<8 OR len({_W('r')})<8 THEN 'too_short' WHEN c=r THEN 'identical' WHEN len({_W('c')})>=5 AND len(list_filter({_W('c')}, lambda x: x LIKE '%!'))/len({_W('c')})>0.25 THEN 'chosen_word_bang'
 WHEN regexp_matches(c,'\\[\\d{{2}}:\\d{{2}}:\\d{{2}}\\].*\\[Server|From:.*@.*\\.\\w+|\\[Client thread/INFO\\]') THEN 'chosen_artifact' ELSE 'kept' END AS reason FROM o)"""


@query("p19_clean_annotated", f"{_CLEANED} SELECT id, strength, reason FROM f")
def p19(spark, sf):
    return P.clean_annotated(annotated(spark, sf)).select("id", "strength", "reason")


@query("p19_reasons", f"{_CLEANED} SELECT reason, count(*) AS n FROM f GROUP BY reason")
def p19r(spark, sf):
    return P.clean_annotated(annotated(spark, sf)).groupBy("reason").agg(F.count("*").alias("n"))


@query("p19_short_or_same_start", f"WITH {SQL_ANNOTATED} SELECT id FROM an WHERE preference<>'equal' AND length({_TRIM('a')})>=10 AND length({_TRIM('b')})>=10 AND substr({_TRIM('a')},1,50)<>substr({_TRIM('b')},1,50)")
def p19b(spark, sf):
    a, b = T.strip(F.col("a")), T.strip(F.col("b"))
    return annotated(spark, sf).where((F.col("preference") != "equal") & (F.length(a) >= 10) & (F.length(b) >= 10) & (F.substring(a, 1, 50) != F.substring(b, 1, 50))).select("id")


# ---- agreement -------------------------------------------------------------------------------------------------


@query("j03_same_sample_ratings", f"WITH {SQL_RATINGS} SELECT x.id, x.rating AS a, y.rating AS b FROM ra x JOIN ra y ON x.id=y.id AND x.annotator='ann1' AND y.annotator='ann2' WHERE x.rating IS NOT NULL AND y.rating IS NOT NULL")
def j03(spark, sf):
    r = ratings(spark, sf).where("annotator in ('ann1', 'ann2')")
    return G.annotator_pairs(r, "id", "annotator", "rating").select("id", "a", "b")


@query("j04_annotator_pairs", f"WITH {SQL_RATINGS}, {_BOTH} SELECT first, second, count(*) AS n, round(avg(CASE WHEN a=b THEN 1.0 ELSE 0.0 END),6) AS agree FROM rp GROUP BY 1, 2")
def j04(spark, sf):
    p = G.annotator_pairs(ratings(spark, sf), "id", "annotator", "rating")
    return p.groupBy("first", "second").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)), 6).alias("agree"))


@query("a18_mean_correlation", f"WITH {SQL_RATINGS}, {_BOTH}, c AS (SELECT first, second, corr(a, b) AS r FROM rp GROUP BY 1, 2 HAVING count(*)>=3) SELECT count(*) AS n_pairs, round(avg(r),6) AS mean_corr FROM c WHERE r IS NOT NULL AND NOT isnan(r)")
def a18c(spark, sf):
    return G.mean_pairwise_correlation(G.annotator_pairs(ratings(spark, sf), "id", "annotator", "rating"))


@query(
    "a18_krippendorff",
    f"""WITH {SQL_RATINGS}, u AS (SELECT id, rating AS v, count(*) OVER (PARTITION BY id) AS m FROM ra WHERE rating IS NOT NULL), p AS (SELECT id, v, m, row_number() OVER () AS k FROM u WHERE m>=2),
 o AS (SELECT x.v AS c, y.v AS k, sum(1/(x.m-1)) AS o FROM p x JOIN p y ON x.id=y.id AND x.k<>y.k GROUP BY 1, 2), n AS (SELECT v, count(*) AS n FROM p GROUP BY v),
 d AS (SELECT a.v AS c, b.v AS k, a.n AS nc, b.n AS nk, pow((SELECT sum(g.n) FROM n g WHERE g.v BETWEEN least(a.v,b.v) AND greatest(a.v,b.v)) - (a.n+b.n)/2, 2) * (CASE WHEN a.v=b.v THEN 0 ELSE 1 END) AS d FROM n a, n b)
 SELECT (SELECT count(DISTINCT id) FROM p) AS n_units, (SELECT count(*) FROM p) AS n_values, round(1-((SELECT count(*) FROM p)-1)*(SELECT sum(o*d) FROM o JOIN d USING (c,k))/(SELECT sum(nc*nk*d) FROM d), 6) AS alpha""",
)
def a18k(spark, sf):
    return G.krippendorff_ordinal(ratings(spark, sf), "id", "rating", [1, 2, 3, 4, 5])


@query("a20_mann_whitney_p")
def a20p(spark, sf):
    return G.mann_whitney_p(system_scores(spark, sf), "maxim", "p", "system", "base", "tuned")


_BY_INDEX = "round(list_sort(list(f))[(count(*)*25//1000)::INT+1],6) AS low, round(avg(f),6) AS mean, round(list_sort(list(f))[(count(*)*975//1000)::INT+1],6) AS high"


@query(
    "a17_bootstrap_f1",
    f"WITH {SQL_SCORES}, {sql_weights('sc')}, c AS (SELECT maxim, b, sum(CASE WHEN y=1 AND p_base>0.5 THEN w ELSE 0 END) AS tp, sum(CASE WHEN (y=1)<>(p_base>0.5) THEN w ELSE 0 END) AS e FROM sc JOIN wt USING (id) GROUP BY maxim, b), f1 AS (SELECT maxim, b, coalesce(2*tp/nullif(2*tp+e,0),0) AS f FROM c), "
    f"al AS (SELECT maxim, f FROM f1 UNION ALL SELECT 'macro', avg(f) FROM f1 GROUP BY b) SELECT maxim, {_BY_INDEX} FROM al GROUP BY maxim",
)
def a17(spark, sf):
    """Intervals of 10,000 resamples by maxim, and of their mean."""
    return B.f1_interval(scores(spark, sf), F.col("y") == 1, F.col("p_base") > 0.5)


@query("j12_paired_systems", f"WITH {SQL_SCORES} SELECT id, maxim, p_base AS base, p_tuned AS tuned FROM sc")
def j12(spark, sf):
    s = system_scores(spark, sf)
    side = lambda n: s.where(F.col("system") == n).select("id", "maxim", F.col("p").alias(n))
    return side("base").join(side("tuned"), ["id", "maxim"])


# ---- repairs and systems ---------------------------------------------------------------------------------------


@query("a06_repair_stats", f"WITH {SQL_VIOLATED}, k AS (SELECT * FROM vi WHERE maxim<>'none'), l AS (SELECT id, len({_W('text')}) AS w, maxim, unnest(CASE WHEN maxim='multiple' THEN list_filter(['quantity','quality','relation','manner'], lambda m: contains(violation_type, m)) ELSE [maxim] END) AS m FROM k) SELECT m AS maxim, count(*) AS n, count(*) FILTER (maxim='multiple') AS n_multi, round(avg(w),6) AS mean_words FROM l GROUP BY m")
def a06(spark, sf):
    r = P.repairable(violated(spark, sf), "text").select(T.n_words(F.col("text")).alias("w"), (F.col("maxim") == "multiple").alias("multi"), F.explode(P.violated_maxims(F.col("maxim"), F.col("violation_type"))).alias("maxim"))
    return r.groupBy("maxim").agg(F.count("*").alias("n"), F.count_if("multi").alias("n_multi"), F.round(F.avg("w"), 6).alias("mean_words"))


def _sql_grams(side: str) -> str:
    return " UNION ALL ".join(f"SELECT id, {n} AS n, unnest(list_transform(range(1, len({side})+({2 - n})), lambda i: array_to_string({side}[i:i+{n - 1}], ' '))) AS g FROM t" for n in range(1, 5))


_BLEU = f"""t AS (SELECT id, {_W('lower(chosen)')} AS h, {_W('lower(rejected)')} AS r FROM ({_NEXT}) WHERE rejected IS NOT NULL), hg AS (SELECT id, n, g, count(*) AS c FROM ({_sql_grams('h')}) GROUP BY 1, 2, 3), rg AS (SELECT id, n, g, count(*) AS c FROM ({_sql_grams('r')}) GROUP BY 1, 2, 3),
 hit AS (SELECT id, n, sum(least(hg.c, rg.c)) AS x FROM hg JOIN rg USING (id, n, g) GROUP BY 1, 2), m AS (SELECT t.id, len(h) AS hn, len(r) AS rn, k.n, coalesce(hit.x, 0) AS x FROM t CROSS JOIN unnest([1,2,3,4]) AS k(n) LEFT JOIN hit ON hit.id=t.id AND hit.n=k.n),
 bl AS (SELECT id, CASE WHEN sum(CASE WHEN n=1 THEN x ELSE 0 END)=0 THEN 0 ELSE round(exp((CASE WHEN hn>rn THEN 0 ELSE 1-rn/hn END)+sum(ln((CASE WHEN x=0 THEN 0.1 ELSE x END)/greatest(hn-n+1,1)))/4),6) END::DOUBLE AS bleu FROM m GROUP BY id, hn, rn)"""


@query("x18_bleu", f"WITH {_BLEU} SELECT id, bleu FROM bl")
def x18(spark, sf):
    return G.bleu(preference_pairs(spark, sf), "id", "chosen", "rejected")


@query("a34_repair_metrics", f"WITH {SQL_ANNOTATED}, {_BLEU} SELECT preference AS kind, round(avg(bleu),6) AS mean, round(stddev_pop(bleu),6) AS std, min(bleu) AS least, max(bleu) AS most, round(avg(CASE WHEN {_TRIM('lower(a)')}={_TRIM('lower(b)')} THEN 1.0 ELSE 0.0 END),6) AS exact FROM an JOIN bl USING (id) GROUP BY preference")
def a34(spark, sf):
    rows = annotated(spark, sf)
    same = T.strip(F.lower("a")) == T.strip(F.lower("b"))
    j = rows.select("id", F.col("preference").alias("kind"), same.alias("same")).join(G.bleu(rows, "id", "a", "b"), "id")
    b = F.col("bleu")
    return j.groupBy("kind").agg(F.round(F.avg(b), 6).alias("mean"), F.round(F.stddev_pop(b), 6).alias("std"), F.min(b).alias("least"), F.max(b).alias("most"), F.round(F.avg(F.when(F.col("same"), 1.0).otherwise(0.0)), 6).alias("exact"))


_AUDITED = f"d AS (SELECT id, maxim, text, w, {_grams('w')} AS g FROM (SELECT *, {_W('text')} AS w FROM vi WHERE maxim<>'none')), e AS (SELECT maxim, {sql_degenerate('text', 'w', 'g')} AS bad, length({_TRIM('text')})<40 AS short FROM d)"


@query("a38_degeneracy_audit", f"WITH {SQL_VIOLATED}, {_AUDITED}, t AS (SELECT count(*) AS n, count(*) FILTER (maxim<>'relation') AS k FROM e) SELECT maxim, count(*) AS n, count(*) FILTER (bad) AS degenerate, count(*) FILTER (short) AS fallback, round(count(*) FILTER (bad)/any_value(t.k),6)::DOUBLE AS share_of_audited, round(count(*) FILTER (bad)/any_value(t.n),6)::DOUBLE AS share_of_all FROM e, t WHERE maxim<>'relation' GROUP BY maxim")
def a38(spark, sf):
    """Counts by maxim but relation, which is not audited, as shares of the audited rows and of all."""
    v = violated(spark, sf).where("maxim <> 'none'")
    by = v.groupBy("maxim").agg(F.count("*").alias("n"), F.count_if(T.is_degenerate(F.col("text"))).alias("degenerate"), F.count_if(F.length(T.strip(F.col("text"))) < 40).alias("fallback"))
    every = Window.partitionBy()  # over one row a maxim
    share = lambda c: F.round(F.col("degenerate") / F.sum(c).over(every), 6)
    out = by.withColumns({"share_of_audited": share(F.when(F.col("maxim") != "relation", F.col("n"))), "share_of_all": share(F.col("n"))})
    return out.where("maxim <> 'relation'")


_FLAGS = f"WITH {SQL_SCORES}, fl AS (SELECT id, sum(CASE WHEN p_base>0.5 THEN 1 ELSE 0 END)::BIGINT AS v_before, sum(CASE WHEN p_tuned>0.5 THEN 1 ELSE 0 END)::BIGINT AS v_after, sum(CASE WHEN p_base>0.5 AND p_tuned<=0.5 THEN 1 ELSE 0 END) AS fixed, sum(CASE WHEN p_base<=0.5 AND p_tuned>0.5 THEN 1 ELSE 0 END)::BIGINT AS v_new FROM sc GROUP BY id)"


@query("a39_repair_success", f"{_FLAGS} SELECT id, v_before, v_after, v_new, round(1-v_after/greatest(v_before,1),6) AS removal, fixed>0 AND v_new=0 AND NOT (len({_W('text')})>=5 AND len(list_filter({_W('text')}, lambda x: x LIKE '%!'))/len({_W('text')})>0.25) AS success FROM fl JOIN (SELECT {_ID} AS id, text FROM conversations) USING (id)")
def a39(spark, sf):
    return A.repair_success(system_flags(spark, sf), "before", "after", "text").select("id", "v_before", "v_after", "v_new", "removal", "success")


@query(
    "a17_bootstrap_success",
    f"{_FLAGS}, su AS (SELECT id, (fixed>0 AND v_new=0 AND NOT (len({_W('text')})>=5 AND len(list_filter({_W('text')}, lambda x: x LIKE '%!'))/len({_W('text')})>0.25))::INT AS s FROM fl JOIN (SELECT {_ID} AS id, text FROM conversations) USING (id)), {sql_weights('su')}, "
    f"ms AS (SELECT sum(w*s)/nullif(sum(w),0) AS f FROM su JOIN wt USING (id) GROUP BY b) SELECT {_BY_INDEX} FROM ms",
)
def a17s(spark, sf):
    """The interval of the share of repairs that succeed."""
    rows = A.repair_success(system_flags(spark, sf), "before", "after", "text").select("id", F.col("success").cast("int").alias("success"))
    return B.mean_interval(rows, "success", [], by_index=True)


@query("a40_preference_accuracy", f"WITH {SQL_PAIRS} SELECT CASE WHEN {_pick('id', 'src', 2)}=0 THEN 'human' ELSE 'synthetic' END AS source, count(*) AS n, round(100*avg(CASE WHEN avg_margin>0 THEN 1.0 ELSE 0.0 END),6) AS accuracy, round(avg(avg_margin),6) AS mean_margin FROM pr GROUP BY 1")
def a40(spark, sf):
    p = preference_pairs(spark, sf).withColumn("source", F.when(T.pick(F.col("id"), "src", 2) == 0, "human").otherwise("synthetic"))
    return p.groupBy("source").agg(F.count("*").alias("n"), F.round(100 * F.avg(F.when(F.col("avg_margin") > 0, 1.0).otherwise(0.0)), 6).alias("accuracy"), F.round(F.avg("avg_margin"), 6).alias("mean_margin"))


_MARKS = ["FS1", "Evidence:", "Generate a cooperative response", "[agent_", "FS2", "FS3", "FS4", "FS5"]


@query("a28_artifacts", "SELECT role, count(*) AS n, " + ", ".join(f"count(*) FILTER (contains(text, '{m}')) AS mark{k}" for k, m in enumerate(_MARKS)) + f", count(*) FILTER (len(list_filter(range(1, len({_W('text')})-5), lambda i: (length(text)-length(replace(text, array_to_string({_W('text')}[i:i+2],' '), '')))//length(array_to_string({_W('text')}[i:i+2],' ')) >= 3)) > 0) AS repeating FROM conversations GROUP BY role")
def a28(spark, sf):
    return A.artifact_counts(turns(spark, sf), "text", _MARKS, ["role"])


@query("a32_threshold_ablation", f"WITH {SQL_SCORES}, f AS (SELECT * FROM sc WHERE id IN (SELECT DISTINCT id FROM sc ORDER BY id LIMIT 50)) SELECT t::INT AS t, " + ", ".join(f"round(avg(CASE WHEN maxim='{m}' THEN (CASE WHEN p_tuned>t/100 THEN 1.0 ELSE 0.0 END) END),6) AS {m}" for m in MAXIMS) + ", round(avg(CASE WHEN p_tuned>t/100 THEN 1.0 ELSE 0.0 END),6) AS overall FROM f, unnest([30,40,50,60,70]) AS g(t) GROUP BY t")
def a32(spark, sf):
    first = turns(spark, sf).where("role = 'assistant'").select(id_().alias("id")).orderBy("id").limit(50)
    s = scores(spark, sf).join(F.broadcast(first), "id", "left_semi")
    hit = F.when(F.col("p_tuned") > F.col("t") / 100, 1.0).otherwise(0.0)
    return s.withColumn("t", F.explode(F.array(*map(F.lit, [30, 40, 50, 60, 70])))).groupBy("t").agg(*(F.round(F.avg(F.when(F.col("maxim") == m, hit)), 6).alias(m) for m in MAXIMS), F.round(F.avg(hit), 6).alias("overall"))


@query("a36_relative_change", f"WITH {SQL_SCORES} SELECT maxim, round(100*(avg(p_tuned)-avg(p_base))/avg(p_base),6) AS relative FROM sc GROUP BY maxim")
def a36r(spark, sf):
    return scores(spark, sf).groupBy("maxim").agg(F.round(100 * F.try_divide(F.avg("p_tuned") - F.avg("p_base"), F.avg("p_base")), 6).alias("relative"))


@query("a37_overall", f"WITH w AS (SELECT {_ID} AS id, role, {_W('lower(text)')} AS w FROM conversations), s AS (SELECT role, {_sql_u('id', 'rel')} AS r, CASE WHEN len(w)<15 THEN 0.5 WHEN len(w)<=150 THEN 1.0 ELSE 0.7 END AS q, CASE WHEN len(w)=0 THEN 0 ELSE least(1,1.2*len(list_distinct(w))/len(w)) END AS c FROM w) SELECT role, round(avg(r),6) AS relevance, round(avg(q),6) AS quantity, round(avg(c),6) AS clarity, round(avg(0.4*r+0.3*q+0.3*c),6) AS overall FROM s GROUP BY role")
def a37o(spark, sf):
    t = turns(spark, sf).select("role", _u(id_(), "rel").alias("relevance"), *(c.alias(n) for n, c in A.baseline_scores(F.col("text")).items()))
    overall = 0.4 * F.col("relevance") + 0.3 * F.col("quantity") + 0.3 * F.col("clarity")
    return t.groupBy("role").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("relevance", "quantity", "clarity")), F.round(F.avg(overall), 6).alias("overall"))


@query("a43_pair_sizes", f"WITH s AS (SELECT CASE WHEN {_pick('id', 'cut', 10)}<9 THEN 'train' ELSE 'val' END AS split, length(chosen) AS c, length(rejected) AS r FROM ({_NEXT}) WHERE rejected IS NOT NULL) SELECT split, count(*) AS n, round(avg(c),6) AS chosen_chars, round(avg(r),6) AS rejected_chars, round(avg(c)/4,6) AS chosen_tokens FROM s GROUP BY split")
def a43(spark, sf):
    split = F.when(T.pick(F.col("id"), "cut", 10) < 9, "train").otherwise("val").alias("split")
    c, r = F.length("chosen"), F.length("rejected")
    return preference_pairs(spark, sf).groupBy(split).agg(F.count("*").alias("n"), F.round(F.avg(c), 6).alias("chosen_chars"), F.round(F.avg(r), 6).alias("rejected_chars"), F.round(F.avg(c) / 4, 6).alias("chosen_tokens"))


@query("a44_success_rate", "SELECT event_type, count(*) AS n, round(avg(CASE WHEN value<50 THEN 1.0 ELSE 0.0 END),6) AS success FROM events GROUP BY event_type")
def a44(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("value") < 50, 1.0).otherwise(0.0)), 6).alias("success"))


@query("a45_corpus_by_topic", "SELECT lang, count(*) AS n, count(DISTINCT source) AS n_sources, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang")
def a45(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


_Z = "(CASE WHEN y=1 THEN 1 ELSE -1 END)*ln(greatest(p_base,1e-6)/greatest(1-p_base,1e-6))/(k*0.1)"


@query("a46_temperature", f"WITH {SQL_SCORES}, l AS (SELECT maxim, k, round(avg(greatest(-({_Z}),0)+ln(1+exp(-abs({_Z})))),8) AS loss FROM sc, unnest(range(1,101)) AS g(k) GROUP BY maxim, k) SELECT maxim, round(k*0.1,6)::DOUBLE AS temperature, round(loss,6) AS loss FROM (SELECT *, row_number() OVER (PARTITION BY maxim ORDER BY loss, k) AS r FROM l) WHERE r=1")
def a46(spark, sf):
    return G.fit_temperature(scores(spark, sf), "maxim", "p_base", "y")


@query("a47_preference_distribution", f"WITH {SQL_ANNOTATED} SELECT preference, count(*) AS n, round(100*count(*)/sum(count(*)) OVER (),6) AS pct, " + ", ".join(f"count(*) FILTER (contains(lower(a),'{m}')) AS {m}" for m in MAXIMS) + " FROM an GROUP BY preference")
def a47(spark, sf):
    c = annotated(spark, sf).groupBy("preference").agg(F.count("*").alias("n"), *(F.count_if(F.lower("a").contains(m)).alias(m) for m in MAXIMS))
    return c.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


# ---- samples ---------------------------------------------------------------------------------------------------


@query(
    "t11_annotation_sample",
    f"WITH {SQL_VIOLATED}, "
    + ", ".join(f"s{k} AS (SELECT id, '{m}' AS category FROM vi WHERE {w}" + "".join(f" AND id NOT IN (SELECT id FROM s{j})" for j in range(k)) + f" ORDER BY md5(id::VARCHAR||'|ann{k}'), id LIMIT {n})" for k, (m, w, n) in enumerate([*((m, f"(maxim='{m}' OR contains(violation_type,'{m}'))", 200) for m in MAXIMS), ("clean", "maxim='none'", 200), ("random", "true", 100)]))
    + " " + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(6)),
)
def t11(spark, sf, n=200, n_random=100):
    v = violated(spark, sf).select("id", "maxim", "violation_type")
    wants = [*((m, (F.col("maxim") == m) | F.col("violation_type").contains(m), n) for m in MAXIMS), ("clean", F.col("maxim") == "none", n), ("random", F.lit(True), n_random)]
    return S.quota_sample(v, wants, "id", "ann").select("id", "category")


@query("t12_relation_sample", f"WITH {SQL_EXAMPLES}, i AS (SELECT {_ID} AS id, concat_ws(' ', '[REPAIR]', {_TOKENS}) AS t FROM ex) SELECT id FROM i WHERE contains(t,'[VIOLATION=RELATION]') ORDER BY md5(id::VARCHAR||'|rel'), id LIMIT 200")
def t12(spark, sf):
    types = F.array_compact(F.array(*(F.when(_u(id_(), f"v_{m}") < 0.4, m) for m in MAXIMS)))
    i = examples(spark, sf).select(id_().alias("id"), E.format_repair_input(types).alias("t")).where(F.col("t").contains("[VIOLATION=RELATION]"))
    return i.orderBy(S.order_key("id", "rel"), "id").limit(200).select("id")


@query("t15_last_pool", f"WITH {SQL_VIOLATED}, p AS (SELECT * FROM vi ORDER BY id DESC LIMIT 600), r AS (SELECT id, maxim<>'none' AS violated, row_number() OVER (PARTITION BY maxim<>'none' ORDER BY md5(id::VARCHAR||'|last'), id) AS k FROM p) SELECT id, violated FROM r WHERE k<=500")
def t15(spark, sf):
    pool = violated(spark, sf).select("id", (F.col("maxim") != "none").alias("violated")).orderBy(F.col("id").desc()).limit(600)
    return S.per_group(pool, ["violated"], 500, "id", "last")


@query("j08_holdout_removal", "SELECT doc_id, lang, source FROM documents EXCEPT ALL SELECT doc_id, lang, source FROM documents WHERE doc_id % 7 = 0")
def j08(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source")
    return d.exceptAll(d.where("doc_id % 7 = 0"))


# ---- texts -----------------------------------------------------------------------------------------------------


@query("j10_sentence_pairs", f"WITH s AS (SELECT conv_id, turn, {_sent('text')} AS s FROM conversations), w AS (SELECT conv_id, turn, list_transform(s, lambda x: list_distinct({_W('lower(x)')})) AS w FROM s), p AS (SELECT conv_id, turn, a.i AS i, a.j AS j, w[a.i] AS x, w[a.j] AS y FROM w, (SELECT i, j FROM range(1,200) r(i), range(1,200) q(j) WHERE i<j) a WHERE a.j<=len(w)) SELECT conv_id, turn, count(*) AS n_pairs, round(max(coalesce(len(list_intersect(x,y))/nullif(least(len(x),len(y)),0),0)),6) AS most FROM p GROUP BY 1, 2")
def j10(spark, sf):
    pairs = H.sentence_overlaps(F.col("text"))
    return turns(spark, sf).select("conv_id", "turn", pairs.alias("p")).where(F.size("p") > 0).select("conv_id", "turn", F.size("p").cast("long").alias("n_pairs"), F.round(F.array_max("p"), 6).alias("most"))


_ONE_BLANK = "regexp_replace(text,'\\s+',' ','g')"


@query("x11_normalize", f"SELECT conv_id, turn, {_TRIM('text')} AS stripped, {_TRIM(_ONE_BLANK)} AS collapsed, '['||role||']: '||text AS spoken FROM conversations")
def x11(spark, sf):
    t = F.col("text")
    spoken = F.concat(F.lit("["), F.coalesce("role", F.lit("agent")), F.lit("]: "), F.coalesce("text", F.lit("")))
    return turns(spark, sf).select("conv_id", "turn", T.normalized(t).alias("stripped"), T.normalized(t, True).alias("collapsed"), spoken.alias("spoken"))


_LAST_PART = "string_split(t,'[RESPONSE]')[-1]"
_LAST_PIECE = f"string_split({_TRIM('t')},'.')[-1]"
_INPUT = "CASE WHEN turn % 2 = 0 THEN '[CONTEXT] '||context_text||' [RESPONSE] '||response ELSE response END"


@query("x15_original_response", f"WITH {SQL_EXAMPLES}, i AS (SELECT conv_id, turn, {_INPUT} AS t FROM ex) SELECT conv_id, turn, md5(CASE WHEN contains(t,'[RESPONSE]') THEN {_TRIM(_LAST_PART)} ELSE {_TRIM(_LAST_PIECE)}||'.' END) AS original FROM i")
def x15(spark, sf):
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[CONTEXT] "), "context_text", F.lit(" [RESPONSE] "), "response")).otherwise(F.col("response"))
    return examples(spark, sf).select("conv_id", "turn", F.md5(E.original_response(t)).alias("original"))


_FIRST = "CASE " + " ".join(f"WHEN regexp_matches(t,'{'|'.join(ws)}') THEN '{n}'" for n, ws in topics.TOPICS.items()) + " ELSE 'general' END"


@query("x16_first_topic", f"SELECT doc_id, {_FIRST} AS topic FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def x16f(spark, sf):
    return table(spark, sf, "documents").select("doc_id", topics.first_topic(F.col("text")).alias("topic"))


_TABLE = ", ".join(f"({k}, '{n}', '{w}')" for k, (n, ws) in enumerate(topics.TOPICS.items()) for w in ws)


@query("x16_weighted_topic", f"WITH k(o, topic, w) AS (VALUES {_TABLE}), t AS (SELECT conv_id, turn, lower(text) AS t, regexp_extract_all(lower(text),'[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS ws FROM conversations), s AS (SELECT conv_id, turn, o, topic, sum(CASE WHEN list_contains(ws,w) THEN 10+(CASE WHEN length(w)>6 THEN 5 ELSE 0 END)+(CASE WHEN instr(t,w)-1<length(t)/2 THEN 3 ELSE 0 END) WHEN contains(t,w) THEN 5 ELSE 0 END) AS s FROM t, k GROUP BY 1,2,3,4), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY s DESC, o) AS r FROM s) SELECT conv_id, turn, CASE WHEN s>0 THEN topic ELSE 'general' END AS topic FROM r WHERE r=1")
def x16w(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", topics.weighted_topic(F.col("text")).alias("topic"))


@query("h07_similarity_votes", f"WITH {SQL_EXAMPLES}, s AS (SELECT conv_id, turn, {_sql_u(_ID, 'sim')} AS s FROM ex) SELECT conv_id, turn, round(CASE WHEN s<0.2 THEN (0.2-s)/0.2 ELSE 0 END,6)::DOUBLE AS relation, round(CASE WHEN s<0.3 THEN (0.3-s)/0.3 ELSE 0 END,6)::DOUBLE AS quality FROM s")
def h07(spark, sf):
    s = _u(id_(), "sim")
    return examples(spark, sf).select("conv_id", "turn", F.round(H.semantic_similarity(s)["score"], 6).alias("relation"), F.round(H.evidence_similarity(s)["score"], 6).alias("quality"))


_SYL = f"list_sum(list_transform({_W('lower(response)')}, lambda x: greatest(len(regexp_extract_all(x,'[aeiouy]+')),1)))"


@query("h09_readability", f"WITH {SQL_EXAMPLES}, g AS (SELECT conv_id, turn, 0.39*len(w)/greatest(len({_sent('response')}),1)+11.8*{_SYL}/len(w)-15.59 AS g FROM ex WHERE len(w)>=10) SELECT conv_id, turn, round(CASE WHEN g>16 THEN least(1,(g-16)/4) ELSE 0 END,6)::DOUBLE AS score, 0.6::DOUBLE AS confidence FROM g")
def h09(spark, sf):
    v = examples(spark, sf).select("conv_id", "turn", H.readability(F.col("response")).alias("v")).where("v is not null")
    return v.select("conv_id", "turn", F.round("v.score", 6).alias("score"), "v.confidence")
