"""All queries of the dialogue operators by name, and the SQL they are checked against.

Scores come from the tables by md5 (a scores table is an input contract here: models are out of scope): every
assistant turn has a violation probability of two systems for each maxim, and a truth flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import heuristics as H
from .functions import text as T
from .operators import bootstrap as B
from .operators import examples as E
from .operators import metrics as A
from .operators import pairs as P
from .operators import retrieval as R
from .operators import sampling as S
from .operators.ranges import following
from .sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
MAXIMS = P.MAXIMS


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


# ---- inputs ----------------------------------------------------------------------------------------------------


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations")


def examples(spark: SparkSession, sf: str) -> DataFrame:
    return E.extract_examples(turns(spark, sf))


def _u(key, salt: str):
    return T.pick(key, salt, 1000) / 1000


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """id, maxim, p_base, p_tuned, y of every assistant turn."""
    t = turns(spark, sf).where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"))
    rows = [F.struct(F.lit(m).alias("maxim"), _u(F.col("id"), f"b_{m}").alias("p_base"), _u(F.col("id"), f"t_{m}").alias("p_tuned"), F.when(_u(F.col("id"), f"y_{m}") < 0.4, 1).otherwise(0).alias("y")) for m in MAXIMS]
    return t.select("id", F.explode(F.array(*rows)).alias("s")).select("id", "s.*")


def preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each assistant turn as chosen against the next one of its conversation as rejected, with scores and margins."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns(spark, sf).where("role = 'assistant'").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("chosen"), F.lead("text").over(w).alias("rejected"))
    t = t.where("rejected is not null")
    for m in MAXIMS:
        t = t.withColumns({f"c_{m}": _u(F.col("id"), f"c_{m}"), f"r_{m}": _u(F.col("id"), f"r_{m}")})
    return P.with_margins(t)


def _sql_u(key: str, salt: str) -> str:
    return f"(('0x'||substr(md5(({key})::VARCHAR||'|{salt}'),1,8))::BIGINT % 1000)/1000.0"


SQL_EXAMPLES = """
ex AS (SELECT * FROM (
  SELECT conv_id, turn, role, text AS response, regexp_extract_all(text,'\\S+') AS w,
    coalesce(array_to_string(list('['||role||']: '||text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING),' '),'') AS context_text,
    lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS evidence FROM conversations) WHERE len(w) >= 5)"""
SQL_SCORES = "sc AS (" + " UNION ALL ".join(
    f"SELECT id, '{m}' AS maxim, {_sql_u('id', 'b_' + m)} AS p_base, {_sql_u('id', 't_' + m)} AS p_tuned, CASE WHEN {_sql_u('id', 'y_' + m)} < 0.4 THEN 1 ELSE 0 END AS y FROM (SELECT conv_id*1000+turn AS id FROM conversations WHERE role='assistant')" for m in MAXIMS
) + ")"
_MARGIN = ", ".join(f"round({_sql_u('id', 'r_' + m)} - {_sql_u('id', 'c_' + m)}, 6) AS m_{m}" for m in MAXIMS)
SQL_PAIRS = f"""pr AS (SELECT *, round((m_quantity+m_quality+m_relation+m_manner)/4, 6) AS avg_margin FROM (SELECT *, {_MARGIN} FROM (
  SELECT conv_id, conv_id*1000+turn AS id, text AS chosen, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS rejected FROM conversations WHERE role='assistant') WHERE rejected IS NOT NULL))"""
_M = "id, m_quantity, m_quality, m_relation, m_manner, avg_margin"


def _stop() -> str:
    return "[" + ",".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _kw(c: str) -> str:
    return f"list_filter(list_filter(regexp_extract_all(lower({c}),'[\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: regexp_full_match(x,'[a-z]+')), lambda x: length(x)>=4 AND NOT list_contains({_stop()}, x))"


def _sent(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(regexp_replace({c},'^\\s+|\\s+$','','g'),'([.!?])\\s+','\\1'||chr(1),'g'),chr(1)), lambda x: x<>'')"


# ---- sources, examples, inputs ---------------------------------------------------------------------------------


@query("p01_context_examples", f"WITH {SQL_EXAMPLES} SELECT conv_id, turn, role, md5(response) AS response, md5(context_text) AS context_text, md5(evidence) AS evidence FROM ex")
def p01(spark, sf):
    return examples(spark, sf).select("conv_id", "turn", "role", *(F.md5(c).alias(c) for c in ("response", "context_text", "evidence")))


@query("p02_detector_input", f"WITH {SQL_EXAMPLES} SELECT conv_id, turn, md5('[CONTEXT] '||substr(context_text,1,1024)||' [EVIDENCE] '||substr(coalesce(evidence,''),1,512)||' [RESPONSE] '||substr(response,1,512)) AS input FROM ex")
def p02(spark, sf):
    return examples(spark, sf).select("conv_id", "turn", F.md5(E.format_input()).alias("input"))


@query(
    "p07_extract_components",
    f"WITH {SQL_EXAMPLES}, i AS (SELECT conv_id, turn, '[CONTEXT] '||substr(context_text,1,1024)||' [EVIDENCE] '||substr(coalesce(evidence,''),1,512)||' [RESPONSE] '||substr(response,1,512) AS t FROM ex) "
    "SELECT conv_id, turn, " + ", ".join(f"md5(regexp_replace(regexp_extract(t,'{p}',1),'^\\s+|\\s+$','','g')) AS {n}" for n, p in (("context", r"(?s)\[CONTEXT\](.*?)\[EVIDENCE\]"), ("evidence", r"(?s)\[EVIDENCE\](.*?)\[RESPONSE\]"), ("response", r"(?s)\[RESPONSE\](.*)$"))) + " FROM i",
)
def p07(spark, sf):
    t = examples(spark, sf).select("conv_id", "turn", E.format_input().alias("t"))
    return t.select("conv_id", "turn", *(F.md5(c).alias(n) for n, c in E.extract_components(F.col("t")).items()))


@query("s03_adjacent_pairs", "SELECT conv_id, turn, md5(context) AS context, md5(response) AS response FROM (SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS context, text AS response FROM conversations) WHERE context IS NOT NULL")
def s03(spark, sf):
    return E.adjacent_pairs(turns(spark, sf)).select("conv_id", "turn", F.md5("context").alias("context"), F.md5("response").alias("response"))


@query("x_text_primitives", f"SELECT conv_id, turn, len(regexp_extract_all(text,'\\S+')) AS n_words, len({_sent('text')}) AS n_sentences, len({_kw('text')}) AS n_keywords, len(list_distinct({_kw('text')})) AS n_distinct FROM conversations")
def x01(spark, sf):
    t = F.col("text")
    return turns(spark, sf).select("conv_id", "turn", T.n_words(t).alias("n_words"), F.size(T.sentences(t)).alias("n_sentences"), F.size(T.keywords(t)).alias("n_keywords"), F.size(F.array_distinct(T.keywords(t))).alias("n_distinct"))


@query("x05_numbers", "SELECT doc_id, len(regexp_extract_all(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{L}\\p{N}]', ' ', 'g'), '[^\\x00-\\x7F]', 'a', 'g'), '\\b\\d+(?:,\\d{3})*(?:\\.\\d+)?\\b')) AS n_numbers FROM documents")
def x05(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.numbers(F.col("text"))).alias("n_numbers"))


@query("x09_clean_pages", "SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,'\\s+',' ','g'),'^\\s+|\\s+$','','g'),'\\[.*?\\]','','g'),'<.*?>','','g'),'^\\s+|\\s+$','','g')) AS cleaned FROM pages")
def x09(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.clean(F.col("html"))).alias("cleaned"))


@query("x10_norm_hash", "SELECT conv_id, turn, substr(md5(regexp_replace(regexp_replace(lower(text),'\\s+',' ','g'),'^\\s+|\\s+$','','g')),1,16) AS h FROM conversations")
def x10(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", T.norm_hash(F.col("text")).alias("h"))


@query("x20_relevance", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) SELECT e.vec_id AS a, e.b, round(list_cosine_similarity(e.v, n.v), 6) AS relevance FROM e JOIN e n ON n.vec_id = e.b")
def x20(spark, sf):
    """Every vector against the next one of its label."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", R.normalised(F.col("embedding")).alias("v"))
    pairs = following(e.select("label", "vec_id"), ["label"], "vec_id", "b").where("b is not null").select(F.col("vec_id").alias("a"), "b")
    left, right = e.select(F.col("vec_id").alias("a"), F.col("v").alias("q")), e.select(F.col("vec_id").alias("b"), "v")
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.round(T.dot(F.col("q"), F.col("v")), 6).alias("relevance"))


# ---- heuristics ------------------------------------------------------------------------------------------------

_QW = "len(regexp_extract_all(lower(context_text), '\\b(who|what|when|where|why|how)\\b'))"
_EXP = f"(CASE WHEN {_QW}=0 THEN 10.0 WHEN {_QW}=1 THEN 20.0 ELSE 30.0 END) * (CASE WHEN contains(substr(context_text,1,greatest(length(context_text)-1,0)),'?') OR contains(lower(context_text),' and ') THEN 1.5 ELSE 1.0 END)"
_H01 = f"WITH {SQL_EXAMPLES}, r AS (SELECT conv_id, turn, len(w)/({_EXP}) AS q FROM ex) SELECT conv_id, turn, round(CASE WHEN q<0.3 THEN least(1.0,(0.3-q)/0.3) WHEN q>3 THEN least(1.0,(q-3)/3) ELSE 0.0 END, 6) AS score, 0.7::DOUBLE AS confidence FROM r"


def _vote(spark, sf, c):
    return examples(spark, sf).select("conv_id", "turn", c.alias("v")).select("conv_id", "turn", F.round("v.score", 6).alias("score"), "v.confidence")


@query("h01_length_ratio", _H01)
def h01(spark, sf):
    return _vote(spark, sf, H.length_ratio(F.col("response"), F.col("context_text")))


@query("h03_info_density", f"WITH {SQL_EXAMPLES}, f AS (SELECT conv_id, turn, len({_sent('response')}) AS n, len(list_distinct({_kw('response')})) AS k FROM ex) SELECT conv_id, turn, round(CASE WHEN n>2 AND k/greatest(n,1)<2 THEN (2-k/greatest(n,1))/2 ELSE 0.0 END, 6) AS score, (CASE WHEN n=0 THEN 0.3 ELSE 0.5 END)::DOUBLE AS confidence FROM f")
def h03(spark, sf):
    return _vote(spark, sf, H.info_density(F.col("response")))


@query("h04_evidence_coverage", f"WITH {SQL_EXAMPLES}, f AS (SELECT conv_id, turn, list_distinct({_kw('response')}) AS r, list_distinct({_kw('evidence')}) AS e FROM ex WHERE evidence IS NOT NULL), g AS (SELECT conv_id, turn, CASE WHEN len(r)=0 OR len(e)=0 THEN 0.5 ELSE len(list_intersect(r,e))/len(r) END AS s FROM f) SELECT conv_id, turn, round(CASE WHEN s<0.3 THEN 1-s ELSE 0.0 END, 6) AS score, 0.4::DOUBLE AS confidence FROM g")
def h04(spark, sf):
    return _vote(spark, sf, F.when(F.col("evidence").isNotNull(), H.evidence_coverage(F.col("response"), F.col("evidence")))).where("score is not null")


@query("h08_keyword_overlap", f"WITH {SQL_EXAMPLES}, f AS (SELECT conv_id, turn, list_distinct({_kw('response')}) AS r, list_distinct({_kw('context_text')}) AS c FROM ex), g AS (SELECT *, len(list_intersect(r,c))/greatest(len(c),1) AS s FROM f) SELECT conv_id, turn, (CASE WHEN len(c)=0 THEN 0.0 WHEN s=0 THEN 0.8 WHEN s<0.2 THEN 0.4 ELSE 0.0 END)::DOUBLE AS score, (CASE WHEN len(c)=0 THEN 0.3 ELSE 0.6 END)::DOUBLE AS confidence FROM g")
def h08(spark, sf):
    own, r, c, _ = H.prepare(examples(spark, sf))
    return own.select("conv_id", "turn", H.keyword_overlap(r, c).alias("v")).select("conv_id", "turn", F.round("v.score", 6).alias("score"), "v.confidence")


@query("h11_sentence_complexity", f"WITH {SQL_EXAMPLES}, f AS (SELECT conv_id, turn, list_transform({_sent('response')}, lambda s: len(regexp_extract_all(s,'\\S+'))) AS l FROM ex), g AS (SELECT conv_id, turn, len(l) AS n, coalesce(list_max(l),0) AS x, coalesce(list_avg(l),0) AS a FROM f) SELECT conv_id, turn, (CASE WHEN x>50 THEN 0.8 WHEN a>35 THEN 0.5 WHEN a>25 AND x>40 THEN 0.4 ELSE 0.0 END)::DOUBLE AS score, (CASE WHEN n=0 THEN 0.3 ELSE 0.6 END)::DOUBLE AS confidence FROM g")
def h11(spark, sf):
    return _vote(spark, sf, H.sentence_complexity(F.col("response")))


_RW = "regexp_extract_all(response,'\\S+')"
_S = _sent("response")


def _entities(c: str) -> str:
    return f"list_distinct(list_transform(list_filter(list_transform(regexp_extract_all({c},'\\S+'), lambda x: regexp_replace(x,'[^\\p{{L}}\\p{{M}}\\p{{N}}_]','','g')), lambda x: length(x)>2 AND regexp_matches(x,'^\\p{{Lu}}')), lambda x: lower(x)))"


def _grams(w: str) -> str:
    return f"list_transform(range(1, greatest(len({w})-1,1)), lambda i: array_to_string({w}[i:i+2],' '))"


def _names(ws: list[str]) -> str:
    return "[" + ",".join(f"'{w}'" for w in ws) + "]"


_STARTS = f"len(list_filter(s, lambda x: list_contains({_names(T.START_PRONOUNS)}, regexp_replace(lower(coalesce(regexp_extract_all(x,'\\S+')[1],'')),'[.,]+$',''))))"
_PRON = f"len(list_filter(regexp_extract_all(lower(response),'\\S+'), lambda x: list_contains({_names(T.PRONOUNS)}, regexp_replace(x,'[.,!?;:]+$',''))))"
#: Scores and confidences of all votes: lr, rd, id (quantity), ec, en (quality), ko (relation), ap, sc (manner).
SQL_VOTES = f"""{SQL_EXAMPLES},
 v0 AS (SELECT conv_id, turn, role, response, evidence, len(w) AS nw, len(w)/({_EXP}) AS q, {_S} AS s, list_distinct({_kw('response')}) AS kr, list_distinct({_kw('context_text')}) AS kc, list_distinct({_kw('evidence')}) AS ke, {_entities('response')} AS er, {_entities('evidence')} AS ee FROM ex),
 v1 AS (SELECT *, len(s) AS n, list_transform(s, lambda x: list_distinct({_grams("regexp_extract_all(lower(x),'\\S+')")})) AS g, {_STARTS} AS starts, {_PRON}/greatest(nw,1) AS ratio, list_transform(s, lambda x: len(regexp_extract_all(x,'\\S+'))) AS l, CASE WHEN len(kr)=0 OR len(ke)=0 THEN 0.5 ELSE len(list_intersect(kr,ke))/len(kr) END AS cov, len(list_filter(er, lambda x: NOT list_contains(ee,x)))/greatest(len(er),1) AS novel, len(list_intersect(kr,kc))/greatest(len(kc),1) AS shared FROM v0),
 v2 AS (SELECT *, coalesce(list_avg(list_filter(flatten(list_transform(range(1,len(g)+1), lambda i: list_transform(range(i+1,len(g)+1), lambda j: CASE WHEN len(g[i])>0 AND len(g[j])>0 THEN len(list_intersect(g[i],g[j]))/least(len(g[i]),len(g[j])) END))), lambda x: x IS NOT NULL)),0) AS m, coalesce(list_max(l),0) AS lx, coalesce(list_avg(l),0) AS la FROM v1),
 vo AS (SELECT conv_id, turn, role, evidence, nw,
  CASE WHEN q<0.3 THEN least(1.0,(0.3-q)/0.3) WHEN q>3 THEN least(1.0,(q-3)/3) ELSE 0.0 END AS lr, 0.7 AS lr_c,
  CASE WHEN nw>=20 THEN (CASE WHEN m>0.2 THEN least(1.0,m/0.5) ELSE 0.0 END) END AS rd, CASE WHEN n<2 THEN 0.3 ELSE 0.6 END AS rd_c,
  CASE WHEN n>2 AND len(kr)/greatest(n,1)<2 THEN (2-len(kr)/greatest(n,1))/2 ELSE 0.0 END AS id, CASE WHEN n=0 THEN 0.3 ELSE 0.5 END AS id_c,
  CASE WHEN cov<0.3 THEN 1-cov ELSE 0.0 END AS ec, 0.4 AS ec_c, CASE WHEN len(er)>0 AND novel>0.5 THEN novel ELSE 0.0 END AS en, CASE WHEN len(er)=0 THEN 0.3 ELSE 0.5 END AS en_c,
  CASE WHEN len(kc)=0 THEN 0.0 WHEN shared=0 THEN 0.8 WHEN shared<0.2 THEN 0.4 ELSE 0.0 END AS ko,
  CASE WHEN nw<5 THEN 0.0 WHEN ratio>0.15 AND starts>1 THEN least(1.0,ratio/0.3) WHEN starts>=n*0.5 AND n>=2 THEN 0.6 ELSE 0.0 END AS ap, CASE WHEN nw<5 THEN 0.3 ELSE 0.5 END AS ap_c,
  CASE WHEN lx>50 THEN 0.8 WHEN la>35 THEN 0.5 WHEN la>25 AND lx>40 THEN 0.4 ELSE 0.0 END AS sc, CASE WHEN n=0 THEN 0.3 ELSE 0.6 END AS sc_c FROM v2)"""


def _mean(*votes: str) -> str:
    return "(" + "+".join(f"{v}*{v}_c" for v in votes) + ")/(" + "+".join(f"{v}_c" for v in votes) + ")"


def _agree(mean: str, *votes: str) -> str:
    return f"1-least(1.0,4*({'+'.join(f'pow({v}-{mean},2)' for v in votes)})/{len(votes)})"


SQL_LABELS = f"""{SQL_VOTES},
 l0 AS (SELECT *, CASE WHEN nw>=20 THEN {_mean('lr', 'rd', 'id')} ELSE {_mean('lr', 'id')} END AS quantity, CASE WHEN evidence IS NULL THEN 0.0 ELSE {_mean('ec', 'en')} END AS quality, ko AS relation, {_mean('ap', 'sc')} AS manner FROM vo),
 la AS (SELECT *, CASE WHEN nw>=20 THEN {_agree('quantity', 'lr', 'rd', 'id')} ELSE {_agree('quantity', 'lr', 'id')} END AS quantity_a, CASE WHEN evidence IS NULL THEN 1.0 ELSE {_agree('quality', 'ec', 'en')} END AS quality_a, 1.0 AS relation_a, {_agree('manner', 'ap', 'sc')} AS manner_a FROM l0)"""


@query("h12_weak_labels", f"WITH {SQL_LABELS} SELECT conv_id, turn, " + ", ".join(f"round({m},6)::DOUBLE AS {m}_probability, round({m}_a,6)::DOUBLE AS {m}_agreement" for m in MAXIMS) + " FROM la")
def h12(spark, sf):
    flat = [F.round(f"{m}.{p}", 6).alias(f"{m}_{p}") for m in MAXIMS for p in ("probability", "agreement")]
    return H.weak_labels(examples(spark, sf)).select("conv_id", "turn", *flat)


@query("flagship_weak_label_summary", f"WITH {SQL_LABELS}, r AS (" + " UNION ALL ".join(f"SELECT role, '{m}' AS maxim, {m} AS p FROM la" for m in MAXIMS) + ") SELECT role, maxim, count(*) AS n, round(avg(p),6)::DOUBLE AS mean_probability, sum(CASE WHEN p>0.5 THEN 1 ELSE 0 END)::BIGINT AS flagged FROM r GROUP BY role, maxim")
def flagship(spark, sf):
    rows = F.array(*[F.struct(F.lit(m).alias("maxim"), F.col(f"{m}.probability").alias("p")) for m in MAXIMS])
    long = H.weak_labels(examples(spark, sf)).select("role", F.explode(rows).alias("x")).select("role", "x.*")
    return long.groupBy("role", "maxim").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_probability"), F.sum(F.when(F.col("p") > 0.5, 1).otherwise(0)).alias("flagged"))


# ---- metrics ---------------------------------------------------------------------------------------------------

_CM = "sum(CASE WHEN y=1 AND p_base>0.5 THEN 1 ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN y=0 AND p_base>0.5 THEN 1 ELSE 0 END)::BIGINT AS fp, sum(CASE WHEN y=1 AND p_base<=0.5 THEN 1 ELSE 0 END)::BIGINT AS fn, sum(CASE WHEN y=0 AND p_base<=0.5 THEN 1 ELSE 0 END)::BIGINT AS tn"


@query("a13_confusion", f"WITH {SQL_SCORES} SELECT maxim, {_CM} FROM sc GROUP BY maxim")
def a13(spark, sf):
    return A.confusion(scores(spark, sf), F.col("y") == 1, F.col("p_base") > 0.5)


_ML = """SELECT maxim, tp, fp, fn, tn, round(p,6) AS precision, round(r,6) AS recall, round(CASE WHEN p+r=0 THEN 0 ELSE 2*p*r/(p+r) END,6) AS f1, round(po,6) AS accuracy, round(CASE WHEN pe=1 THEN (CASE WHEN po=1 THEN 1 ELSE 0 END) ELSE (po-pe)/(1-pe) END,6) AS kappa
 FROM (SELECT *, CASE WHEN tp+fp=0 THEN 0 ELSE tp/(tp+fp) END AS p, CASE WHEN tp+fn=0 THEN 0 ELSE tp/(tp+fn) END AS r, (tp+tn)/(tp+fp+fn+tn) AS po, ((tp+fp)*(tp+fn)+(tn+fn)*(tn+fp))/((tp+fp+fn+tn)*(tp+fp+fn+tn)) AS pe FROM cm)"""


@query("a10_a11_multilabel", f"WITH {SQL_SCORES}, cm AS (SELECT maxim, {_CM} FROM sc GROUP BY maxim) {_ML}")
def a10(spark, sf):
    return A.multilabel(scores(spark, sf), F.col("y") == 1, F.col("p_base") > 0.5)


@query("a08_kappa_overall", f"WITH {SQL_SCORES}, cm AS (SELECT 'overall' AS maxim, {_CM} FROM sc) {_ML}")
def a08(spark, sf):
    return A.multilabel(scores(spark, sf).withColumn("maxim", F.lit("overall")), F.col("y") == 1, F.col("p_base") > 0.5)


@query("a03_class_weights", f"WITH {SQL_SCORES}, c AS (SELECT maxim, sum(y)::BIGINT AS pos, count(*) AS n FROM sc GROUP BY maxim) SELECT maxim, pos, n, CASE WHEN pos>0 AND pos<n THEN round(n/(2*pos),6) ELSE 1.0 END AS w_pos, CASE WHEN pos>0 AND pos<n THEN round(n/(2*(n-pos)),6) ELSE 1.0 END AS w_neg FROM c")
def a03(spark, sf):
    return A.class_weights(scores(spark, sf), F.col("y") == 1)


@query("a21_violation_rates", f"WITH {SQL_SCORES}, r AS (SELECT maxim, avg(CASE WHEN p_base>0.5 THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN p_tuned>0.5 THEN 1.0 ELSE 0.0 END) AS t FROM sc GROUP BY maxim) SELECT maxim, round(b,6) AS base_rate, round(t,6) AS tuned_rate, round(b-t,6) AS absolute, round(CASE WHEN b=0 THEN 0 ELSE (b-t)/b END,6) AS relative FROM r")
def a21(spark, sf):
    return A.rates(scores(spark, sf))


_COOP = "SELECT id, max(CASE WHEN p_base>0.5 THEN 1 ELSE 0 END) AS ab, max(CASE WHEN p_tuned>0.5 THEN 1 ELSE 0 END) AS a_t, avg(CASE WHEN p_base>0.5 THEN 1.0 ELSE 0.0 END) AS rb, avg(CASE WHEN p_tuned>0.5 THEN 1.0 ELSE 0.0 END) AS rt FROM sc GROUP BY id"


@query("a31_cooperation", f"WITH {SQL_SCORES}, o AS ({_COOP}) SELECT round(1-avg(ab),6) AS joint_base, round(1-avg(a_t),6) AS joint_tuned, round(1-avg(rb),6) AS compliance_base, round(1-avg(rt),6) AS compliance_tuned FROM o")
def a31(spark, sf):
    return A.cooperation(scores(spark, sf))


@query("a22_threshold_sweep", f"WITH {SQL_SCORES} SELECT maxim, t::INT AS t, round(avg(CASE WHEN p_base>t/100 THEN 1.0 ELSE 0.0 END),6) AS base_rate, round(avg(CASE WHEN p_tuned>t/100 THEN 1.0 ELSE 0.0 END),6) AS tuned_rate FROM sc, unnest([45,50,55,60,65,70]) AS g(t) GROUP BY maxim, t")
def a22(spark, sf):
    return A.sweep(scores(spark, sf), [45, 50, 55, 60, 65, 70])


@query(
    "a24_best_f1_threshold",
    f"""WITH {SQL_SCORES}, c AS (SELECT maxim, t::INT AS t, sum(CASE WHEN y=1 AND p_base>=t/100 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p_base>=t/100 THEN 1 ELSE 0 END) AS g, sum(y) AS k FROM sc, unnest(range(10,95,5)) AS x(t) GROUP BY maxim, t),
 f AS (SELECT maxim, t, round(CASE WHEN tp=0 THEN 0 ELSE 2*(tp/g)*(tp/k)/((tp/g)+(tp/k)) END,6) AS f1 FROM c) SELECT maxim, t, f1 FROM (SELECT *, row_number() OVER (PARTITION BY maxim ORDER BY f1 DESC, t) AS r FROM f) WHERE r=1""",
)
def a24(spark, sf):
    return A.best_f1_threshold(scores(spark, sf), list(range(10, 95, 5)))


@query("a12_auc", f"WITH {SQL_SCORES}, r AS (SELECT maxim, y, rank() OVER (PARTITION BY maxim ORDER BY p_base) + (count(*) OVER (PARTITION BY maxim, p_base) - 1)/2 AS r FROM sc), g AS (SELECT maxim, sum(CASE WHEN y=1 THEN r ELSE 0 END) AS s, sum(y) AS p, count(*) AS n FROM r GROUP BY maxim) SELECT maxim, round(CASE WHEN p=0 OR p=n THEN 0 ELSE (s-p*(p+1)/2)/(p*(n-p)) END,6) AS auc FROM g")
def a12(spark, sf):
    return A.auc(scores(spark, sf))


@query("a25_a26_score_diagnostics", f"WITH {SQL_SCORES} SELECT maxim, count(*) AS n, round(avg(p_base),6) AS mean, round(stddev_pop(p_base),6) AS std, min(p_base) AS least, max(p_base) AS most, round(quantile_cont(p_base,0.5),6) AS median, round(avg(CASE WHEN p_base>0.4 AND p_base<0.6 THEN 1.0 ELSE 0.0 END),6) AS middle_share, count(DISTINCT p_base) AS n_values, stddev_pop(p_base)<0.1 OR max(p_base)-min(p_base)<0.3 AS compressed, count(DISTINCT p_base)<=10 AS discrete FROM sc GROUP BY maxim")
def a25(spark, sf):
    return A.describe(scores(spark, sf), "p_base", ["maxim"])


@query("a29_histogram", f"WITH {SQL_SCORES} SELECT maxim, (CASE WHEN p_base<0.1 THEN 0 WHEN p_base<0.3 THEN 1 WHEN p_base<0.5 THEN 2 WHEN p_base<0.7 THEN 3 WHEN p_base<0.9 THEN 4 ELSE 5 END)::INT AS bin, count(*) AS n FROM sc GROUP BY 1, 2")
def a29(spark, sf):
    return A.histogram(scores(spark, sf), "p_base", [0, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0], ["maxim"])


@query("a14_a15_mcnemar", f"WITH {SQL_SCORES}, c AS (SELECT maxim, sum(CASE WHEN p_base>0.5 AND p_tuned>0.5 THEN 1 ELSE 0 END)::BIGINT AS both, sum(CASE WHEN p_base>0.5 AND p_tuned<=0.5 THEN 1 ELSE 0 END)::BIGINT AS base_only, sum(CASE WHEN p_base<=0.5 AND p_tuned>0.5 THEN 1 ELSE 0 END)::BIGINT AS tuned_only, sum(CASE WHEN p_base<=0.5 AND p_tuned<=0.5 THEN 1 ELSE 0 END)::BIGINT AS neither FROM sc GROUP BY maxim) SELECT *, round(CASE WHEN base_only+tuned_only=0 THEN 0 ELSE pow(abs(base_only-tuned_only)-1,2)/(base_only+tuned_only) END,6) AS chi2 FROM c")
def a15(spark, sf):
    return A.mcnemar(scores(spark, sf)).drop("p_value")


@query("a15_mcnemar_p_value")
def a15p(spark, sf):
    return A.mcnemar(scores(spark, sf)).select("maxim", F.round("p_value", 6).alias("p_value"))


@query("a33_cooccurrence", f"WITH {SQL_SCORES}, h AS (SELECT id, maxim FROM sc WHERE p_base>0.5) SELECT x.maxim AS a, y.maxim AS b, count(*) AS n FROM h x JOIN h y USING (id) GROUP BY 1, 2")
def a33(spark, sf):
    return A.cooccurrence(scores(spark, sf))


def sql_weights(ids: str) -> str:
    """CTE wt (id, b, w): the weights of bootstrap.weights() for the ids of a table."""
    number = lambda key: f"('0x'||substr(md5({key}::VARCHAR||'|{B.SALT}'),1,8))::BIGINT % {B.PRIME - 1} + 1"
    reached = "+".join(f"(x>={limit})::INT" for limit in B.limits())
    return f"""wt AS (SELECT id, b, {reached} AS w FROM (SELECT id, b, ((r*c)%{B.PRIME}*((r*c)%{B.PRIME})+r)%{B.PRIME} AS x FROM
 (SELECT DISTINCT id, {number('id')} AS r FROM {ids}), (SELECT b, {number('b')} AS c FROM range({B.RESAMPLES}) AS g(b))))"""


@query("a16_bootstrap_mean", f"WITH {SQL_SCORES}, {sql_weights('sc')}, m AS (SELECT maxim, b, sum(w*p_base)/nullif(sum(w),0) AS m FROM sc JOIN wt USING (id) GROUP BY maxim, b) SELECT maxim, round(quantile_cont(m,0.025),6) AS low, round(avg(m),6) AS mean, round(quantile_cont(m,0.975),6) AS high FROM m GROUP BY maxim")
def a16(spark, sf):
    """Intervals of 10,000 resamples."""
    return B.mean_interval(scores(spark, sf), "p_base", ["maxim"])


@query("a01_length_percentiles", "WITH l AS (SELECT len(regexp_extract_all(text,'\\S+')) AS n, row_number() OVER (ORDER BY len(regexp_extract_all(text,'\\S+')))-1 AS k FROM conversations), c AS (SELECT count(*) AS total FROM l) SELECT p::INT AS p, n AS value FROM c, unnest([10,25,50,75,90,95,99]) AS g(p), l WHERE l.k = floor(total*p/100)")
def a01(spark, sf):
    return A.index_percentiles(turns(spark, sf).select(T.n_words(F.col("text")).alias("n")), "n", [10, 25, 50, 75, 90, 95, 99])


@query("a01_profile", "SELECT role, count(*) AS n, round(avg(len(regexp_extract_all(text,'\\S+'))),6) AS mean, round(stddev_samp(len(regexp_extract_all(text,'\\S+'))),6) AS std, count(DISTINCT conv_id) AS n_conversations FROM conversations GROUP BY role")
def a01b(spark, sf):
    n = T.n_words(F.col("text"))
    return turns(spark, sf).groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("std"), F.count_distinct("conv_id").alias("n_conversations"))


@query("a42_latency_profile", "SELECT event_type, count(*) AS n, round(avg(value),6) AS mean, round(stddev_pop(value),6) AS std, round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.95),6) AS p95, round(quantile_cont(value,0.99),6) AS p99, min(value) AS least, max(value) AS most, round(count(value)/nullif(sum(value)/1000,0),6) AS per_second FROM events GROUP BY event_type")
def a42(spark, sf):
    """Latencies in milliseconds by type, and how many samples a second they come to one after another."""
    return A.latency_profile(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value")


# ---- pairs -----------------------------------------------------------------------------------------------------


@query("x21_margins", f"WITH {SQL_PAIRS} SELECT {_M} FROM pr")
def x21(spark, sf):
    return preference_pairs(spark, sf).select(*_M.split(", "))


@query("p10_strict_margins", f"WITH {SQL_PAIRS} SELECT {_M} FROM pr WHERE m_quantity>0 AND m_quality>0 AND m_relation>0 AND m_manner>0")
def p10(spark, sf):
    return P.strict(preference_pairs(spark, sf)).select(*_M.split(", "))


@query("p11_relaxed_margins", f"WITH {SQL_PAIRS} SELECT {_M} FROM pr WHERE m_quantity>0 AND m_quality>0 AND m_relation>0 AND m_manner>-0.1")
def p11(spark, sf):
    return P.relaxed(preference_pairs(spark, sf)).select(*_M.split(", "))


_REASON = "CASE " + " ".join(f"WHEN m_{m}<0.15 THEN (CASE WHEN m_{m}<0 THEN '{m}_negative' ELSE 'weak_signal' END)" for m in MAXIMS) + " END"


@query("p12_reject_reasons", f"WITH {SQL_PAIRS} SELECT coalesce({_REASON},'kept') AS reason, count(*) AS n FROM pr GROUP BY 1")
def p12(spark, sf):
    return preference_pairs(spark, sf).groupBy(F.coalesce(P.reject_reason(), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("p13_average_margin", f"WITH {SQL_PAIRS} SELECT {_M} FROM pr WHERE avg_margin>0.05")
def p13(spark, sf):
    return preference_pairs(spark, sf).where("avg_margin > 0.05").select(*_M.split(", "))


@query("p14_conflicts", f"WITH {SQL_PAIRS} SELECT id, (CASE WHEN m_relation>0.15 AND m_manner<-0.15 THEN 1 WHEN m_manner>0.15 AND m_relation<-0.15 THEN 2 ELSE 0 END)::INT AS conflict FROM pr")
def p14(spark, sf):
    return preference_pairs(spark, sf).select("id", P.conflict().alias("conflict"))


@query("p16_problem_pairs", f"WITH {SQL_PAIRS} SELECT {_M} FROM pr WHERE m_manner<-0.1 AND (m_relation>0.1 OR m_quantity>0.1)")
def p16(spark, sf):
    return preference_pairs(spark, sf).where(P.problem()).select(*_M.split(", "))


_INV = "(CASE WHEN m_quantity<0 THEN 1 ELSE 0 END + CASE WHEN m_quality<0 THEN 1 ELSE 0 END + CASE WHEN m_relation<0 THEN 1 ELSE 0 END + CASE WHEN m_manner<0 THEN 1 ELSE 0 END) >= 3"


@query("p17_fix_inverted", f"WITH {SQL_PAIRS}, s AS (SELECT *, {_INV} AS swapped FROM pr) SELECT id, swapped, md5(CASE WHEN swapped THEN rejected ELSE chosen END) AS chosen, CASE WHEN swapped THEN -avg_margin ELSE avg_margin END AS avg_margin FROM s WHERE NOT swapped OR -avg_margin > 0.05")
def p17(spark, sf):
    return P.fix_inverted(preference_pairs(spark, sf)).select("id", "swapped", F.md5("chosen").alias("chosen"), "avg_margin")


@query("p20_failed_pairs_to_redo", f"WITH {SQL_PAIRS} SELECT id FROM pr WHERE NOT (m_quantity>0 AND m_quality>0 AND m_relation>0 AND m_manner>0) AND conv_id NOT IN (SELECT conv_id FROM conversations WHERE conv_id % 3 = 0)")
def p20(spark, sf):
    pairs = preference_pairs(spark, sf)
    failed = pairs.join(P.strict(pairs).select("id"), "id", "left_anti")
    done = turns(spark, sf).where("conv_id % 3 = 0").select("conv_id").distinct()
    return failed.join(done, "conv_id", "left_anti").select("id")


@query("a27_margin_quality", f"WITH {SQL_PAIRS}, l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS maxim, m_{m} AS v FROM pr" for m in MAXIMS) + ") SELECT maxim, round(avg(v),6) AS mean, round(avg(CASE WHEN v>0 THEN 1.0 ELSE 0.0 END),6) AS positive, round(avg(CASE WHEN abs(v)>0.2 THEN 1.0 ELSE 0.0 END),6) AS clear, round(avg(CASE WHEN abs(v)<0.1 THEN 1.0 ELSE 0.0 END),6) AS weak FROM l GROUP BY maxim")
def a27(spark, sf):
    return P.quality(preference_pairs(spark, sf))


@query("a30_best_maxim", f"WITH {SQL_PAIRS} SELECT CASE greatest(m_quantity,m_quality,m_relation,m_manner) WHEN m_quantity THEN 'quantity' WHEN m_quality THEN 'quality' WHEN m_relation THEN 'relation' ELSE 'manner' END AS best, count(*) AS n FROM pr GROUP BY 1")
def a30(spark, sf):
    return preference_pairs(spark, sf).groupBy(P.best_maxim().alias("best")).agg(F.count("*").alias("n"))


# ---- sampling, dedup, sets -------------------------------------------------------------------------------------


@query("t01_top_errors", f"WITH {SQL_SCORES}, e AS (SELECT id, maxim, p_base, CASE WHEN p_base>0.5 THEN 'fp' ELSE 'fn' END AS err FROM sc WHERE (y=0 AND p_base>0.5) OR (y=1 AND p_base<=0.5)) SELECT id, maxim, err, p_base, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY maxim, err ORDER BY CASE WHEN err='fp' THEN -p_base ELSE p_base END, id)::INT AS r FROM e) WHERE r<=5")
def t01(spark, sf):
    s = scores(spark, sf)
    err = F.when((F.col("y") == 0) & (F.col("p_base") > 0.5), "fp").when((F.col("y") == 1) & (F.col("p_base") <= 0.5), "fn")
    w = Window.partitionBy("maxim", "err").orderBy(F.when(F.col("err") == "fp", -F.col("p_base")).otherwise(F.col("p_base")), "id")
    return s.withColumn("err", err).where("err is not null").withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("id", "maxim", "err", "p_base", "rank")


@query("t02_hash_dedup", "SELECT min(doc_id) AS doc_id, h FROM (SELECT doc_id, substr(md5(regexp_replace(regexp_replace(lower(text),'\\s+',' ','g'),'^\\s+|\\s+$','','g')),1,16) AS h FROM documents) GROUP BY h")
def t02(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", T.norm_hash(F.col("text")).alias("h"))
    return S.keep_first(d, F.col("h"), "doc_id")


@query("t03_every_nth", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id)-1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE n<=20 OR (k % greatest(n//20,1) = 0 AND k//greatest(n//20,1) < 20)")
def t03(spark, sf):
    return S.every_nth(table(spark, sf, "documents").select("doc_id", "source"), ["source"], "doc_id", 20)


@query("t04_conversation_split", "WITH c AS (SELECT DISTINCT conv_id FROM conversations), r AS (SELECT conv_id, row_number() OVER (ORDER BY md5(conv_id::VARCHAR||'|split'), conv_id) AS k, count(*) OVER () AS n FROM c) SELECT conv_id, CASE WHEN k<=floor(n*0.8) THEN 'train' WHEN k<=floor(n*0.8)+floor(n*0.1) THEN 'val' ELSE 'test' END AS split FROM r")
def t04(spark, sf):
    return S.stratified_split(turns(spark, sf).select("conv_id").distinct(), [], "conv_id", "split").select("conv_id", "split")


@query("t04_hashed_split", "SELECT conv_id, CASE WHEN u<80 THEN 'train' WHEN u<90 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT conv_id, ('0x'||substr(md5(conv_id::VARCHAR||'|split'),1,8))::BIGINT % 100 AS u FROM conversations)")
def t04h(spark, sf):
    return turns(spark, sf).select("conv_id", S.hashed_split("conv_id", "split").alias("split")).distinct()


@query("t06_stratified_split", "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id::VARCHAR||'|s'), doc_id) AS k, count(*) OVER (PARTITION BY lang, source) AS n FROM documents) SELECT doc_id, CASE WHEN k<=floor(n*0.8) THEN 'train' WHEN k<=floor(n*0.8)+floor(n*0.1) THEN 'val' ELSE 'test' END AS split FROM r")
def t06(spark, sf):
    return S.stratified_split(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", "s").select("doc_id", "split")


@query("t08_balanced_sample", "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR||'|balance'), doc_id) AS k FROM documents) WHERE k<=50")
def t08(spark, sf):
    return S.per_group(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], 50, "doc_id", "balance")


@query("t13_oversample", "SELECT doc_id, quality, c::INT AS copy FROM labels, unnest([1,2,3,4,5]) AS g(c)")
def t13(spark, sf):
    return S.oversample(table(spark, sf, "labels").select("doc_id", "quality"), 5)


@query("t17_blinding", "SELECT id, row_number() OVER (ORDER BY md5(id::VARCHAR||'|blind'), id)-1 AS sample_id FROM (SELECT conv_id*1000+turn AS id FROM conversations WHERE role='assistant')")
def t17(spark, sf):
    # ranks of hash prefixes first, then inside a prefix: no task sorts everything
    t = turns(spark, sf).where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id")).withColumn("h", S.order_key("id", "blind")).withColumn("p", F.substring("h", 1, 3))
    sizes = t.groupBy("p").agg(F.count("*").alias("n"))  # at most 4096 rows
    base = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    return t.join(F.broadcast(base), "p").select("id", (F.col("before") + F.row_number().over(Window.partitionBy("p").orderBy("h", "id")) - 1).alias("sample_id"))


@query("j06_split_leakage", "SELECT h FROM (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 10 < 8 INTERSECT SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 10 >= 8)")
def j06(spark, sf):
    d = table(spark, sf, "documents").select((F.col("doc_id") % 10).alias("k"), F.md5("text").alias("h"))
    return d.where("k < 8").select("h").intersect(d.where("k >= 8").select("h"))


@query("j01_labels_outer", "SELECT d.doc_id, coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j01(spark, sf):
    l = table(spark, sf, "labels")
    return table(spark, sf, "documents").select("doc_id").join(l, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(0)).alias("quality"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


@query("j09_nearest", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.v, e.v),6) AS score FROM e q, e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) SELECT query_id, vec_id, r AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS r FROM s) WHERE r<=10")
def j09(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return R.top_k(e.where("vec_id % 50 = 0"), e)


@query("a35_mrr", "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, q.label AS ql, e.label AS el, e.vec_id, round(list_cosine_similarity(q.v, e.v),6) AS score FROM e q, e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s), f AS (SELECT query_id, min(CASE WHEN ql=el AND r<=10 THEN r END) AS r FROM t GROUP BY query_id) SELECT count(*) AS n, round(avg(coalesce(1/r,0)),6) AS mrr, round(avg(CASE WHEN r<=1 THEN 1.0 ELSE 0.0 END),6) AS hit1, round(avg(CASE WHEN r<=10 THEN 1.0 ELSE 0.0 END),6) AS hit10 FROM f")
def a35(spark, sf):
    e = table(spark, sf, "embeddings")
    label = e.select("vec_id", "label")
    top = R.top_k(e.where("vec_id % 50 = 0").select("vec_id", "embedding"), e.select("vec_id", "embedding"))
    near = top.join(label, "vec_id").join(label.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id")
    first = near.groupBy("query_id").agg(F.min(F.when(F.col("label") == F.col("want"), F.col("rank"))).alias("r"))
    hit = lambda k: F.round(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6)
    return first.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"), hit(1).alias("hit1"), hit(10).alias("hit10"))


@query("u01_union_sources", "SELECT 'dialogue' AS source, count(*) AS n FROM conversations UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark")
def u01(spark, sf):
    parts = [table(spark, sf, t).select(F.lit(n).alias("source"), "text") for t, n in (("conversations", "dialogue"), ("documents", "documents"), ("benchmark", "benchmark"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count("*").alias("n"))


@query("a41_uncertainty_top", f"WITH {SQL_PAIRS}, f AS (SELECT id, length(chosen) AS a, length(rejected) AS b, list_distinct(regexp_extract_all(lower(chosen),'\\S+')) AS x, list_distinct(regexp_extract_all(lower(rejected),'\\S+')) AS y FROM pr), g AS (SELECT id, round(((1-coalesce(abs(a-b)/nullif(greatest(a,b),0),0)) + coalesce(len(list_intersect(x,y))/nullif(len(list_distinct(list_concat(x,y))),0),0))/2, 6) AS u FROM f) SELECT id, u FROM g ORDER BY u DESC, id LIMIT 500")
def a41(spark, sf):
    return preference_pairs(spark, sf).select("id", P.uncertainty("chosen", "rejected").alias("u")).orderBy(F.col("u").desc(), "id").limit(500)


# ---- repeatable violation makers -------------------------------------------------------------------------------


@query("i10_runon", f"SELECT conv_id, turn, md5(array_to_string(list_transform(s, lambda x: regexp_replace(x,'[.!?]+$','')),' ')) AS violated FROM (SELECT conv_id, turn, {_sent('text')} AS s FROM conversations) WHERE len(s)>=2")
def i10(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.md5(T.runon(F.col("text"))).alias("violated")).where("violated is not null")


@query("i18a_repeat_point", "SELECT conv_id, turn, md5(f||'. '||replace(lower(f),'is','remains')||'. In other words, '||lower(f)||'. '||text) AS violated FROM (SELECT *, string_split(text,'.')[1] AS f FROM conversations)")
def i18a(spark, sf):
    f, t = T.first_piece(F.col("text")), F.col("text")
    made = F.concat(f, F.lit(". "), F.replace(F.lower(f), F.lit("is"), F.lit("remains")), F.lit(". In other words, "), F.lower(f), F.lit(". "), t)
    return turns(spark, sf).select("conv_id", "turn", F.md5(made).alias("violated"))


@query("i18c_excessive_examples", "SELECT conv_id, turn, md5(text||' For example, this happens often. Another example is when it occurs daily. Yet another case is in various situations.') AS violated FROM conversations")
def i18c(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.md5(F.concat("text", F.lit(" For example, this happens often. Another example is when it occurs daily. Yet another case is in various situations."))).alias("violated"))


@query("i20e_passive_voice", "SELECT conv_id, turn, md5('It should be noted that '||lower(substr(text,1,1))||substr(text,2)) AS violated FROM conversations")
def i20e(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.md5(F.concat(F.lit("It should be noted that "), T.lower_first(F.col("text")))).alias("violated"))


@query("i21b_partial_answer", "SELECT conv_id, turn, md5('Well, a related point is that things are complex. '||string_split(text,'.')[1]) AS violated FROM conversations")
def i21b(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.md5(F.concat(F.lit("Well, a related point is that things are complex. "), T.first_piece(F.col("text")))).alias("violated"))


_EDGE = "[^\\p{L}\\p{M}\\p{N}_]"  # DuckDB's \b knows ASCII words only
_STEPS = ", ".join(f"{{'t': '', 'n': 0, 'f': '(?i)(^|{_EDGE}){a}($|{_EDGE})', 'r': '\\1{b}\\2'}}" for a, b in T.JARGON)


@query("i09_jargon", f"SELECT conv_id, turn, md5(list_reduce([{{'t': text, 'n': 0, 'f': '', 'r': ''}}, {_STEPS}], lambda a, x: CASE WHEN a.n<3 AND regexp_matches(a.t, x.f) THEN {{'t': regexp_replace(a.t, x.f, x.r), 'n': a.n+1, 'f': '', 'r': ''}} ELSE a END).t) AS violated FROM conversations")
def i09(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.md5(T.jargon(F.col("text"))).alias("violated"))


_ALL = "text"
for _a, _b in T.JARGON_ALL:
    _ALL = f"regexp_replace({_ALL}, '(?i)(^|{_EDGE}){_a}($|{_EDGE})', '\\1{_b}\\2', 'g')"


@query("i20d_jargon_all", f"SELECT conv_id, turn, md5({_ALL}) AS violated FROM conversations")
def i20d(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", F.md5(T.jargon_all(F.col("text"))).alias("violated"))


@query("h02_h05_h10_votes", f"WITH {SQL_VOTES} SELECT conv_id, turn, round(rd,6)::DOUBLE AS redundancy, round(en,6)::DOUBLE AS entities, round(ap,6)::DOUBLE AS pronouns FROM vo")
def votes(spark, sf):
    own, r, _, e = H.prepare(examples(spark, sf))
    v = {"redundancy": H.redundancy(r), "entities": H.entity_consistency(r, e), "pronouns": H.ambiguous_pronouns(r)}
    return own.select("conv_id", "turn", *(F.round(c["score"], 6).alias(n) for n, c in v.items()))


def _most(g: str) -> str:
    return f"coalesce(list_max(list_transform(list_distinct({g}), lambda y: len(list_filter({g}, lambda z: z=y)))),0)"


def sql_degenerate(c: str, w: str, g: str) -> str:
    return f"(length(regexp_replace({c},'^\\s+|\\s+$','','g'))<8 OR regexp_matches({c},'!{{3,}}|\\?{{3,}}|,{{3,}}|\\.{{3,}}|;{{3,}}|:{{3,}}|-{{3,}}') OR (length({c})-length(replace({c},'!','')))/greatest(len({w}),1)>0.15 OR len(list_filter({w}, lambda x: regexp_matches(x,'^[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]+$')))/greatest(len({w}),1)>0.20 OR {_most(g)}>2)"


_CLEAN = "text"
for _a, _b in ((r"([\p{L}\p{M}\p{N}_])!+", r"\1"), (" !+ ", " "), ("!{2,}", "!"), (r"\s+([.,!?;:])", r"\1"), (r"\.([A-Z])", r". \1"), (" {2,}", " ")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_a}', '{_b}', 'g')"
_TEXTS = f"SELECT conv_id, turn, role, text, w, lw, {_grams('w')} AS g FROM (SELECT *, regexp_extract_all(text,'\\S+') AS w, regexp_extract_all(lower(text),'\\S+') AS lw FROM conversations)"


@query("x13_x14_artifacts", f"SELECT conv_id, turn, (len(w)>=5 AND len(list_filter(w, lambda x: x LIKE '%!'))/greatest(len(w),1)>0.25) AS word_bang, {sql_degenerate('text', 'w', 'g')} AS degenerate, (length(text)-length(replace(text,'?',''))<=2 AND len(w) BETWEEN 10 AND 150 AND (len(w)<=10 OR {_most('lw')}<=0.3*len(w)) AND list_sum(list_transform(w, lambda x: length(x)))/greatest(len(w),1)>=3) AS quality, md5({_CLEAN}) AS cleaned FROM ({_TEXTS})")
def x14(spark, sf):
    t = F.col("text")
    return turns(spark, sf).select("conv_id", "turn", T.word_bang(t).alias("word_bang"), T.is_degenerate(t).alias("degenerate"), T.quality_response(t).alias("quality"), F.md5(T.clean_artifacts(t)).alias("cleaned"))


# ---- more metrics, samples and pairs ---------------------------------------------------------------------------

_SYS = "sy AS (SELECT id, maxim, 'base' AS system, p_base AS p FROM sc UNION ALL SELECT id, maxim, 'tuned', p_tuned FROM sc)"


def system_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = F.explode(F.array(F.struct(F.lit("base").alias("system"), F.col("p_base").alias("p")), F.struct(F.lit("tuned").alias("system"), F.col("p_tuned").alias("p"))))
    return scores(spark, sf).select("id", "maxim", s.alias("s")).select("id", "maxim", "s.*")


@query("a02_distribution", "SELECT source, count(*) AS n, round(100.0*count(*)/sum(count(*)) OVER (),6) AS pct FROM documents GROUP BY source")
def a02(spark, sf):
    c = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("a04_a05_weights", f"WITH {SQL_SCORES}, c AS (SELECT maxim, sum(y)::BIGINT AS pos, count(*) AS n FROM sc GROUP BY maxim) SELECT maxim, CASE WHEN pos=0 THEN 1.0 ELSE round(n/2/pos,6) END AS filter_weight, round((n-pos)/(pos+1e-6),6) AS pos_weight FROM c")
def a04(spark, sf):
    pos, n = F.col("pos"), F.col("n")
    c = scores(spark, sf).groupBy("maxim").agg(F.sum("y").alias("pos"), F.count("*").alias("n"))
    return c.select("maxim", F.when(pos == 0, 1.0).otherwise(F.round(n / 2 / pos, 6)).alias("filter_weight"), F.round((n - pos) / (pos + F.lit(1e-6)), 6).alias("pos_weight"))


@query("a19_system_comparison", f"WITH {SQL_SCORES}, {_SYS} SELECT system, maxim, round(avg(p),6) AS mean, round(stddev_pop(p),6) AS std, count(*) AS n FROM sy GROUP BY system, maxim")
def a19(spark, sf):
    return system_scores(spark, sf).groupBy("system", "maxim").agg(F.round(F.avg("p"), 6).alias("mean"), F.round(F.stddev_pop("p"), 6).alias("std"), F.count("*").alias("n"))


@query("a20_mann_whitney", f"WITH {SQL_SCORES}, {_SYS}, r AS (SELECT maxim, system, rank() OVER (PARTITION BY maxim ORDER BY p) + (count(*) OVER (PARTITION BY maxim, p) - 1)/2 AS r FROM sy), g AS (SELECT maxim, count(*) FILTER (system='base') AS n_first, count(*) FILTER (system='tuned') AS n_second, sum(r) FILTER (system='base') AS s FROM r GROUP BY maxim) SELECT maxim, n_first, n_second, (s - n_first*(n_first+1)/2)::DOUBLE AS u FROM g")
def a20(spark, sf):
    return A.mann_whitney(system_scores(spark, sf), "maxim", "p", "system", "base", "tuned")


@query("a36_relevance_summary", f"WITH {SQL_SCORES} SELECT maxim, round(avg(p_tuned),6) AS mean, round(stddev_pop(p_tuned),6) AS std, min(p_tuned)::DOUBLE AS least, max(p_tuned)::DOUBLE AS most, round(avg(p_tuned-p_base),6) AS improvement, round(100*avg(CASE WHEN p_tuned>p_base THEN 1.0 ELSE 0.0 END),6) AS pct_improved FROM sc GROUP BY maxim")
def a36(spark, sf):
    new, gain = F.col("p_tuned"), F.col("p_tuned") - F.col("p_base")
    better = F.avg(F.when(F.col("p_tuned") > F.col("p_base"), 1.0).otherwise(0.0))
    cols = [F.round(F.avg(new), 6).alias("mean"), F.round(F.stddev_pop(new), 6).alias("std"), F.min(new).alias("least"), F.max(new).alias("most"), F.round(F.avg(gain), 6).alias("improvement"), F.round(100 * better, 6).alias("pct_improved")]
    return scores(spark, sf).groupBy("maxim").agg(*cols)


@query("a37_quantity_clarity", "WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(coalesce(text,'')),'\\S+') AS w FROM conversations WHERE role='assistant') SELECT conv_id, turn, CASE WHEN len(w)<15 THEN 0.5 WHEN len(w)<=150 THEN 1.0 ELSE 0.7 END::DOUBLE AS quantity, CASE WHEN len(w)=0 THEN 0 ELSE round(least(1,1.2*len(list_distinct(w))/len(w)),6) END::DOUBLE AS clarity FROM w")
def a37(spark, sf):
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\S+)"), F.lit(1))
    t = turns(spark, sf).where("role = 'assistant'").select("conv_id", "turn", F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))
    quantity = F.when(F.col("n") < 15, 0.5).when(F.col("n") <= 150, 1.0).otherwise(0.7)
    clarity = F.when(F.col("n") == 0, 0.0).otherwise(F.round(F.least(F.lit(1.0), 1.2 * F.col("d") / F.col("n")), 6))
    return t.select("conv_id", "turn", quantity.alias("quantity"), clarity.alias("clarity"))


@query("t07_t14_holdout", "SELECT doc_id, k <= greatest(n*15//100,1) AS held_out FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR||'|hold'), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def t07(spark, sf):
    return S.holdout(table(spark, sf, "documents").select("doc_id", "source"), ["source"], 15, "doc_id", "hold").select("doc_id", "held_out")


_CLASS = "SELECT doc_id, CASE WHEN toxic=1 THEN 'harmful' WHEN quality=0 THEN 'poor' ELSE 'good' END AS class FROM labels"


def _classes(spark, sf):
    return table(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "harmful").when(F.col("quality") == 0, "poor").otherwise("good").alias("class"))


def _balanced(share: str) -> str:
    return f"WITH l AS ({_CLASS}), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(doc_id::VARCHAR||'|ratio'), doc_id) AS k, {share} AS s FROM l), t AS (SELECT min(c*100//s) AS total FROM (SELECT s, count(*) AS c FROM r GROUP BY class, s)) SELECT doc_id, class FROM r, t WHERE k <= total*s//100"


@query("t09_ratio_balance", _balanced("CASE class WHEN 'good' THEN 40 ELSE 30 END"))
def t09(spark, sf):
    return S.balance_to_ratio(_classes(spark, sf), "class", {"good": 40, "poor": 30, "harmful": 30}, "doc_id", "ratio")


@query("t10_balance_to_least", _balanced("100"))
def t10(spark, sf):
    return S.balance_to_ratio(_classes(spark, sf), "class", {"good": 100, "poor": 100, "harmful": 100}, "doc_id", "ratio")


_NEXT = "SELECT conv_id*1000+turn AS id, text AS chosen, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS rejected FROM conversations WHERE role='assistant'"


@query("t16_pair_dedup", f"SELECT min(id) AS id, chosen, rejected FROM ({_NEXT}) WHERE rejected IS NOT NULL GROUP BY chosen, rejected")
def t16(spark, sf):
    return S.keep_first(preference_pairs(spark, sf).select("id", "chosen", "rejected"), F.struct("chosen", "rejected"), "id")


@query("j02_unblinding", "SELECT source, count(*) AS n, round(avg(quality),6) AS mean_quality FROM labels JOIN documents USING (doc_id) GROUP BY source")
def j02(spark, sf):
    r = table(spark, sf, "labels").select("doc_id", "quality").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return r.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("mean_quality"))


@query("j11_response_pairs", "WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role='assistant') SELECT a.conv_id, chr((64+a.k)::INT)||chr((64+b.k)::INT) AS pair, a.text AS first, b.text AS second FROM r a JOIN r b ON a.conv_id=b.conv_id AND a.k<b.k AND b.k<=3")
def j11(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    r = turns(spark, sf).where("role = 'assistant'").withColumn("k", F.row_number().over(w)).where("k <= 3")
    said = [F.max(F.when(F.col("k") == k, F.struct("text"))).alias(c) for k, c in enumerate("ABC", 1)]
    pairs = F.array(*(F.struct(F.lit(x + y).alias("pair"), F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("AB", "BC", "AC")))
    return r.groupBy("conv_id").agg(*said).select("conv_id", F.explode(pairs).alias("p")).where("p.b is not null").select("conv_id", "p.pair", F.col("p.a.text").alias("first"), F.col("p.b.text").alias("second"))


@query("x19_match", f"WITH p AS (SELECT id, lower(chosen) AS a, lower(rejected) AS b FROM ({_NEXT}) WHERE rejected IS NOT NULL), w AS (SELECT *, list_distinct(regexp_extract_all(a,'\\S+')) AS wa, list_distinct(regexp_extract_all(b,'\\S+')) AS wb FROM p) SELECT id, a=b AS exact, contains(a,b) OR contains(b,a) AS close, CASE WHEN len(wb)=0 THEN 0 ELSE round(len(list_intersect(wa,wb))/len(wb),6) END::DOUBLE AS overlap FROM w")
def x19(spark, sf):
    p = preference_pairs(spark, sf).select("id", F.lower("chosen").alias("a"), F.lower("rejected").alias("b"))
    a, b = (F.array_distinct(F.regexp_extract_all(F.col(c), F.lit(r"(\S+)"), F.lit(1))) for c in "ab")
    overlap = F.when(F.size(b) == 0, 0.0).otherwise(F.round(F.size(F.array_intersect(a, b)) / F.size(b), 6))
    return p.select("id", (F.col("a") == F.col("b")).alias("exact"), (F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))).alias("close"), overlap.alias("overlap"))
