"""Queries of retrieval: nearest rows through an index of vectors, and responses found by their texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import SQL_EXAMPLES, SQL_SCORES, _kw, query, scores, sql_degenerate, turns
from .operators import examples as E
from .operators import pairs as P
from .operators import text_retrieval as X
from .operators import vector_index as V
from .sources.tables import shared_path, table

_PAIRS = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, round(list_cosine_similarity(q.v, e.v),6) AS score FROM e q, e WHERE q.vec_id <> e.vec_id{0})"


def _index(spark, sf: str) -> str:
    path = shared_path(spark, "index")
    V.write_index(table(spark, sf, "embeddings"), path, metadata=["label"])
    return path


@query("k04_index_rows", "SELECT vec_id, label, len(embedding)::INT AS size, 16::INT AS code_bytes FROM embeddings")
def k04i(spark, sf):
    """Every row is in one cell of the written index, with its code."""
    rows = V.read_rows(spark, _index(spark, sf)).where("cell is not null")
    return rows.select(F.col("id").alias("vec_id"), "label", F.size("v").alias("size"), F.octet_length("code").alias("code_bytes"))


@query("j09_index_search", f"WITH {_PAIRS.format('')} SELECT query_id, vec_id, r AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS r FROM s) WHERE r<=10")
def j09i(spark, sf):
    """The ten nearest others of every row, through the index with all cells probed."""
    return V.search(table(spark, sf, "embeddings"), _index(spark, sf)).select("query_id", "vec_id", "rank", "score")


@query("n05_retrieve", f"WITH {_PAIRS.format(' AND q.vec_id % 50 = 0')} SELECT query_id, vec_id, label, r AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS r FROM s WHERE score>=0.3) WHERE r<=5")
def n05r(spark, sf):
    """Up to five answers of at least 0.3 a query, with rank, score and metadata."""
    e = table(spark, sf, "embeddings")
    return V.search(e.where("vec_id % 50 = 0"), _index(spark, sf), k=5, least=0.3, metadata=["label"])


_ID = "conv_id*1000+turn"


def sql_answers(queries: str, least: float) -> str:
    """CTEs up to bt (id, answer_id, score), by brute force over all pairs; queries: a table (id, owner, text)."""
    return f"""ka AS (SELECT {_ID} AS id, conv_id AS owner, list_distinct({_kw('text')}) AS ws FROM conversations WHERE role='assistant'),
 aw AS (SELECT id, owner, unnest(ws) AS word FROM ka), qw AS (SELECT id, owner, unnest(list_distinct({_kw('text')})) AS word FROM {queries}),
 fr AS (SELECT word, pow(ln((total+1)/(n+1)+1),2) AS sq FROM (SELECT word, count(*) AS n FROM aw GROUP BY word), (SELECT count(*) AS total FROM ka WHERE len(ws)>0)),
 ql AS (SELECT id, sqrt(sum(sq)) AS l FROM qw JOIN fr USING (word) GROUP BY id), al AS (SELECT id, sqrt(sum(sq)) AS l FROM aw JOIN fr USING (word) GROUP BY id),
 ap AS (SELECT q.id AS id, a.id AS answer_id, sum(sq) AS s FROM qw q JOIN aw a ON q.word=a.word AND q.owner<>a.owner JOIN fr ON fr.word=q.word GROUP BY 1, 2),
 ax AS (SELECT ap.id, answer_id, round(s/(ql.l*al.l),6) AS score FROM ap JOIN ql ON ql.id=ap.id JOIN al ON al.id=answer_id),
 bt AS (SELECT id, answer_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, answer_id) AS r FROM ax WHERE score>={least}) WHERE r=1)"""


SQL_CONTEXTS = SQL_EXAMPLES.replace("WHERE len(w) >= 5", "WHERE role='assistant'") + f", cq AS (SELECT {_ID} AS id, conv_id AS owner, context_text AS text, response FROM ex)"


def contexts(spark, sf):
    """id, owner, text (the turns before) and response of every assistant turn."""
    rows = E.extract_examples(turns(spark, sf), least_words=0).where("role = 'assistant'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("owner"), F.col("context_text").alias("text"), "response")


def responses(spark, sf):
    return turns(spark, sf).where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("owner"), "text")


@query("n04_text_retrieval", f"WITH {SQL_CONTEXTS}, {sql_answers('cq', 0.1)} SELECT * FROM bt")
def n04t(spark, sf):
    """For every assistant turn the response of another conversation that its context resembles most, from 0.1 on (the
    invented words of the tables seldom agree better)."""
    return X.best_answers(contexts(spark, sf), responses(spark, sf), 0.1)


_WAY = "CASE WHEN len(v)=0 THEN 'none' WHEN list_contains(v,'relation') THEN 'retrieve' ELSE 'edit' END"


@query(
    "n04_repair_router",
    f"WITH {SQL_SCORES}, {SQL_CONTEXTS}, f AS (SELECT id, list_filter(list(CASE WHEN p_base>0.6 THEN maxim END), lambda x: x IS NOT NULL) AS v FROM sc GROUP BY id), wy AS (SELECT id, {_WAY} AS way FROM f), rq AS (SELECT cq.* FROM cq JOIN wy USING (id) WHERE way='retrieve'), {sql_answers('rq', 0.3)}, "
    f"w AS (SELECT wy.id, way, response AS text, CASE WHEN way='retrieve' THEN c.text WHEN way='edit' THEN (CASE WHEN wy.id%3=0 THEN 'OK' WHEN wy.id%3=1 THEN 'It should be noted that '||response END) END AS made FROM wy JOIN cq USING (id) LEFT JOIN bt USING (id) LEFT JOIN conversations c ON {_ID}=answer_id), "
    "d AS (SELECT *, regexp_extract_all(made,'\\S+') AS m FROM w), g AS (SELECT *, list_transform(range(1, greatest(len(m)-1,1)), lambda i: array_to_string(m[i:i+2],' ')) AS gr FROM d) "
    "SELECT id, way, md5(CASE WHEN made IS NULL OR {0} THEN text ELSE made END) AS repaired FROM g".replace("{0}", sql_degenerate("made", "m", "gr")),
)
def n04(spark, sf):
    """Each response by its way: what violates relation is replaced by the best response of another conversation at 0.3 or
    over; edits and answers that are missing or degenerate leave it as it is."""
    flags = scores(spark, sf).groupBy("id").agg(F.array_compact(F.collect_list(F.when(F.col("p_base") > 0.6, F.col("maxim")))).alias("v"))
    rows = contexts(spark, sf).join(flags, "id").withColumn("way", P.route(F.col("v")))
    held = responses(spark, sf)
    answers = X.best_answers(rows.where("way = 'retrieve'"), held, 0.3).join(held.select(F.col("id").alias("answer_id"), F.col("text").alias("found")), "answer_id")
    edited = F.when(F.col("id") % 3 == 0, "OK").when(F.col("id") % 3 == 1, F.concat(F.lit("It should be noted that "), "response"))
    out = rows.join(answers.select("id", "found"), "id", "left")
    return out.select("id", "way", F.md5(P.repaired(F.col("way"), F.col("response"), edited, F.col("found"))).alias("repaired"))
