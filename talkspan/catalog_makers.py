"""Queries of the makers of violated responses, registered in the catalog."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from . import makers_sql as Q
from .catalog import SQL_EXAMPLES, _sent, examples, query, turns
from .functions import makers as K
from .functions import text as T
from .operators import sampling as S


def _id() -> Column:
    return F.col("conv_id") * 1000 + F.col("turn")


def _choice(values: list[str], salt: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[('0x'||substr(md5((conv_id*1000+turn)::VARCHAR||'|{salt}'),1,8))::BIGINT % {len(values)} + 1]"


def _range(salt: str, low: int, high: int) -> str:
    return f"({low} + ('0x'||substr(md5((conv_id*1000+turn)::VARCHAR||'|{salt}'),1,8))::BIGINT % {high - low + 1})::VARCHAR"


_REST = "array_to_string(s[2:], ' ')"
_SURE = "text"
for _h in K.HEDGED:
    _SURE = f"replace(replace({_SURE}, '{_h}', 'definitely'), '{_h.capitalize()}', 'Definitely')"
_WEASEL = f"{_choice(K.WEASELS, 'weasel')}||' this is particularly important to consider.'"
_STAT = f"'Interestingly, '||replace({_choice(K.STATS, 'stat')}, '{{pct}}', {_range('pct', 50, 95)})||' experience this.'"
_STORY = "'" + K.STORY.replace("'", "''") + "'"
_BLOCK = _choice(K.EXAMPLE_TEMPLATES, "block")
for _i, _x in enumerate(K.EXAMPLES):
    _BLOCK = f"replace({_BLOCK}, '{{example{_i + 1}}}', '{_x}')"
_REALISTIC = {
    "quantity_tangent": f"replace(replace({_choice(K.TANGENTS, 'tangent')}, '{{anecdote}}', {_choice(K.ANECDOTES, 'anecdote')}), '{{original}}', text)",
    "quantity_examples": f"CASE WHEN len(s)>1 THEN s[1]||' '||{_BLOCK}||' '||{_REST} ELSE text||' '||{_BLOCK} END",
    "quantity_vague": f"{_choice(K.INTROS, 'intro')}||' '||text||' '||{_choice(K.OUTROS, 'outro')}",
    "quality_weasel": f"CASE WHEN len(s)>0 THEN s[1]||' '||{_WEASEL}||' '||{_REST} ELSE {_WEASEL}||' '||text END",
    "quality_stat": f"CASE WHEN len(s)>1 THEN s[1]||' '||{_STAT}||' '||{_REST} ELSE text||' '||{_STAT} END",
    "quality_overgeneralize": f"text||' '||{_choice(K.GENERAL, 'general')}",
    "quality_certainty": f"{_SURE}||{_choice(K.CERTAIN, 'certain')}",
    "quality_authority": f"{_choice(K.AUTHORITIES, 'authority')}||' '||lower(text)",
    "relation_drift": f"CASE WHEN len(s)=0 THEN text ELSE replace(replace(replace({_choice(K.DRIFTING, 'drifting')}, '{{tangent}}', {_choice(K.TANGENT_TOPICS, 'topic')}), '{{drift}}', {_choice(K.DRIFT_ENDS, 'end')}), '{{start}}', s[1]) END",
    "relation_tangent": f"CASE WHEN len(s)=0 THEN text ELSE s[1]||' '||{_STORY}||' '||{_choice(K.TANGENT_TOPICS, 'topic')}||' '||{_choice(K.DRIFT_ENDS, 'end')} END",
    "relation_adjacent": f"CASE WHEN len(s)>0 THEN {_choice(K.ADJACENT, 'adjacent')}||' something related. '||text ELSE {_choice(K.ADJACENT, 'adjacent')}||' a different aspect entirely.' END",
    "relation_focus": f"{_choice(K.FOCUSES, 'focus')}||' '||text",
    "relation_agenda": f"CASE WHEN len(s)=0 THEN text ELSE s[1]||' But honestly, '||{_choice(K.AGENDAS, 'agenda')} END",
}


@query("i13_i14_i16_phrases", f"SELECT conv_id, turn, {', '.join(f'md5({c}) AS {n}' for n, c in _REALISTIC.items())} FROM (SELECT conv_id, turn, text, {_sent('text')} AS s FROM conversations)")
def phrases(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", *(F.md5(c).alias(n) for n, c in K.realistic_text(_id(), F.col("text")).items()))


_TURNS = "tu AS (SELECT conv_id, turn, conv_id*1000+turn AS id, text FROM conversations)"


@query("i13_i15_words", f"WITH {_TURNS}, {Q.realistic_words('tu', 'rw')} SELECT conv_id, turn, {', '.join(Q.REALISTIC_WORDS)} FROM rw")
def words(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", *(c.alias(n) for n, c in K.realistic_words(_id(), F.col("text")).items()))


_MADE = {m: [n for n in (*_REALISTIC, *Q.REALISTIC_WORDS) if n.startswith(m)] for m in ("quantity", "quality", "relation", "manner")}


def sql_realistic(source: str) -> str:
    """CTEs up to st (the rows of source with a column for every strategy and maxim: m_<maxim> the one that is picked)."""
    picked = ", ".join(f"{Q.choose(own, f'strategy_{m}')} AS m_{m}" for m, own in _MADE.items())
    return f"{Q.realistic_words(source, 'rw')}, st AS (SELECT *, {', '.join(f'{c} AS {n}' for n, c in _REALISTIC.items())}, {picked} FROM rw)"


def sql_by_strategy(m: str) -> str:
    return f"CASE m_{m} " + " ".join(f"WHEN '{n}' THEN {n}" for n in _MADE[m]) + " END"


_ALL = " UNION ALL ".join(f"SELECT conv_id, turn, '{m}' AS maxim, m_{m} AS strategy, {sql_by_strategy(m)} AS violated FROM st WHERE length(text)>=20" for m in _MADE)


@query("i17_realistic_violations", f"WITH {_TURNS}, {sql_realistic('tu')} {_ALL}")
def realistic(spark, sf):
    """One row a turn of 20 characters or more and maxim, by one strategy of the maxim."""
    made = K.realistic_text(_id(), F.col("text")) | K.realistic_words(_id(), F.col("text"))
    rows = []
    for m in ("quantity", "quality", "relation", "manner"):
        own = [n for n in made if n.startswith(m)]
        chosen = K.choose(_id(), f"strategy_{m}", own)
        rows.append(F.struct(F.lit(m).alias("maxim"), chosen.alias("strategy"), F.coalesce(*[F.when(chosen == n, made[n]) for n in own]).alias("violated")))
    return turns(spark, sf).where(F.length("text") >= 20).select("conv_id", "turn", F.explode(F.array(*rows)).alias("r")).select("conv_id", "turn", "r.*")


SQL_MAKER_INPUT = f"{SQL_EXAMPLES}, xm AS (SELECT conv_id, turn, conv_id*1000+turn AS id, response AS text, context_text AS context FROM ex)"
_ROWS = " UNION ALL ".join(f"SELECT conv_id, turn, '{n}' AS violation_type, '{n.split('_')[0]}' AS maxim, {n} AS violated FROM si WHERE {n} IS NOT NULL" for n in Q.SINGLES)


@query("i01_i08_violations", f"WITH {SQL_MAKER_INPUT}, {Q.singles('xm', 'si')}, ro AS ({_ROWS}) SELECT conv_id, turn, violation_type, violated FROM ro")
def single(spark, sf):
    made = K.singles(_id(), F.col("response"), F.col("context_text"))
    rows = F.array(*[F.struct(F.lit(n).alias("violation_type"), c.alias("violated")) for n, c in made.items()])
    return examples(spark, sf).select("conv_id", "turn", F.explode(F.filter(rows, lambda r: r["violated"].isNotNull())).alias("r")).select("conv_id", "turn", "r.*")


@query("i06_relation_drift", f"WITH {SQL_EXAMPLES}, v AS (SELECT conv_id, turn, len(w) AS n, {_choice(K.DRIFTS, 'drift')} AS v FROM ex) SELECT conv_id, turn, v AS violated FROM v WHERE len(regexp_extract_all(v,'\\S+'))/n BETWEEN 0.5 AND 2")
def i06(spark, sf):
    return examples(spark, sf).select("conv_id", "turn", K.relation_drift(_id(), F.col("response")).alias("violated")).where("violated is not null")


_CLAIM = f"replace(replace(replace({_choice(K.UNSUPPORTED, 'claim')}, '{{adjective}}', {_choice(K.ADJECTIVES, 'adjective')}), '{{field}}', {_choice(K.FIELDS, 'field')}), '{{percent}}', {_range('percent', 15, 85)})"


@query("i03_quality_unsupported", f"WITH {SQL_EXAMPLES}, v AS (SELECT conv_id, turn, {_sent('response')} AS s FROM ex) SELECT conv_id, turn, md5(rtrim(s[1],'.')||{_CLAIM}||'.'||CASE WHEN len(s)>1 THEN ' '||{_REST} ELSE '' END) AS violated FROM v")
def i03(spark, sf):
    return examples(spark, sf).select("conv_id", "turn", F.md5(K.quality_unsupported(_id(), F.col("response"))).alias("violated"))


_TENTH, _COMBO = Q.chance("multi", 0.1), Q.chance("combo", 0.5)
_MULTIPLE = (
    f"qo AS (SELECT conv_id, turn, id, quantity_over AS text, context FROM si WHERE {_TENTH} AND {_COMBO} AND quantity_over IS NOT NULL), {Q.singles('qo', 'qm')}, "
    f"qu AS (SELECT conv_id, turn, id, quality_unsupported AS text, context FROM si WHERE {_TENTH} AND NOT {_COMBO} AND quality_unsupported IS NOT NULL), {Q.singles('qu', 'uq')}, "
    f"mu AS (SELECT conv_id, turn, 'multi_quantity_manner' AS violation_type, 'multiple' AS maxim, {Q.FIRST_MANNER} AS violated FROM qm UNION ALL SELECT conv_id, turn, 'multi_quality_quantity', 'multiple', quantity_over FROM uq)"
)


@query("i11_i12_violation_pipeline", f"WITH {SQL_MAKER_INPUT}, {Q.singles('xm', 'si')}, {_MULTIPLE}, ro AS ({_ROWS} UNION ALL SELECT * FROM mu WHERE violated IS NOT NULL UNION ALL SELECT conv_id, turn, 'none', 'none', text FROM xm) SELECT * FROM ro")
def pipeline(spark, sf):
    """Per example: all single violations, for a tenth one of two combinations, and the clean row."""
    text, context = F.col("response"), F.col("context_text")
    row = lambda n, maxim, c: F.struct(F.lit(n).alias("violation_type"), F.lit(maxim).alias("maxim"), c.alias("violated"))
    rows = [row(n, n.split("_")[0], c) for n, c in K.singles(_id(), text, context).items()]
    tenth, first = K.chance(_id(), "multi", 0.1), K.chance(_id(), "combo", 0.5)
    rows += [row("multi_quantity_manner", "multiple", F.when(tenth & first, K.multiple(_id(), text, ["quantity", "manner"]))), row("multi_quality_quantity", "multiple", F.when(tenth & ~first, K.multiple(_id(), text, ["quality", "quantity"])))]
    rows.append(row("none", "none", text))
    made = F.filter(F.array(*rows), lambda r: r["violated"].isNotNull())
    return examples(spark, sf).select("conv_id", "turn", F.explode(made).alias("r")).select("conv_id", "turn", "r.*")


_FIRST, _LOWER = "lower(string_split(text,'.')[1])", "lower(substr(text,1,1))||substr(text,2)"


def _filled(templates: list[str], salt: str, *parts: str) -> str:
    """One of the templates, each {} filled by the next of the parts."""
    made = []
    for t in templates:
        fixed = ["'" + x.replace("'", "''") + "'" for x in t.split("{}")]
        made.append("||".join([fixed[0], *(f"{part}||{after}" for part, after in zip(parts, fixed[1:]))]))
    return f"([{', '.join(made)}])[('0x'||substr(md5((conv_id*1000+turn)::VARCHAR||'|{salt}'),1,8))::BIGINT % {len(templates)} + 1]"


_SHORT = {
    "quantity_tangent": _filled(K.FACT_TEMPLATES, "factual", _choice(K.FACTS, "fact"), "text", _FIRST),
    "quantity_vague": _choice(K.NON_ANSWERS, "non_answer"),
    "quality_weasel": f"{_choice(K.CLAIMS, 'sclaim')}||' '||{_LOWER}",
    "quality_fake_stat": f"text||' '||replace({_choice(K.SHARES, 'share_of')}, '{{}}', {_range('sixty', 60, 95)})||'.'",
    "quality_overgeneral": f"rtrim(text,'.')||{_choice(K.UNIVERSAL, 'universal')}",
    "manner_filler": f"{_choice(K.STARTS, 'start')}||{_LOWER}",
    "manner_lede": f"{_choice(K.LEDES, 'lede')}||text",
    "relation_tangential": f"'Right, '||CASE WHEN text='' THEN 'that' ELSE {_FIRST} END||'. '||{_choice(K.DRIFT_REPLIES, 'reply')}",
}


@query("i18_i21_short", f"SELECT conv_id, turn, {', '.join(f'md5({c}) AS {n}' for n, c in _SHORT.items())} FROM conversations")
def short(spark, sf):
    made = K.short_texts(_id(), F.col("text"), F.lit(""))
    return turns(spark, sf).select("conv_id", "turn", *(F.md5(made[n]).alias(n) for n in _SHORT))


@query("i20b_hedging", f"SELECT conv_id, turn, {Q.HEDGING} AS violated FROM (SELECT conv_id, turn, conv_id*1000+turn AS id, text FROM conversations)")
def short_hedging(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", K.short_texts(_id(), F.col("text"), F.lit(""))["manner_hedging"].alias("violated"))


@query("i22_adversarial", f"WITH {SQL_EXAMPLES} SELECT conv_id, turn, k AS kind, CASE WHEN contains(k,'verbose') THEN 'Let me explain this in great detail. '||substr(context_text,1,50)||'... and also...' WHEN contains(k,'vague') THEN 'That''s an interesting perspective to consider.' WHEN contains(k,'unsupported') THEN 'Studies have shown that this is very common. Research indicates...' WHEN contains(k,'jargon') THEN 'The paradigm shift necessitates utilizing synergistic approaches...' WHEN contains(k,'tangent') THEN 'Speaking of that, did you know about something completely different...' ELSE 'That''s interesting.' END AS violated FROM (SELECT *, unnest({K.ADVERSARIAL!r}) AS k FROM ex)")
def i22(spark, sf):
    kinds = F.explode(F.array(*map(F.lit, K.ADVERSARIAL))).alias("kind")
    return examples(spark, sf).select("conv_id", "turn", "context_text", kinds).select("conv_id", "turn", "kind", K.adversarial(F.col("kind"), F.col("context_text")).alias("violated"))


_SUMMARY = "CASE WHEN contains(text,'.') THEN string_split(text,'.')[1] ELSE substr(text,1,30) END"


def _mined(m: str) -> str:
    out = _choice(K.MINED[m], f"mined_{m}")
    for n, v in (("tangent", "'something completely different'"), ("repeat", f"lower({_SUMMARY})"), ("claim", f"lower({_SUMMARY})"), ("summary", _SUMMARY), ("response", "text")):
        out = f"replace({out}, '{{{n}}}', {v})"
    return out


@query("i23_mined_patterns", f"SELECT conv_id, turn, {', '.join(f'md5({_mined(m)}) AS {m}' for m in K.MINED)} FROM conversations")
def i23(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", *(F.md5(K.mined(_id(), F.col("text"), m)).alias(m) for m in K.MINED))


@query("i24_schedule", "WITH r AS (SELECT conv_id, turn, row_number() OVER (ORDER BY md5((conv_id*1000+turn)::VARCHAR||'|sample'), conv_id*1000+turn)-1 AS i FROM conversations) SELECT conv_id, turn, i::INT AS i, (['quantity','quality','relation','manner'])[(i%12)//3+1] AS maxim, (['injector','mined','adversarial'])[i%3+1] AS method FROM r WHERE i<4000")
def i24(spark, sf):
    """The first 4000 turns in hashed order, dealt to maxims and methods in turn; the limit is the feature."""
    sample = turns(spark, sf).select("conv_id", "turn", _id().alias("id")).orderBy(S.order_key("id", "sample"), "id").limit(4000)
    w = Window.orderBy(S.order_key("id", "sample"), "id")  # over at most 4000 rows
    i = F.col("i")
    names = lambda xs, k: F.get(F.array(*map(F.lit, xs)), k.cast("int"))
    return sample.withColumn("i", F.row_number().over(w) - 1).select("conv_id", "turn", "i", names(["quantity", "quality", "relation", "manner"], F.floor(i % 12 / 3)).alias("maxim"), names(["injector", "mined", "adversarial"], i % 3).alias("method"))


_KIND = "(['offtopic','contradiction','nonsense','extreme_verbose'])[turn%4+1]"


@query("i25_obvious_pairs", f"SELECT conv_id, turn, 'A_much' AS preference, {_KIND} AS kind, md5(CASE {_KIND} WHEN 'offtopic' THEN {_choice(K.OBVIOUS['offtopic'], 'offtopic')} WHEN 'contradiction' THEN text||{_choice(K.OBVIOUS['contradiction'], 'contradiction')} WHEN 'nonsense' THEN {_choice(K.OBVIOUS['nonsense'], 'nonsense')} ELSE {_choice(K.OBVIOUS['extreme_verbose'], 'extreme_verbose')}||text||' '||text END) AS bad FROM conversations WHERE role='assistant'")
def i25(spark, sf):
    kind = F.get(F.array(*map(F.lit, K.OBVIOUS)), (F.col("turn") % 4).cast("int"))
    t = turns(spark, sf).where("role = 'assistant'").withColumn("kind", kind)
    return t.select("conv_id", "turn", F.lit("A_much").alias("preference"), "kind", F.md5(K.obvious(_id(), F.col("text"), F.col("kind"))).alias("bad"))
