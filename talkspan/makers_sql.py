"""The DuckDB SQL that the word-choosing makers are checked against: chains of CTEs over rows (id, text, context).

Choices are picks by md5 of key, place and salt, as in functions.makers; shuffles are sorts by such a hash.
"""

from __future__ import annotations

from .catalog import _sent
from .functions import makers as K
from .functions import text as T

_EDGE = "[^\\p{L}\\p{M}\\p{N}_]"  # DuckDB's \b knows ASCII words only


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(map(quote, values)) + "]"


def at(i: str) -> str:
    """The key of place i (from 0)."""
    return f"(id::VARCHAR||'|'||({i})::VARCHAR)"


def pick(salt: str, n: int, key: str = "id::VARCHAR") -> str:
    return f"(('0x'||substr(md5({key}||'|{salt}'),1,8))::BIGINT % {n})"


def choose(values, salt: str, key: str = "id::VARCHAR") -> str:
    return f"({listed(values)})[{pick(salt, len(values), key)}+1]"


def chance(salt: str, p: float, key: str = "id::VARCHAR") -> str:
    return f"({pick(salt, 1000, key)} < {round(1000 * p)})"


def words(c: str) -> str:
    return f"regexp_extract_all({c},'\\S+')"


def joined(values: str) -> str:
    return f"array_to_string({values},' ')"


def bare_end(c: str, marks: str = ".,!?;:") -> str:
    return f"regexp_replace({c},'[{marks}]+$','')"


def bare(c: str) -> str:
    return f"regexp_replace({c},'^[.,!?;:]+|[.,!?;:]+$','','g')"


def capital(c: str) -> str:
    return f"regexp_matches({c},'^\\p{{Lu}}')"


def mapped(c: str, table: dict[str, str], other: str) -> str:
    return f"(CASE {c} " + " ".join(f"WHEN {quote(a)} THEN {quote(b)}" for a, b in table.items()) + f" ELSE {other} END)"


def numbers(c: str) -> str:
    return f"regexp_extract_all(regexp_replace(regexp_replace({c}, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', ' ', 'g'), '[^\\x00-\\x7F]', 'a', 'g'), '\\b\\d+(?:,\\d{{3}})*(?:\\.\\d+)?\\b')"


def replaced(w: str, r: str, most: int) -> str:
    """w with the first `most` replacements of r that are not null."""
    return joined(f"list_transform({w}, lambda x, i: CASE WHEN {r}[i] IS NOT NULL AND len(list_filter({r}[1:i], lambda y: y IS NOT NULL))<={most} THEN {r}[i] ELSE x END)")


_I, _REST = "i-1", joined("s[2:]")
_STEPS = ", ".join(f"{{'t': '', 'n': 0, 'a': '{a}', 'f': '(?i)(^|{_EDGE}){a}($|{_EDGE})', 'r': '\\1{b}\\2'}}" for a, b in T.JARGON)


def jargon(c: str) -> str:
    own = f"list_prepend({{'t': {c}, 'n': 0, 'a': '', 'f': '', 'r': ''}}, list_filter([{_STEPS}], lambda x: contains(lower({c}), x.a)))"  # patterns are slow
    return f"(list_reduce({own}, lambda a, x: CASE WHEN a.n<3 AND regexp_matches(a.t, x.f) THEN {{'t': regexp_replace(a.t, x.f, x.r), 'n': a.n+1, 'a': '', 'f': '', 'r': ''}} ELSE a END).t)"


def runon(s: str) -> str:
    open_ends = f"list_transform({s}, lambda x: regexp_replace(x,'[.!?]+$',''))"
    return f"CASE WHEN len({s})>=2 THEN {joined(open_ends)} END"


# ---- realistic violations --------------------------------------------------------------------------------------

_SYNONYM = f"list_transform({words('s[1]')}, lambda w, i: CASE WHEN {chance('synonym', 0.3, at(_I))} THEN {mapped('lower(w)', K.SYNONYMS, 'w')} ELSE w END)"
_SHORT = "CASE WHEN x LIKE '%.' THEN 'it.' WHEN x LIKE '%,' THEN 'it,' ELSE 'it' END"
_PRONOUN = f"list_transform(w, lambda x, i: CASE WHEN i>1 AND length({bare('x')})>3 AND {capital(bare('x'))} AND {chance('noun', 0.4, at(_I))} THEN {_SHORT} END)"
_NEW = mapped(bare("lower(x)"), K.FORMAL, "NULL")
_FORMAL = f"list_transform(w, lambda x, i: CASE WHEN {_NEW} IS NOT NULL AND {chance('jargon', 0.7, at(_I))} THEN (CASE WHEN {capital('x')} THEN upper(substr({_NEW},1,1))||substr({_NEW},2) ELSE {_NEW} END)||substr(x, length({bare('lower(x)')})+1) ELSE x END)"
_BURY = joined("list_transform(list_sort([" + ", ".join(f"{{'h': md5(id::VARCHAR||'|bury{i}'), 'b': {quote(b)}}}" for i, b in enumerate(K.BURYING)) + "]), lambda x: x.b)[1:2]")
_PAIRS = (
    f"list_reduce(list_prepend({{'o': ['']::VARCHAR[], 'e': false, 'x': '', 'c': '', 'p': false}}, list_transform(s, lambda x, i: {{'o': ['']::VARCHAR[], 'e': false, 'x': x, 'c': {choose(K.CONNECTORS, 'connector', at(_I))}, 'p': {chance('pair', 0.6, at(_I))}}})), "
    "lambda a, y: {'o': CASE WHEN a.e THEN list_concat(a.o[1:len(a.o)-1], [regexp_replace(a.o[len(a.o)],'[.!?]+$','')||y.c||lower(y.x)]) ELSE list_concat(a.o, [y.x]) END, 'e': NOT a.e AND y.p, 'x': '', 'c': '', 'p': false}).o[2:]"
)
_MIXED = f"flatten(list_transform(s, lambda x, i: CASE WHEN i>1 AND {chance('mix', 0.3, at(_I))} THEN [{choose(K.BURYING, 'filler', at(_I))}, x] ELSE [x] END))"
_SWAPPED = "list_transform(mx, lambda x, i: CASE WHEN len(mx)>=4 AND i=len(mx)//2+1 THEN mx[i-1] WHEN len(mx)>=4 AND i=len(mx)//2 THEN mx[i+1] ELSE x END)"
_HEDGED = f"flatten(list_transform(w, lambda x, i: CASE WHEN i<len(w) AND {chance('hedge', 0.15, at(_I))} THEN [x, {choose(K.HEDGES, 'hedges', at(_I))}] ELSE [x] END))"
REALISTIC_WORDS = {
    "quantity_repetition": f"CASE WHEN len(s)=0 THEN text ELSE concat_ws(' ', s[1], {choose(K.BRIDGES, 'bridge1')}, lower(s[1]), {choose(K.BRIDGES, 'bridge2')}, {joined(_SYNONYM)}, nullif({_REST},'')) END",
    "quantity_detail": joined(f"list_transform(s, lambda x, i: CASE WHEN i>1 AND {chance('detail', 0.5, at(_I))} THEN {choose(K.DETAILS, 'details', at(_I))}||' '||lower(x) ELSE x END)"),
    "manner_pronouns": replaced("w", "pr", 2),
    "manner_passive": joined(f"list_transform(s, lambda x, i: CASE WHEN {chance('passive', 0.5, at(_I))} THEN {choose(K.PASSIVES, 'passives', at(_I))}||' '||lower(x) ELSE x END)"),
    "manner_bury": f"CASE WHEN len(s)<2 THEN {_BURY}||' '||text ELSE {_BURY}||' '||{_REST}||' '||s[1] END",
    "manner_jargon": joined(_FORMAL),
    "manner_runon": f"CASE WHEN len(s)<2 THEN text ELSE {joined(_PAIRS)} END",
    "manner_disorganized": f"CASE WHEN len(s)<3 THEN text ELSE {joined(_SWAPPED)} END",
    "manner_hedging": joined(_HEDGED),
}


def realistic_words(source: str, name: str) -> str:
    """CTEs up to `name`: the rows of source with a column for each strategy that chooses by word or sentence."""
    return (
        f"{name}_0 AS (SELECT *, {words('text')} AS w, {_sent('text')} AS s FROM {source}), {name}_1 AS (SELECT *, {_PRONOUN} AS pr, {_MIXED} AS mx FROM {name}_0), "
        f"{name} AS (SELECT *, {', '.join(f'{c} AS {n}' for n, c in REALISTIC_WORDS.items())} FROM {name}_1)"
    )


# ---- single violations -----------------------------------------------------------------------------------------

_T0 = bare_end("lower(tp[1])", ".,!?")
_ECHO = f"([{joined('tp[1:2]')}||'... that''s interesting to consider.', 'Regarding '||{_T0}||', there are various aspects.', 'Yes, '||{_T0}||' is quite something.'])[{pick('echo', 3)}+1]"
_AGAIN = f"CASE WHEN len({words('s[1]')})>=5 THEN {choose(K.FILLERS, 'filler')}||' '||lower(s[1]) END"
_LONG = joined(f"list_filter(list_concat([s[1], {_AGAIN}], list_concat(s[2:], [CASE WHEN len(s)>1 THEN 'So, to summarize, '||lower(s[1]) END, CASE WHEN len(d)>0 THEN 'That''s right - '||d[1]||'.' END])), lambda x: x IS NOT NULL)")
CLAIM = f"replace(replace(replace({choose(K.UNSUPPORTED, 'claim')}, '{{adjective}}', {choose(K.ADJECTIVES, 'adjective')}), '{{field}}', {choose(K.FIELDS, 'field')}), '{{percent}}', (15+{pick('percent', 71)})::VARCHAR)"
_UP, _SUBTLE, _SHARE, _PLAIN = chance("up", 0.5), chance("subtle", 0.5), f"({pick('share', 1000)}/1000.0)", "replace(d[1], ',', '')"
_FACTOR = f"CASE WHEN {_SUBTLE} THEN (CASE WHEN {_UP} THEN 1.05::DOUBLE+0.1::DOUBLE*{_SHARE} ELSE 0.85::DOUBLE+0.1::DOUBLE*{_SHARE} END) ELSE (CASE WHEN {_UP} THEN 1.8::DOUBLE+1.2::DOUBLE*{_SHARE} ELSE 0.3::DOUBLE+0.3::DOUBLE*{_SHARE} END) END"
_WHOLE = f"CASE WHEN {_SUBTLE} THEN (CASE WHEN {_UP} THEN nn+greatest(nn//10,1) ELSE nn-greatest(nn//10,1) END) WHEN nn<100 THEN nn*(CASE WHEN {_UP} THEN 3 ELSE 2 END) ELSE nn//2 END"
_CHANGED = f"CASE WHEN contains({_PLAIN},'.') THEN printf('%.1f', {_PLAIN}::DOUBLE*({_FACTOR})) WHEN length({_PLAIN})<=18 THEN (CASE WHEN contains(d[1],',') THEN format('{{:,}}', {_WHOLE}) ELSE ({_WHOLE})::VARCHAR END) END"
_FOUND = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(context,'')), '{'|'.join(ws)}') THEN {quote(n)}" for n, ws in K.DOMAIN_WORDS.items()) + " ELSE '' END"
_OTHER = f"list_filter({listed(K.OFF_TOPIC)}, lambda x: x<>fo)"
_NEAR = "CASE dm " + " ".join(f"WHEN {quote(n)} THEN (list_sort([" + ", ".join(f"{{'d': abs({len(c.split())}-len(w)), 'k': {k}, 'c': {quote(c)}}}" for k, c in enumerate(cs)) + "])[1]).c" for n, cs in K.OFF_TOPIC.items()) + " END"
_SUBJECT = f"list_transform(w, lambda x, i: CASE WHEN i>1 AND {capital('x')} AND length({bare_end('x')})>3 AND {chance('noun', 0.5, at(_I))} THEN {choose(K.SUBJECTS, 'pronoun', at(_I))}||substr(x, length({bare_end('x')})+1) END)"
_ORDER = "list_transform(list_sort(list_transform(s, lambda x, i: {'h': md5(id::VARCHAR||'|'||k::VARCHAR||'|'||(i-1)::VARCHAR), 'x': x})), lambda m: m.x)"
_CONTEXT = "coalesce(context,'')"
SINGLES = {
    "quantity_under": "CASE WHEN len(w)>=10 AND len(regexp_extract_all(vg,'\\S+'))<0.5*len(w) THEN vg END",
    "quantity_over": "CASE WHEN len(w) BETWEEN 8 AND 60 AND len(s)>0 AND len(regexp_extract_all(lg,'\\S+'))>1.8*len(w) THEN lg END",
    "quality_unsupported": f"CASE WHEN len(w)>=5 THEN concat_ws(' ', {bare_end('s[1]', '.')}||{CLAIM}||'.', nullif({_REST},'')) END",
    "quality_contradiction": f"CASE WHEN len(w)>=5 AND len(d)>0 THEN substr(text,1,instr(text,d[1])-1)||({_CHANGED})||substr(text,instr(text,d[1])+length(d[1])) END",
    "relation_off_topic": f"CASE WHEN len(w)>=5 THEN {_NEAR} END",
    "relation_drift": "CASE WHEN len(w)>=5 AND len(regexp_extract_all(dv,'\\S+'))/greatest(len(w),1) BETWEEN 0.5 AND 2 THEN dv END",
    "manner_ambiguous": f"CASE WHEN len(w)>=15 AND len(list_filter(su, lambda x: x IS NOT NULL))>0 THEN {replaced('w', 'su', 3)} END",
    "manner_shuffled": f"CASE WHEN len(s)>=3 THEN {joined(f'list_filter(list_transform(range(0,10), lambda k: {_ORDER}), lambda o: o<>s)[1]')} END",
    "manner_jargon": f"nullif({jargon('text')}, text)",
    "manner_runon": runon("s"),
}


def singles(source: str, name: str) -> str:
    """CTEs up to `name`: the rows of source (id, text, context) with a column for each single violation."""
    known = f"list_transform(list_filter({words(_CONTEXT)}, lambda x: length(x)>4), lambda x: lower(x))"
    topic = f"list_filter(w[1:5], lambda x: list_contains({known}, {bare_end('lower(x)', '.,!?')}))"
    return (
        f"{name}_0 AS (SELECT *, {words('text')} AS w, {_sent('text')} AS s, {numbers('text')} AS d FROM {source}), "
        f"{name}_1 AS (SELECT *, {topic} AS tp, {_LONG} AS lg, {_SUBJECT} AS su, {choose(K.DRIFTS, 'drift')} AS dv, {_FOUND} AS fo, try_cast({_PLAIN} AS BIGINT) AS nn FROM {name}_0), "
        f"{name}_2 AS (SELECT *, CASE WHEN len(tp)>0 THEN {_ECHO} ELSE {choose(K.VAGUE, 'vague')} END AS vg, ({_OTHER})[{pick('domain', 20)} % len({_OTHER}) + 1] AS dm FROM {name}_1), "
        f"{name} AS (SELECT conv_id, turn, id, text, context, {', '.join(f'{c} AS {n}' for n, c in SINGLES.items())} FROM {name}_2)"
    )


FIRST_MANNER = "coalesce(manner_ambiguous, manner_shuffled, manner_jargon, manner_runon)"
HEDGING = joined(
    f"flatten(list_transform({words('text')}, lambda x, i: CASE WHEN i>1 AND length(x)>4 AND {chance('shedge', 0.15, at(_I))} THEN [{choose(K.SHORT_HEDGES, 'shedges', at(_I))}, x] ELSE [x] END))"
)
