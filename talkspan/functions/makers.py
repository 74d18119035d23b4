"""Makers of violated responses, as column expressions whose choices are repeatable picks by md5 of a key.

A maker takes key (any id), text and where needed context, and gives the violated text or null where it does not apply.
Null text gives null. Nothing is shuffled; one row's work is linear in its text but where sentences are reordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Phrases, templates and word maps of the makers.
VAGUE = ["That's interesting.", "It depends on various factors.", "There are many aspects to consider.", "It's quite complex.", "That's a good question.", "There's a lot to say about that.", "It varies.", "Many people wonder about this.", "It's worth thinking about.", "There are different perspectives on this."]
FILLERS = ["In other words,", "To put it another way,", "As I mentioned,", "To elaborate further,", "Additionally, it's worth noting that", "Furthermore,", "In fact,", "That is to say,", "More specifically,", "To be more precise,"]
UNSUPPORTED = [", and is considered one of the most {adjective} in history", ", which has been studied extensively by researchers worldwide", ". Interestingly, this accounts for approximately {percent}% of all cases", ", making it a popular subject among {field} experts", ". Statistics show this affects millions of people annually", ", according to recent studies", ". Many experts believe this will continue to grow", ", which has significant implications for the future"]
ADJECTIVES = ["significant", "remarkable", "important", "notable", "impressive"]
FIELDS = ["science", "history", "technology", "economics", "psychology"]
OFF_TOPIC = {
    "food": ["The Mediterranean diet emphasizes olive oil, fish, and vegetables, and has been associated with numerous health benefits.", "When preparing pasta, always salt the water generously and cook until al dente for the best texture.", "Coffee originated in Ethiopia and has become one of the world's most popular beverages."],
    "technology": ["Cloud computing has revolutionized how businesses store and process data in recent years.", "Artificial intelligence systems are increasingly being used in healthcare diagnostics.", "The first smartphone was introduced in the early 1990s, combining phone and PDA features."],
    "nature": ["Coral reefs support approximately 25% of all marine species despite covering less than 1% of the ocean floor.", "Migration patterns of birds are influenced by changes in daylight hours and temperature.", "Rainforests produce about 20% of the world's oxygen and are often called the lungs of the Earth."],
    "history": ["The printing press, invented by Gutenberg in the 15th century, transformed the spread of knowledge.", "Ancient Rome's road system spanned over 50,000 miles and connected the vast empire.", "The Industrial Revolution began in Britain in the late 18th century and spread across Europe."],
    "science": ["Water molecules consist of two hydrogen atoms bonded to one oxygen atom.", "The human brain contains approximately 86 billion neurons that form complex networks.", "Photosynthesis allows plants to convert sunlight into chemical energy for growth."],
}
DOMAIN_WORDS = {"food": ["eat", "food", "cook", "recipe", "meal"], "technology": ["computer", "phone", "app", "software", "internet"], "nature": ["animal", "plant", "forest", "ocean", "nature"], "history": ["war", "king", "ancient", "century", "empire"]}
DRIFTS = ["This topic has been extensively studied by researchers over the years.", "There are many interesting historical aspects to consider here.", "The origins of this subject date back many centuries.", "Popular opinions on this matter vary widely across different cultures.", "From a theoretical perspective, there are multiple frameworks to consider."]
SUBJECTS = ["it", "this", "that", "they", "these"]
TANGENTS = ["This reminds me of a time when {anecdote}. Anyway, {original}", "Speaking of which, {anecdote}. But getting back to your question, {original}", "I remember {anecdote}. That's somewhat related to this. So, {original}", "You know, my friend once {anecdote}, which is kind of similar. In any case, {original}"]
ANECDOTES = ["I had a similar experience last year", "my neighbor dealt with something like this", "I read an article about this exact topic", "someone I know went through this", "I was just thinking about this yesterday", "there was this one time at work when something similar happened"]
BRIDGES = ["In other words,", "To put it differently,", "What I mean is,", "Essentially,", "To rephrase that,", "Said another way,"]
EXAMPLE_TEMPLATES = ["For example, {example1}. Another example would be {example2}. Yet another case is {example3}. And there's also {example4}.", "Consider {example1}. Or think about {example2}. Don't forget {example3}. Plus there's {example4}.", "Like {example1}. Or {example2}. Same with {example3}. And {example4} too."]
EXAMPLES = ["the case of everyday situations", "what happens in typical scenarios", "the common experience people have", "situations that occur regularly"]
DETAILS = ["It's worth mentioning that", "One thing worth noting is that", "It should be pointed out that", "Additionally, it's important to understand that", "Moreover, we should consider that", "Furthermore, let me add that"]
INTROS = ["Well, it really depends on a lot of factors. There are many things to consider here.", "That's a complex question with no simple answer. There are various perspectives.", "It's hard to say definitively. There are pros and cons to consider.", "This varies quite a bit depending on circumstances. Generally speaking though,"]
OUTROS = ["Of course, this is just one way to look at it, and there are other viewpoints as well.", "But then again, it could also be different in other situations.", "Though ultimately, it's really up to individual interpretation."]
SYNONYMS = {"is": "represents", "are": "constitute", "can": "is able to", "will": "is going to", "has": "possesses", "have": "possess", "do": "perform", "make": "create", "get": "obtain", "give": "provide"}
WEASELS = ["Some experts believe that", "Many people say that", "Studies have shown that", "Research suggests that", "It's widely known that", "According to some sources,", "There's evidence that", "Some would argue that", "It's been said that", "Reportedly,"]
STATS = ["approximately {pct}% of people", "nearly {pct}% of cases", "about {pct} out of 10", "studies show {pct}% success rate", "an estimated {pct}% of the time"]
GENERAL = ["This is universally true in all cases.", "Everyone experiences this the same way.", "There are no exceptions to this.", "This applies to absolutely everyone."]
HEDGED = ["probably", "possibly", "might", "could be", "perhaps", "seemingly", "apparently", "supposedly", "allegedly"]
CERTAIN = [" This is absolutely certain.", " There's no doubt about this.", " This is a proven fact.", " This is definitely true."]
AUTHORITIES = ["According to leading scientists,", "Top researchers have confirmed that", "Experts unanimously agree that", "Harvard studies have proven that", "Nobel laureates have stated that"]
PASSIVES = ["It was determined that", "It has been observed that", "It should be noted that", "It can be seen that", "It was found that"]
BURYING = ["There are various factors to consider in this regard.", "It's important to look at this from multiple angles.", "The situation is more nuanced than it might appear.", "Several elements come into play here.", "This requires careful consideration of multiple aspects."]
FORMAL = {"use": "utilize", "help": "facilitate", "start": "initiate", "end": "terminate", "show": "demonstrate", "make": "fabricate", "give": "furnish", "get": "acquire", "need": "necessitate", "try": "endeavor", "about": "regarding", "buy": "procure", "build": "construct", "change": "modify", "think": "cogitate", "understand": "comprehend", "important": "paramount", "big": "substantial", "small": "diminutive", "good": "beneficial", "bad": "detrimental"}
CONNECTORS = [" and also ", " but then ", " and furthermore ", " which means that ", " and in addition to that ", " plus also ", " and on top of that "]
HEDGES = ["sort of", "kind of", "maybe", "possibly", "perhaps", "in a way", "to some extent", "more or less", "somewhat"]
DRIFTING = ["{start} By the way, {tangent} Speaking of which, {drift}", "{start} This reminds me of {tangent} Actually, {drift}", "{start} You know what's interesting? {tangent} And that leads to {drift}"]
TANGENT_TOPICS = ["there's a similar concept in nature where animals do this.", "I was reading about how this relates to psychology.", "historically, people approached this very differently.", "there's an economic angle to consider here as well.", "technology has really changed how we think about this."]
DRIFT_ENDS = ["So really, it all comes down to perspective.", "Which is why you have to look at the bigger picture.", "And that's what makes this topic so fascinating.", "It's all connected in interesting ways.", "There's so much more to explore here."]
STORY = "Actually, this makes me think about something completely different. Have you ever noticed how people always seem to focus on the wrong things? I find that quite interesting. There's a lot to unpack there."
ADJACENT = ["That's an interesting question, but what's really important is", "I think the more relevant point here is", "Rather than answering that directly, let me address", "The question you should really be asking is about"]
FOCUSES = ["The most important thing here, really, is the terminology.", "What people often overlook is the historical context.", "I want to focus specifically on one small aspect:", "Let me address a minor but fascinating detail:"]
AGENDAS = ["but what really matters in today's world is personal development.", "which really shows why self-care is so important.", "and this is exactly why people need to be more mindful.", "proving once again that education is the key to everything."]


def choose(key: Column, salt: str, values: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), T.pick(key, salt, len(values)).cast("int"))


def chance(key: Column, salt: str, p: float) -> Column:
    return T.pick(key, salt, 1000) < round(1000 * p)


def between(key: Column, salt: str, low: int, high: int) -> Column:
    return low + T.pick(key, salt, high - low + 1)


def at(key: Column, i: Column) -> Column:
    """The key of place i in a row."""
    return F.concat_ws("|", key.cast("string"), i.cast("string"))


def fill(template: Column, **parts: Column) -> Column:
    for name, value in parts.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def filled(key: Column, salt: str, templates: Sequence[str], *parts: Column) -> Column:
    """A template of which each {} is filled by the next of the parts."""

    def one(template: str) -> Column:
        fixed = template.split("{}")
        return F.concat(F.lit(fixed[0]), *(c for part, after in zip(parts, fixed[1:]) for c in (part, F.lit(after))))

    return F.get(F.array(*map(one, templates)), T.pick(key, salt, len(templates)).cast("int"))


def joined(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _first(s: Column) -> Column:
    return F.get(s, 0)


def _rest(s: Column) -> Column:
    return F.slice(s, 2, F.greatest(F.size(s), F.lit(1)))


def _bare_end(c: Column, marks: str = ".,!?;:") -> Column:
    return F.regexp_replace(c, f"[{marks}]+$", "")


def _capital(w: Column) -> Column:
    return F.substring(w, 1, 1).rlike(r"^\p{Lu}")


# ---- single violations -----------------------------------------------------------------------------------------


def quantity_under(key: Column, text: Column, context: Column) -> Column:
    """A vague answer, with up to two of the first five words if the context has them; kept if under half the words."""

    def made(f):
        t0 = _bare_end(F.lower(_first(f["t"])), ".,!?")
        echo = F.array(joined(F.concat(F.array_join(F.slice(f["t"], 1, 2), " "), F.lit("... that's interesting to consider."))), F.concat(F.lit("Regarding "), t0, F.lit(", there are various aspects.")), F.concat(F.lit("Yes, "), t0, F.lit(" is quite something.")))
        vague = F.when(F.size(f["t"]) > 0, F.get(echo, T.pick(key, "echo", 3).cast("int"))).otherwise(choose(key, "vague", VAGUE))
        return T.let(vague, lambda v: F.when((f["n"] >= 10) & (T.n_words(v) < 0.5 * f["n"]), v))

    known = F.transform(F.filter(T.words(F.coalesce(context, F.lit(""))), lambda w: F.length(w) > 4), lambda w: F.lower(w))
    topic = T.let(known, lambda k: F.filter(F.slice(T.words(text), 1, 5), lambda w: F.array_contains(k, _bare_end(F.lower(w), ".,!?"))))
    return T.let(F.struct(topic.alias("t"), T.n_words(text).alias("n")), made)


def quantity_over(key: Column, text: Column) -> Column:
    """The first sentence again, a summary and the first number again; 8 to 60 words, kept if over 1.8 times as long."""

    def made(f):
        s = f["s"]
        again = F.when(T.n_words(_first(s)) >= 5, joined(choose(key, "filler", FILLERS), F.lower(_first(s))))
        summary = F.when(F.size(s) > 1, F.concat(F.lit("So, to summarize, "), F.lower(_first(s))))
        number = F.when(F.size(f["d"]) > 0, F.concat(F.lit("That's right - "), _first(f["d"]), F.lit(".")))
        long = F.array_join(F.array_compact(F.concat(F.array(_first(s), again), _rest(s), F.array(summary, number))), " ")
        return T.let(long, lambda v: F.when(f["n"].between(8, 60) & (F.size(s) > 0) & (T.n_words(v) > 1.8 * f["n"]), v))

    return T.let(F.struct(T.sentences(text).alias("s"), T.numbers(text).alias("d"), T.n_words(text).alias("n")), made)


def quality_unsupported(key: Column, text: Column) -> Column:
    claim = fill(choose(key, "claim", UNSUPPORTED), adjective=choose(key, "adjective", ADJECTIVES), field=choose(key, "field", FIELDS), percent=between(key, "percent", 15, 85).cast("string"))
    made = lambda s: joined(F.concat(_bare_end(_first(s), "."), claim, F.lit(".")), F.nullif(F.array_join(_rest(s), " "), F.lit("")))
    return F.when(T.n_words(text) >= 5, T.let(T.sentences(text), made))


def quality_contradiction(key: Column, text: Column) -> Column:
    """The first number changed, a little or much; null without a number or with one of over 18 digits."""
    subtle, up = chance(key, "subtle", 0.5), chance(key, "up", 0.5)
    share = T.pick(key, "share", 1000) / 1000

    def changed(d):
        plain = F.replace(d, F.lit(","), F.lit(""))
        factor = F.when(subtle, F.when(up, 1.05 + 0.1 * share).otherwise(0.85 + 0.1 * share)).otherwise(F.when(up, 1.8 + 1.2 * share).otherwise(0.3 + 0.3 * share))
        n = plain.try_cast("long")
        step = F.greatest(F.floor(n / 10), F.lit(1))
        whole = F.when(subtle, F.when(up, n + step).otherwise(n - step)).when(n < 100, n * F.when(up, 3).otherwise(2)).otherwise(F.floor(n / 2))
        shown = F.when(d.contains(","), F.format_number(whole, 0)).otherwise(whole.cast("string"))
        return F.when(plain.contains("."), F.format_string("%.1f", plain.cast("double") * factor)).when(F.length(plain) <= 18, shown)

    def made(d):
        spot = F.instr(text, d)
        return F.concat(F.substring(text, F.lit(1), spot - 1), changed(d), text.substr(spot + F.length(d), F.length(text)))

    return F.when((T.n_words(text) >= 5) & (F.size(T.numbers(text)) > 0), T.let(_first(T.numbers(text)), made))


def relation_off_topic(key: Column, text: Column, context: Column) -> Column:
    """Of another domain than the context's, the sentence closest in length, the first of equal ones."""
    names, low = list(OFF_TOPIC), F.lower(F.coalesce(context, F.lit("")))
    found = F.coalesce(*[F.when(low.rlike("|".join(ws)), d) for d, ws in DOMAIN_WORDS.items()], F.lit(""))
    other = lambda d: F.filter(F.array(*map(F.lit, names)), lambda x: x != d)
    domain = T.let(found, lambda d: F.get(other(d), F.pmod(T.pick(key, "domain", 20), F.size(other(d))).cast("int")))

    def nearest(n):
        best = [F.array_min(F.array(*[F.struct(F.abs(F.lit(len(c.split())) - n).alias("d"), F.lit(k).alias("k"), F.lit(c).alias("c")) for k, c in enumerate(cs)]))["c"] for cs in OFF_TOPIC.values()]
        return T.let(domain, lambda d: F.coalesce(*[F.when(d == x, b) for x, b in zip(names, best)]))

    return F.when(T.n_words(text) >= 5, T.let(T.n_words(text), nearest))


def relation_drift(key: Column, text: Column) -> Column:
    n = T.n_words(text)
    return T.let(choose(key, "drift", DRIFTS), lambda v: F.when((n >= 5) & (T.n_words(v) / F.greatest(n, F.lit(1))).between(0.5, 2.0), v))


def _replaced(words: Column, most: int, step) -> Column:
    """Struct (o, n): words where up to most are replaced; step(word, place) gives the replacement or null."""
    start = F.struct(F.array().cast("array<string>").alias("o"), F.lit(0).alias("n"))

    def fold(acc, x):
        new = F.when(acc["n"] < most, x["r"])
        return F.struct(F.concat(acc["o"], F.array(F.coalesce(new, x["w"]))).alias("o"), (acc["n"] + F.when(new.isNotNull(), 1).otherwise(0)).alias("n"))

    return F.aggregate(F.transform(words, lambda w, i: F.struct(w.alias("w"), step(w, i).alias("r"))), start, fold)


def manner_ambiguous(key: Column, text: Column) -> Column:
    """Up to three capitalised words, but the first word, become pronouns with chance 0.5; null if none does."""

    def step(w, i):
        bare = _bare_end(w)
        return F.when((i > 0) & _capital(w) & (F.length(bare) > 3) & chance(at(key, i), "noun", 0.5), F.concat(choose(at(key, i), "pronoun", SUBJECTS), w.substr(F.length(bare) + 1, F.length(w))))

    return F.when(T.n_words(text) >= 15, T.let(_replaced(T.words(text), 3, step), lambda r: F.when(r["n"] > 0, F.array_join(r["o"], " "))))


def manner_shuffled(key: Column, text: Column) -> Column:
    """Three sentences or more in the first of ten hashed orders that differs from theirs; null if none does."""

    def made(s):
        def order(k):
            marked = F.transform(s, lambda x, i: F.struct(F.md5(F.concat_ws("|", key.cast("string"), k.cast("string"), i.cast("string"))).alias("h"), x.alias("x")))
            return F.transform(F.array_sort(marked), lambda m: m["x"])

        tries = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), order), lambda o: o != s)
        return F.when(F.size(s) >= 3, F.array_join(F.get(tries, 0), " "))

    return T.let(T.sentences(text), made)


def manner_jargon(text: Column) -> Column:
    return T.let(T.jargon(text), lambda v: F.when(v != text, v))


def first_manner(key: Column, text: Column) -> Column:
    return F.coalesce(manner_ambiguous(key, text), manner_shuffled(key, text), manner_jargon(text), T.runon(text))


def multiple(key: Column, text: Column, maxims: Sequence[str], context: Column | None = None) -> Column:
    """One violation after the other; null if one does not apply. A relation violation needs no context but uses one."""
    about = F.lit("") if context is None else context
    relation = lambda k, t: F.coalesce(relation_off_topic(k, t, about), relation_drift(k, t))
    makers = {"quantity": quantity_over, "quality": quality_unsupported, "manner": first_manner, "relation": relation}
    if unknown := [m for m in maxims if m not in makers]:
        raise ValueError(f"unknown maxims: {unknown}")
    for m in maxims:
        text = T.let(text, _bind(makers[m], key))
    return text


def _bind(maker, key):
    return lambda t: maker(key, t)


def singles(key: Column, text: Column, context: Column) -> dict[str, Column]:
    return {
        "quantity_under": quantity_under(key, text, context), "quantity_over": quantity_over(key, text),
        "quality_unsupported": quality_unsupported(key, text), "quality_contradiction": quality_contradiction(key, text),
        "relation_off_topic": relation_off_topic(key, text, context), "relation_drift": relation_drift(key, text),
        "manner_ambiguous": manner_ambiguous(key, text), "manner_shuffled": manner_shuffled(key, text), "manner_jargon": manner_jargon(text), "manner_runon": T.runon(text),
    }


# ---- realistic violations --------------------------------------------------------------------------------------


def rephrase(key: Column, sentence: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SYNONYMS.items() for x in kv))
    return F.array_join(F.transform(T.words(sentence), lambda w, i: F.when(chance(at(key, i), "synonym", 0.3), F.coalesce(F.try_element_at(table, F.lower(w)), w)).otherwise(w)), " ")


def realistic_text(key: Column, text: Column) -> dict[str, Column]:
    """The strategies that only put phrases around or between whole sentences."""
    k = key
    with_sentences = lambda body: T.let(T.sentences(text), body)
    tail = lambda s: F.nullif(F.array_join(_rest(s), " "), F.lit(""))
    weasel = joined(choose(k, "weasel", WEASELS), "this is particularly important to consider.")
    stat = F.concat(F.lit("Interestingly, "), fill(choose(k, "stat", STATS), pct=between(k, "pct", 50, 95).cast("string")), F.lit(" experience this."))
    sure = text
    for h in HEDGED:
        sure = F.replace(F.replace(sure, F.lit(h), F.lit("definitely")), F.lit(h.capitalize()), F.lit("Definitely"))
    block = fill(choose(k, "block", EXAMPLE_TEMPLATES), **{f"example{i + 1}": F.lit(x) for i, x in enumerate(EXAMPLES)})
    topic, end = choose(k, "topic", TANGENT_TOPICS), choose(k, "end", DRIFT_ENDS)
    none = lambda s, body: F.when(F.size(s) == 0, text).otherwise(body)
    made = {
        "quantity_tangent": fill(choose(k, "tangent", TANGENTS), anecdote=choose(k, "anecdote", ANECDOTES), original=text),
        "quantity_examples": with_sentences(lambda s: F.when(F.size(s) > 1, joined(_first(s), block, tail(s))).otherwise(F.concat(text, F.lit(" "), block))),
        "quantity_vague": F.concat(choose(k, "intro", INTROS), F.lit(" "), text, F.lit(" "), choose(k, "outro", OUTROS)),
        "quality_weasel": with_sentences(lambda s: F.when(F.size(s) > 0, F.concat(_first(s), F.lit(" "), weasel, F.lit(" "), F.array_join(_rest(s), " "))).otherwise(F.concat(weasel, F.lit(" "), text))),
        "quality_stat": with_sentences(lambda s: F.when(F.size(s) > 1, joined(_first(s), stat, tail(s))).otherwise(F.concat(text, F.lit(" "), stat))),
        "quality_overgeneralize": F.concat(text, F.lit(" "), choose(k, "general", GENERAL)),
        "quality_certainty": F.concat(sure, choose(k, "certain", CERTAIN)),
        "quality_authority": F.concat(choose(k, "authority", AUTHORITIES), F.lit(" "), F.lower(text)),
        "relation_drift": with_sentences(lambda s: none(s, fill(choose(k, "drifting", DRIFTING), tangent=topic, drift=end, start=_first(s)))),
        "relation_tangent": with_sentences(lambda s: none(s, joined(_first(s), STORY, topic, end))),
        "relation_adjacent": with_sentences(lambda s: F.when(F.size(s) > 0, F.concat(choose(k, "adjacent", ADJACENT), F.lit(" something related. "), text)).otherwise(F.concat(choose(k, "adjacent", ADJACENT), F.lit(" a different aspect entirely.")))),
        "relation_focus": F.concat(choose(k, "focus", FOCUSES), F.lit(" "), text),
        "relation_agenda": with_sentences(lambda s: none(s, joined(_first(s), "But honestly,", choose(k, "agenda", AGENDAS)))),
    }
    return {n: F.when(text.isNotNull(), c) for n, c in made.items()}


def realistic_words(key: Column, text: Column) -> dict[str, Column]:
    """The strategies that choose by word or sentence."""
    k = key
    by_sentence = lambda f: F.array_join(F.transform(T.sentences(text), f), " ")
    formal = F.create_map(*(F.lit(x) for kv in FORMAL.items() for x in kv))

    def pronoun(w, i):
        bare = F.regexp_replace(w, r"^[.,!?;:]+|[.,!?;:]+$", "")
        short = F.when(w.endswith("."), "it.").when(w.endswith(","), "it,").otherwise("it")
        return F.when((i > 0) & (F.length(bare) > 3) & _capital(bare) & chance(at(k, i), "noun", 0.4), short)

    def jargon(w, i):
        bare = F.regexp_replace(F.lower(w), r"^[.,!?;:]+|[.,!?;:]+$", "")
        new = F.try_element_at(formal, bare)
        new = F.when(_capital(w), F.concat(F.upper(F.substring(new, 1, 1)), new.substr(F.lit(2), F.length(new)))).otherwise(new)
        return F.when(new.isNotNull() & chance(at(k, i), "jargon", 0.7), F.concat(new, w.substr(F.length(bare) + 1, F.length(w)))).otherwise(w)

    def bury(s):
        two = F.array_join(F.slice(F.transform(F.array_sort(F.array(*[F.struct(F.md5(F.concat_ws("|", k.cast("string"), F.lit(f"bury{i}"))).alias("h"), F.lit(b).alias("b")) for i, b in enumerate(BURYING)])), lambda x: x["b"]), 1, 2), " ")
        return F.when(F.size(s) < 2, F.concat(two, F.lit(" "), text)).otherwise(joined(two, F.array_join(_rest(s), " "), _first(s)))

    def runon(s):
        # open: the last piece of o is a sentence that may still take the next one
        start = F.struct(F.array().cast("array<string>").alias("o"), F.lit(False).alias("open"))

        def fold(acc, x):
            last = F.element_at(acc["o"], -1)
            pair = F.concat(F.slice(acc["o"], 1, F.greatest(F.size(acc["o"]) - 1, F.lit(0))), F.array(F.concat(_bare_end(last, ".!?"), choose(at(k, x["i"]), "connector", CONNECTORS), F.lower(x["x"]))))
            o = F.when(acc["open"], pair).otherwise(F.concat(acc["o"], F.array(x["x"])))
            return F.struct(o.alias("o"), (~acc["open"] & chance(at(k, x["i"]), "pair", 0.6)).alias("open"))

        marked = F.transform(s, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        return F.when(F.size(s) < 2, text).otherwise(F.array_join(F.aggregate(marked, start, fold)["o"], " "))

    def disorder(s):
        mixed = F.flatten(F.transform(s, lambda x, i: F.when((i > 0) & chance(at(k, i), "mix", 0.3), F.array(choose(at(k, i), "filler", BURYING), x)).otherwise(F.array(x))))

        def swap(r):
            mid = F.floor(F.size(r) / 2).cast("int")
            return F.transform(r, lambda x, i: F.when(i == mid, F.get(r, mid - 1)).when(i == mid - 1, F.get(r, mid)).otherwise(x))

        return F.when(F.size(s) < 3, text).otherwise(F.array_join(T.let(mixed, lambda r: F.when(F.size(r) >= 4, swap(r)).otherwise(r)), " "))

    def hedge(w):
        return F.array_join(F.flatten(F.transform(w, lambda x, i: F.when((i < F.size(w) - 1) & chance(at(k, i), "hedge", 0.15), F.array(x, choose(at(k, i), "hedges", HEDGES))).otherwise(F.array(x)))), " ")

    def repeat(s):
        first = _first(s)
        told = joined(first, choose(k, "bridge1", BRIDGES), F.lower(first), choose(k, "bridge2", BRIDGES), rephrase(k, first), F.nullif(F.array_join(_rest(s), " "), F.lit("")))
        return F.when(F.size(s) == 0, text).otherwise(told)

    made = {
        "quantity_repetition": T.let(T.sentences(text), repeat),
        "quantity_detail": by_sentence(lambda x, i: F.when((i > 0) & chance(at(k, i), "detail", 0.5), joined(choose(at(k, i), "details", DETAILS), F.lower(x))).otherwise(x)),
        "manner_pronouns": F.array_join(_replaced(T.words(text), 2, pronoun)["o"], " "),
        "manner_passive": by_sentence(lambda x, i: F.when(chance(at(k, i), "passive", 0.5), joined(choose(at(k, i), "passives", PASSIVES), F.lower(x))).otherwise(x)),
        "manner_bury": T.let(T.sentences(text), bury),
        "manner_jargon": F.array_join(F.transform(T.words(text), jargon), " "),
        "manner_runon": T.let(T.sentences(text), runon),
        "manner_disorganized": T.let(T.sentences(text), disorder),
        "manner_hedging": T.let(T.words(text), hedge),
    }
    return {n: F.when(text.isNotNull(), c) for n, c in made.items()}


# ---- short makers by single phrases ----------------------------------------------------------------------------

# Phrases, templates and canned texts of the short makers.
FACTS = ["honey never spoils and archaeologists found 3000-year-old honey", "octopuses have three hearts and blue blood", "the shortest war lasted only 38 minutes", "bananas are technically berries but strawberries are not"]
FACT_TEMPLATES = ["Speaking of which, {} Anyway, {}", "{} That reminds me, {} But back to the point, {}", "Great question! First, let me mention that {} Now, {}"]
NON_ANSWERS = ["That's an interesting point.", "There are many perspectives on that.", "It depends on various factors."]
CLAIMS = ["Studies have shown that", "Experts agree that", "Research suggests that", "Many people believe that", "Scientists have proven that"]
SHARES = ["Approximately {}% of people agree", "Research shows {}% effectiveness", "Studies indicate {}% success rate"]
UNIVERSAL = [" This is always the case without exception.", " Everyone agrees with this universally.", " No one would ever dispute this fact."]
STARTS = ["Well, to be honest, ", "I mean, basically, ", "So, like, you know, ", "Actually, in a way, "]
SHORT_HEDGES = ["sort of", "kind of", "somewhat", "relatively", "more or less"]
LEDES = ["Before I get to that, there are many factors. ", "This is complex with many nuances. First, ", "There is a lot of context here. To begin, "]
DRIFT_REPLIES = ["From a health perspective, there are many factors to consider.", "Culturally, this relates to broader societal trends we see.", "From a business standpoint, economic factors play a role.", "Scientifically speaking, there are fascinating discoveries."]
ADVERSARIAL = ["quantity_verbose", "quantity_vague", "quality_unsupported", "quality_overconfident", "manner_jargon", "manner_unclear", "relation_tangent"]
MINED = {
    "quantity": ["EDIT: Thanks for the gold! Also wanted to add {response} and also {repeat}", "Long time lurker, first time poster. Anyway, {response} {tangent} {response}", "So basically {response}. TL;DR: {summary}"],
    "quality": ["Trust me, {claim}. Source: my experience.", "Everyone knows that {claim}. It's common knowledge.", "I read somewhere that {claim}. Pretty sure it's true."],
    "manner": ["IMHO {response} but YMMV tbh", "It's like, {response}, you know what I mean?", "So yeah basically {response} or whatever"],
    "relation": ["Not sure about that but {tangent}", "Reminds me of {tangent}. Anyway what were we talking about?", "This. Also, unrelated but {tangent}"],
}
OBVIOUS = {
    "offtopic": ["Let me tell you about my favorite pizza toppings instead.", "Speaking of cats, have you ever seen a rainbow?", "The weather is nice today. I like blue.", "Random thoughts about nothing related to what you asked."],
    "contradiction": [" Actually, everything I just said is false.", " Wait, no. The opposite is true.", " But then again, none of this is accurate."],
    "nonsense": ["Asdf jkl qwer uiop zxcv bnm.", "The purple elephant danced with quantum cheese.", "Blah blah blah blah blah blah blah.", "$$%%^^&&**!!@@##"],
    "extreme_verbose": ["Let me explain this in EXTREME detail. First, I want to provide extensive background. Then, I'll elaborate on every single point. Additionally, I'll add more context. Furthermore, there's more to discuss. Moreover, we should consider all angles. In conclusion, after all this, "],
}


def short_texts(key: Column, text: Column, context: Column) -> dict[str, Column]:
    """One phrase put to a text each; a null text counts as empty."""
    k, text = key, F.coalesce(text, F.lit(""))
    low, first = T.lower_first(text), F.lower(T.first_piece(text))
    hedged = lambda w: F.array_join(F.flatten(F.transform(w, lambda x, i: F.when((i > 0) & (F.length(x) > 4) & chance(at(k, i), "shedge", 0.15), F.array(choose(at(k, i), "shedges", SHORT_HEDGES), x)).otherwise(F.array(x)))), " ")
    return {
        "quantity_tangent": filled(k, "factual", FACT_TEMPLATES, choose(k, "fact", FACTS), text, first),
        "quantity_vague": choose(k, "non_answer", NON_ANSWERS),
        "quality_weasel": F.concat(choose(k, "sclaim", CLAIMS), F.lit(" "), low),
        "quality_fake_stat": F.concat(text, F.lit(" "), F.replace(choose(k, "share_of", SHARES), F.lit("{}"), between(k, "sixty", 60, 95).cast("string")), F.lit(".")),
        "quality_overgeneral": F.concat(_bare_end(text, "."), choose(k, "universal", UNIVERSAL)),
        "manner_filler": F.concat(choose(k, "start", STARTS), low),
        "manner_hedging": T.let(T.words(text), hedged),
        "manner_lede": F.concat(choose(k, "lede", LEDES), text),
        "relation_tangential": F.concat(F.lit("Right, "), F.when(text == "", F.lit("that")).otherwise(first), F.lit(". "), choose(k, "reply", DRIFT_REPLIES)),
    }


def adversarial(kind: Column, context: Column) -> Column:
    """The canned text of a kind; kinds without one get the default."""
    verbose = F.concat(F.lit("Let me explain this in great detail. "), F.substring(F.coalesce(context, F.lit("")), 1, 50), F.lit("... and also..."))
    canned = {"verbose": verbose, "vague": F.lit("That's an interesting perspective to consider."), "unsupported": F.lit("Studies have shown that this is very common. Research indicates..."), "jargon": F.lit("The paradigm shift necessitates utilizing synergistic approaches..."), "tangent": F.lit("Speaking of that, did you know about something completely different...")}
    return F.coalesce(*[F.when(kind.contains(n), c) for n, c in canned.items()], F.lit("That's interesting."))


def mined(key: Column, text: Column, maxim: str) -> Column:
    """A pattern of forum posts filled with the text and its first piece (30 characters of it without a full stop)."""
    summary = F.when(text.contains("."), T.first_piece(text)).otherwise(F.substring(text, 1, 30))
    return fill(choose(key, f"mined_{maxim}", MINED[maxim]), tangent=F.lit("something completely different"), repeat=F.lower(summary), claim=F.lower(summary), summary=summary, response=text)


def obvious(key: Column, good: Column, kind: Column) -> Column:
    """A response that is plainly worse than the good one, of the kind."""
    pick = {n: choose(key, n, v) for n, v in OBVIOUS.items()}
    made = {"offtopic": pick["offtopic"], "contradiction": F.concat(good, pick["contradiction"]), "nonsense": pick["nonsense"], "extreme_verbose": F.concat(pick["extreme_verbose"], good, F.lit(" "), good)}
    return F.coalesce(*[F.when(kind == n, c) for n, c in made.items()], F.lit("I don't know."))
