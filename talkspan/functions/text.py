"""Text primitives as column expressions; no Python runs on the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stopwords, pronouns, and pronouns that are ambiguous at a sentence's start.
STOPWORDS = ["the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall", "can", "need", "dare", "and", "or", "but", "if", "then", "than", "when", "where", "what", "who", "which", "that", "this", "these", "those", "it", "its", "to", "of", "in", "on", "at", "by", "for", "with", "about", "from", "not", "no", "yes", "so", "as", "like", "just", "very", "really", "i", "you", "we", "they", "he", "she", "me", "us", "them", "my", "your"]
PRONOUNS = ["it", "they", "them", "this", "that", "these", "those", "he", "she", "him", "her", "his", "hers", "its", "their"]
START_PRONOUNS = ["it", "this", "that", "they", "these", "those"]

# Common word and technical word, in order of replacement.
JARGON = [
    ("water", "H2O"),
    ("salt", "sodium chloride"),
    ("sugar", "sucrose"),
    ("air", "atmospheric gases"),
    ("fire", "combustion"),
    ("heat", "thermal energy"),
    ("cold", "low temperature"),
    ("light", "electromagnetic radiation"),
    ("sound", "acoustic waves"),
    ("speed", "velocity"),
    ("big", "substantial"),
    ("small", "diminutive"),
    ("fast", "rapid"),
    ("slow", "gradual"),
    ("old", "antiquated"),
    ("new", "novel"),
    ("good", "optimal"),
    ("bad", "suboptimal"),
    ("important", "of paramount significance"),
    ("easy", "straightforward"),
    ("hard", "challenging"),
    ("many", "numerous"),
    ("few", "a limited quantity of"),
    ("change", "modification"),
    ("help", "assistance"),
    ("use", "utilize"),
    ("make", "fabricate"),
    ("get", "obtain"),
    ("give", "provide"),
    ("take", "acquire"),
]
# The shorter map, all occurrences of which are replaced.
JARGON_ALL = [
    ("use", "utilize"),
    ("about", "regarding"),
    ("end", "terminate"),
    ("help", "facilitate"),
    ("start", "initiate"),
    ("show", "demonstrate"),
    ("get", "obtain"),
    ("need", "require"),
    ("make", "fabricate"),
]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: column expressions are trees, so a reused part would be repeated."""
    return F.get(F.transform(F.array(value), body), 0)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\S+"), F.lit(0))


def n_words(c: Column) -> Column:
    return F.size(words(c))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def sentences(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?<=[.!?])\s+"), lambda s: s != "")


def keywords(c: Column, least: int = 4) -> Column:
    """Lower-case ASCII words that are no stopwords, with repeats."""
    stop = "|".join(w for w in STOPWORDS if len(w) >= least)
    return F.regexp_extract_all(F.lower(c), F.lit(rf"(?U)\b(?!(?:{stop})\b)[a-zA-Z]{{{least},}}\b"), F.lit(0))


def pronouns(c: Column) -> Column:
    """The words that are pronouns but for marks after them, with those."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"(?U)(?<!\S)(?:{'|'.join(PRONOUNS)})[.,!?;:]*(?!\S)"), F.lit(0))


def numbers(c: Column) -> Column:
    """Numbers that stand alone; characters beyond ASCII part words unless they are letters or numbers themselves."""
    plain = F.regexp_replace(F.regexp_replace(c, r"[^\x00-\x7F\p{L}\p{N}]", " "), r"[^\x00-\x7F]", "a")
    return F.regexp_extract_all(plain, F.lit(r"\b\d+(?:,\d{3})*(?:\.\d+)?\b"), F.lit(0))


def named_entities(c: Column) -> Column:
    """Words with a capital first and over one letter, without marks, in order and with repeats."""
    big = F.filter(words(c), lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) > 1))
    return F.filter(F.transform(big, lambda w: F.regexp_replace(w, r"(?U)[^\w]", "")), lambda w: w != "")


def entities(c: Column) -> Column:
    """Distinct capitalised words of over two letters, lower-cased."""
    bare = F.transform(words(c), lambda w: F.regexp_replace(w, r"(?U)[^\w]", ""))
    big = F.filter(bare, lambda w: (F.length(w) > 2) & F.substring(w, 1, 1).rlike(r"^\p{Lu}"))
    return F.array_distinct(F.transform(big, lambda w: F.lower(w)))


def ngrams(tokens: Column, n: int = 3) -> Column:
    size = F.size(tokens)
    made = F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(size >= n, made).otherwise(F.array().cast("array<string>"))


def clean(c: Column) -> Column:
    """White space collapsed, then bracketed and tagged parts dropped; spaces around those may remain double."""
    t = strip(F.regexp_replace(c, r"\s+", " "))
    return strip(F.regexp_replace(F.regexp_replace(t, r"\[.*?\]", ""), r"<.*?>", ""))


def norm_hash(c: Column) -> Column:
    return F.substring(F.md5(strip(F.regexp_replace(F.lower(c), r"\s+", " "))), 1, 16)


def clean_artifacts(c: Column) -> Column:
    for pattern, to in ((r"([\p{L}\p{M}\p{N}_])!+", "$1"), (r" !+ ", " "), (r"!{2,}", "!"), (r"\s+([.,!?;:])", "$1"), (r"\.([A-Z])", ". $1"), (r" {2,}", " ")):
        c = F.regexp_replace(c, pattern, to)
    return c


def word_bang(c: Column) -> Column:
    w = words(c)
    share = F.size(F.filter(w, lambda x: x.endswith("!"))) / F.greatest(F.size(w), F.lit(1))
    return (F.size(w) >= 5) & (share > 0.25)


def _most(tokens: Column) -> Column:
    """How often the most frequent token occurs."""
    return F.coalesce(F.array_max(F.transform(F.array_distinct(tokens), lambda g: F.size(F.filter(tokens, lambda x: x == g)))), F.lit(0))


def _occurrences(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def is_degenerate(c: Column) -> Column:
    def judge(w):
        n = F.greatest(F.size(w), F.lit(1))
        marks = F.size(F.filter(w, lambda x: x.rlike(r"^[^\p{L}\p{M}\p{N}_\s]+$")))
        return (_occurrences(c, "!") / n > 0.15) | (marks / n > 0.20) | (let(ngrams(w), _most) > 2)

    return (F.length(strip(c)) < 8) | c.rlike(r"([!?,.;:\-])\1{2,}") | let(words(c), judge)


def quality_response(c: Column) -> Column:
    """10 to 150 words, at most two question marks, no word over 0.3 of them, mean word length of 3 or more."""

    def judge(w):
        n = F.size(w)
        chars = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
        return n.between(10, 150) & ((n <= 10) | (_most(w) <= 0.3 * n)) & (chars / F.greatest(n, F.lit(1)) >= 3)

    return (_occurrences(c, "?") <= 2) & let(words(F.lower(c)), judge)


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pick(key: Column, salt: str, n: int) -> Column:
    """A number under n from md5: the repeatable stand-in for a random choice."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("|" + salt))), 1, 8), 16, 10).cast("long") % n


def jargon(c: Column, most: int = 3) -> Column:
    """First occurrences of the first `most` words of JARGON that occur."""

    def step_of(common: str, technical: str):
        def step(acc):
            hit = (acc["n"] < most) & acc["t"].rlike(rf"(?i)\b{common}\b")
            text = F.when(hit, F.regexp_replace(acc["t"], rf"(?is)^(.*?)\b{common}\b", "$1" + technical)).otherwise(acc["t"])
            return F.struct(text.alias("t"), F.when(hit, acc["n"] + 1).otherwise(acc["n"]).alias("n"))

        return step

    made = F.struct(c.alias("t"), F.lit(0).alias("n"))
    for common, technical in JARGON:  # one step a word, so that its patterns are literals
        made = let(made, step_of(common, technical))
    return made["t"]


def jargon_all(c: Column) -> Column:
    for common, technical in JARGON_ALL:
        c = F.regexp_replace(c, rf"(?i)\b{common}\b", technical)
    return c


def runon(c: Column) -> Column:
    """Sentences joined without their end marks; null under two sentences."""
    s = sentences(c)
    return F.when(F.size(s) >= 2, F.array_join(F.transform(s, lambda x: F.regexp_replace(x, r"[.!?]+$", "")), " "))


def first_piece(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def lower_first(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), c.substr(F.lit(2), F.length(c)))


def normalized(c: Column, collapse: bool = False) -> Column:
    """Stripped text, with runs of white space as one blank if collapse; null becomes empty."""
    t = strip(F.coalesce(c, F.lit("")))
    return F.regexp_replace(t, r"\s+", " ") if collapse else t
