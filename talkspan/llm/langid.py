"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text gives the longest prefix of what is left of a text that occurs in
the language's text. A text is parsed greedily by longest matches from its first byte to its last; the number of phrases
times the logarithm of the size of the language's text estimates the bits of the text under the language, and the
language with the fewest wins. A byte that the language's text lacks ends a phrase, belongs to the next, and costs its
literal bits besides. A phrase costs as if the language's text had LEAST_BYTES at least: pointers into a tiny text would
cost next to nothing, and a sample of a few letters would beat languages at texts of which it knows no word.

Many stretches of text walk one automaton together, as arrays. A stretch is first walked from the automaton's start;
then the true state is carried over each border and walked on until it meets the state of the first walk, from where
both agree, so the phrases are those of the whole text in one go.

The automata are built from a bounded training sample: of each language the first SAMPLE_ROWS labelled documents by hash
of doc_id, those of at most DOCUMENT_BYTES bytes before longer ones, whole, as long as they come to at most
LANGUAGE_BYTES; a first document over that is cut there. With over TOTAL_BYTES / LANGUAGE_BYTES languages, each has an
equal part of TOTAL_BYTES. Tables take 8 bytes a sample byte and symbol of the common alphabet: 320 MB in all for 40
symbols. More than MAX_LANGUAGES languages are an error. All texts are judged whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, per_row, raw

SAMPLE_ROWS = 64
DOCUMENT_BYTES = 8_192
LANGUAGE_BYTES = 65_536
TOTAL_BYTES = 1 << 20
MAX_LANGUAGES = 256
#: A phrase costs the logarithm of the sample's size, or of this if it is smaller; an unknown byte costs LITERAL bits more.
LEAST_BYTES = 4_096
LITERAL = 8
#: Bytes that one lane of the joint walk takes; the result does not depend on it.
STRETCH = 256

#: Letters and all bytes from 0x80 on stay, everything else is a space.
FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


class Automaton:
    """The suffix automaton of a byte string as a table: next state and whether a phrase ended to get there."""

    def __init__(self, text: bytes, alphabet: np.ndarray):
        """alphabet: a number under size for each byte; the last number stands for bytes that no training text has."""
        size = int(alphabet.max()) + 1
        go: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in alphabet[np.frombuffer(text, np.uint8)].tolist():
            cur = len(go)
            go.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in go[p]:
                go[p][c] = cur
                p = link[p]
            if p >= 0:
                q = go[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(go)
                    go.append(dict(go[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and go[p].get(c) == q:
                        go[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        table = np.full((len(go), size), -1, np.int32)
        rows = np.repeat(np.arange(len(go)), [len(g) for g in go])
        table[rows, [c for g in go for c in g]] = [s for g in go for s in g.values()]
        start = np.maximum(table[0], 0)  # a byte that never occurs ends a phrase
        fail = table < 0
        if len(go) * size >= 1 << 30:
            raise ValueError("the training sample of one language is too large for 32-bit states")
        self.table = ((np.where(fail, start[None, :], table) * size) * 2 + fail).astype(np.int32).ravel()

    def phrases(self, symbols: np.ndarray, lengths: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Phrases that end in each stretch, of texts parsed whole.

        symbols: (steps, stretches), longest stretch first; lengths descend; after: the text's next stretch, or -1.
        """
        steps, lanes = symbols.shape
        state = np.zeros(lanes, np.int32)
        states, ended = np.zeros((steps, lanes), np.int32), np.zeros((steps + 1, lanes), np.int16)
        live = lanes - np.searchsorted(lengths[::-1], np.arange(steps), "right")
        for k in range(steps):
            n = live[k]
            v = self.table[state[:n] + symbols[k, :n]]
            state[:n] = v >> 1
            states[k, :n] = state[:n]
            ended[k + 1, :n] = ended[k, :n] + (v & 1)
        count = ended[lengths, np.arange(lanes)].astype(np.int64)
        first = count.copy()
        lane = np.flatnonzero(after >= 0)
        while len(lane):  # stretches whose predecessor ends in a state that they have not been walked from yet
            own, s, c = after[lane], state[lane].copy(), np.zeros(len(lane), np.int64)
            again = np.zeros(len(lane), bool)
            open_ = np.arange(len(lane))
            for k in range(steps):
                over = lengths[own[open_]] <= k
                if over.any():  # walked to the end without meeting the first walk
                    done = open_[over]
                    again[done] = state[own[done]] != s[done]
                    state[own[done]], count[own[done]] = s[done], c[done]
                    open_ = open_[~over]
                if not len(open_):
                    break
                v = self.table[s[open_] + symbols[k, own[open_]]]
                s[open_], c[open_] = v >> 1, c[open_] + (v & 1)
                met = s[open_] == states[k, own[open_]]
                if met.any():
                    done = open_[met]
                    o = own[done]
                    end = states[lengths[o] - 1, o]
                    again[done] = state[o] != end
                    state[o], count[o] = end, c[done] + first[o] - ended[k + 1, o]
                    open_ = open_[~met]
            if len(open_):
                again[open_] = state[own[open_]] != s[open_]
                state[own[open_]], count[own[open_]] = s[open_], c[open_]
            lane = own[again]
            lane = lane[after[lane] >= 0]
        return count


class Model:
    """Automata of all languages, built where they are used from the sample texts."""

    def __init__(self, samples: dict[str, str], stretch: int = STRETCH):
        self.languages = sorted(samples)
        most = min(LANGUAGE_BYTES, TOTAL_BYTES // max(1, len(samples)))
        texts = [FOLD[np.frombuffer(samples[c].lower().encode()[:most], np.uint8)] for c in self.languages]
        seen = np.unique(np.concatenate(texts)) if texts else np.zeros(0, np.uint8)
        self.alphabet = np.full(256, len(seen), np.int64)
        self.alphabet[seen] = np.arange(len(seen))
        self.automata = [Automaton(t.tobytes(), np.append(self.alphabet, len(seen))) for t in texts]
        self.log_size = np.log2([max(LEAST_BYTES, len(t)) for t in texts])
        self.unknown = np.ones((len(texts), len(seen) + 1), bool)  # by language and symbol
        for k, t in enumerate(texts):
            self.unknown[k, self.alphabet[np.unique(t)]] = False
        self.stretch = stretch

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and unknown bytes, (texts, languages) each."""
        data, offs = raw(pc.utf8_lower(texts))
        out = np.zeros((len(offs) - 1, len(self.languages)), np.int64)
        strange = np.zeros_like(out)
        for i, j in chunks(offs, 1 << 21):
            d, o = self.alphabet[FOLD[data[offs[i] : offs[j]]]], offs[i : j + 1] - offs[i]
            size = np.diff(o)
            for k, u in enumerate(self.unknown):
                strange[i:j, k] = per_row(u[d], o)
            n = -(-size // self.stretch)
            own = np.repeat(np.arange(j - i), n)
            begin = o[own] + (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * self.stretch
            length = np.minimum(self.stretch, o[own + 1] - begin)
            if not len(begin):
                continue
            order = np.argsort(-length, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            after = np.full(len(order), -1, np.int64)
            pair = np.flatnonzero(own[1:] == own[:-1])
            after[place[pair]] = place[pair + 1]
            begin, length, own = begin[order], length[order], own[order]
            symbols = d[np.minimum(begin[None, :] + np.arange(int(length[0]))[:, None], len(d) - 1)].astype(np.int32)
            for k, a in enumerate(self.automata):
                out[i:j, k] = np.bincount(own, a.phrases(symbols, length, after), minlength=j - i).astype(np.int64) + (size > 0)
        return out, strange

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is one minus the winner's share of the runner-up's bits.

        und and 0 where the text is null or has no letter; ties go to the first language by name.
        """
        texts = texts.fill_null("")
        letter = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        count, strange = self.counts(texts)
        bits = count * self.log_size[None, :] + strange * LITERAL
        best = bits.argmin(axis=1)
        two = np.sort(bits, axis=1)[:, :2] if bits.shape[1] > 1 else np.stack([bits[:, 0], bits[:, 0] * 2], axis=1)
        score = np.where(letter, 1.0 - two[:, 0] / np.maximum(two[:, 1], 1), 0.0)
        return [self.languages[b] if x else "und" for b, x in zip(best, letter)], np.clip(score, 0.0, 1.0)


_models: dict = {}


def fold_of(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, document_bytes: int = DOCUMENT_BYTES, language_bytes: int = LANGUAGE_BYTES) -> dict[str, str]:
    """Text of each language from labelled documents outside fold 2: a bounded sample of whole texts for the driver.

    A language's first document is taken whatever its size, as far as language_bytes, so no language goes without.
    Empty texts are a sample like any other: it knows no byte.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold_of() != 2))
    keyed = own.select("lang", "doc_id", "text", (F.octet_length("text") > document_bytes).alias("long"), F.xxhash64("doc_id").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("long", "h", "doc_id", F.xxhash64("text")))
    few = keyed.withColumn("_r", rank).where(F.col("_r") <= rows)  # the limit goes below the shuffle
    total = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("_r"))
    taken = few.withColumn("_total", total).where((F.col("_r") == 1) | (F.col("_total") <= language_bytes))
    out: dict[str, list[str]] = {}
    for r in taken.select("lang", "_r", F.substring("text", 1, language_bytes).alias("text")).orderBy("lang", "_r").limit(rows * MAX_LANGUAGES + 1).collect():
        out.setdefault(r["lang"], []).append(r["text"])
    if len(out) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {k: "\n".join(v) for k, v in out.items()}


def identify(docs: DataFrame, samples: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out (fold 2), lang_pred, score in 0..1.

    Only text is an input of a prediction. und and score 0 for null texts and texts without a letter, and for all
    texts if there is no labelled text. A null doc_id counts as not held out. Repeated rows and ties get the same
    answer each time. Empty table: empty result. Extra columns are not read.
    """
    if samples is None:
        samples = training_sample(docs)

    def run(batches):
        key = hash(tuple(sorted(samples.items())))
        if key not in _models:
            _models.clear()
            _models[key] = Model(samples)
        model = _models[key]
        for b in batches:
            if model.languages:
                lang, score = model.predict(b.column(2))
            else:
                lang, score = ["und"] * len(b), np.zeros(len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(fold_of() == 2, F.lit(False)).alias("held_out")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
