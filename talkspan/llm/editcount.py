"""Edit-aware token counts: a segment tree of pre-token runs per document, kept as a table.

A text is cut into leaves of about LEAF code points where a pre-token surely begins whatever surrounds it: at white
space after a visible character, and beside CJK punctuation. Neither lies inside a special token's string, so a leaf
encodes alone as it does in its text. Inner nodes hold sums of code points and tokens. An edit finds the leaves of the
characters before and after it by descent, so both outer borders stay what they were, encodes what lies between them,
cuts that into leaves again, and updates the sums on the paths to the root. What is encoded again is at most two leaves
and the new text; a run without such a border is one pre-token or nearly so, and one leaf.

build_trees() writes each document's leaves and their counts; apply_edits() takes up those trees without encoding
anything but what its edits touch, and gives the trees as they are afterwards.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import Encoder, encoder

LEAF = 400
#: Leaves of a slot over which the tree is laid out anew (from counts already known).
SLOT = 16
_VISIBLE = "!-~À-ɏͰ-ͳΆ-ϿЀ-҂Ҋ-ԯ一-龥ぁ-ゖァ-ヺ가-힣"
_MARKS = "。，、！？；："
_BORDER = re.compile(f"(?<=[{_VISIBLE}{_MARKS}])(?=[ \\n])|(?<=[{_MARKS}])(?=[一-龥ぁ-ゖァ-ヺ가-힣])|(?<=[一-龥ぁ-ゖァ-ヺ가-힣])(?=[{_MARKS}])")

#: Personal data and secrets that the default edits replace: (pattern, replacement), leftmost first. Runs are matched
#: from their first character only and without backtracking, so long runs cost no more than their length.
REDACTIONS = [
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "<email>"),
    (r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.])", "<address>"),
    (r"(?<![\w+])\+?\d[\d ()-]{6,}\d(?!\w)", "<number>"),
    (r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+\d)[A-Za-z0-9_-]{20,}+", "<secret>"),
]
_ANY = re.compile("|".join(f"({p})" for p, _ in REDACTIONS))
_HINT = re.compile(r"@|\d")

TREES = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>"


def redactions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of the default edits, in order, not overlapping."""
    if _HINT.search(text) is None:
        return []
    return [(m.start(), m.end(), REDACTIONS[m.lastindex - 1][1]) for m in _ANY.finditer(text)]


def split(text: str, leaf: int = LEAF) -> list[str]:
    """Leaves of leaf code points or more (the last may be shorter), cut at sure borders; an empty text has none."""
    out, at = [], 0
    while len(text) - at > leaf:
        m = _BORDER.search(text, at + leaf)
        if m is None:
            break
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if at < len(text) else out


class Tree:
    """Leaves (text, tokens) in slots; node k has children 2k and 2k+1, slot i is node size + i.

    Places are in code points of the present text; those beyond it are clipped. An empty text is a tree without leaves.
    """

    def __init__(self, enc: Encoder, leaves: list[tuple[str, int]], leaf: int = LEAF):
        self.enc, self.leaf, self.encoded = enc, leaf, 0
        self._lay_out(leaves)

    @classmethod
    def of(cls, text: str, enc: Encoder, leaf: int = LEAF) -> Tree:
        return cls(enc, [(x, len(enc.ids(x))) for x in split(text, leaf)], leaf)

    def _lay_out(self, leaves: list[tuple[str, int]]) -> None:
        self.slots = [[x] for x in leaves] or [[]]
        self.size = 1 << (len(self.slots) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        for k, x in enumerate(leaves):
            self.chars[self.size + k], self.tokens[self.size + k] = len(x[0]), x[1]
        level = self.size
        while level > 1:
            half = level // 2
            for a in (self.chars, self.tokens):
                a[half:level] = a[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level = half

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def leaves(self) -> list[tuple[str, int]]:
        return [x for s in self.slots for x in s]

    def text(self) -> str:
        return "".join(x for x, _ in self.leaves())

    def _find(self, at: int) -> tuple[int, int, int]:
        """(slot, leaf in it, offset in that) of a code point of the text."""
        k = 1
        while k < self.size:
            k *= 2
            if at >= self.chars[k]:
                at -= int(self.chars[k])
                k += 1
        for j, (x, _) in enumerate(self.slots[k - self.size]):
            if at < len(x):
                return k - self.size, j, at
            at -= len(x)
        raise IndexError(at)

    def _sum(self, k: int) -> None:
        n = self.size + k
        self.chars[n], self.tokens[n] = sum(len(x) for x, _ in self.slots[k]), sum(t for _, t in self.slots[k])
        while n > 1:
            n //= 2
            self.chars[n] = self.chars[2 * n] + self.chars[2 * n + 1]
            self.tokens[n] = self.tokens[2 * n] + self.tokens[2 * n + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace code points start..end of the present text."""
        n = int(self.chars[1])
        start = min(max(start, 0), n)
        end = min(max(end, start), n)
        if not n:
            fresh = [(x, len(self.enc.ids(x))) for x in split(new, self.leaf)]
            self.encoded += len(new)
            return self._lay_out(fresh)
        a, i, x = self._find(max(start - 1, 0))
        x += start > 0
        b, j, y = self._find(min(end, n - 1))
        y += end == n
        middle = self.slots[a][i][0][:x] + new + self.slots[b][j][0][y:]
        fresh = [(t, len(self.enc.ids(t))) for t in split(middle, self.leaf)]
        self.encoded += len(middle)
        before, after = self.slots[a][:i], self.slots[b][j + 1 :]
        for k in range(a + 1, b + 1):
            if self.slots[k]:
                self.slots[k] = []
                self._sum(k)
        self.slots[a] = before + fresh + after
        if len(self.slots[a]) > SLOT:
            return self._lay_out(self.leaves())
        self._sum(a)


def build_trees(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Rows of TREES: each document with the code points and tokens of its leaves, in order. Null text: null arrays."""

    def run(batches):
        enc = encoder(vocabulary, ranks)
        for b in batches:
            own = [None if t is None else split(t) for t in b.column(1).to_pylist()]
            chars = [None if x is None else list(map(len, x)) for x in own]
            tokens = [None if x is None else [len(enc.ids(t)) for t in x] for x in own]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))], ["doc_id", "text", "leaf_chars", "leaf_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TREES)


def apply_edits(trees: DataFrame, edits=redactions, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Rows of TREES after the edits, and n_tokens (before), n_edits, n_tokens_edited, n_chars_encoded.

    edits: text -> [(start, end, replacement)] in code points of the text, ascending, applied in turn. A tree without
    edits is passed on as it is.
    """
    names = ["doc_id", "text", "leaf_chars", "leaf_tokens", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded"]
    kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())] + [pa.int64()] * 4

    def run(batches):
        enc = encoder(vocabulary, ranks)
        for b in batches:
            out = []
            for text, chars, tokens in zip(b.column(1).to_pylist(), b.column(2), b.column(3)):
                chars = None if text is None else chars.values.to_numpy(zero_copy_only=False)
                tokens = None if text is None else tokens.values.to_numpy(zero_copy_only=False)
                own = edits(text) if text else []
                total = 0 if text is None else int(tokens.sum())
                if not own:
                    out.append((text, chars, tokens, total, 0, total, 0))
                    continue
                ends = np.cumsum(chars)
                tree = Tree(enc, [(text[e - c : e], t) for c, t, e in zip(chars.tolist(), tokens.tolist(), ends.tolist())])
                shift = 0
                for start, end, new in own:
                    tree.edit(start + shift, end + shift, new)
                    shift += len(new) - (end - start)
                leaves = tree.leaves()
                out.append((tree.text(), [len(x) for x, _ in leaves], [t for _, t in leaves], total, len(own), tree.total, tree.encoded))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))], names)

    return trees.mapInArrow(run, TREES + ", n_tokens long, n_edits long, n_tokens_edited long, n_chars_encoded long")


def count_tokens(docs: DataFrame, edits=redactions, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_edits, n_tokens_edited, n_chars_encoded, edited (the new text).

    All counts are sums of the document's tree, which is written as a table while this is called. Null text has no
    tokens, no edits and a null edited text; empty text has a tree without leaves. n_chars_encoded counts what the edits
    made the tree encode again. Null doc_ids and repeated rows pass through; ties cannot arise. Empty table: empty
    result. Only doc_id and text are read, so other columns cannot clash.
    """
    trees = materialize(build_trees(docs, vocabulary, ranks), "trees")
    done = apply_edits(trees, edits, vocabulary, ranks)
    return done.select("doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded", F.col("text").alias("edited"))
