"""Token ids of a byte-level BPE vocabulary, fast and equal to the tokenizers library.

Texts of ordinary characters go through tiktoken on the same vocabulary; a text with a special token's string or a
character outside SAFE (where the two libraries' Unicode tables may differ) goes through tokenizers itself.
"""

from __future__ import annotations

import base64
import os
import re

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
END = 0
#: Latin, Greek, Cyrillic, general punctuation, currency, CJK, kana, hangul: equal in both libraries (tests/llm).
SAFE = re.compile("[\x00-ɏͰ-ͳΆ-ϿЀ-҂Ҋ-ԯ‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-龥가-힣]*")

_loaded: dict = {}


def default_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.exact = Tokenizer.from_file(vocabulary or default_path())
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks or default_path(RANKS), "rb"))}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.special = [str(t.content) for t in self.exact.get_added_tokens_decoder().values()]

    def ids(self, text: str) -> list[int]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if SAFE.fullmatch(text) is None:
                return self.exact.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def array(self, text: str | None) -> np.ndarray:
        """The ids and the end id after them."""
        ids = self.ids(text) if text else []
        out = np.empty(len(ids) + 1, np.uint32)
        out[:-1] = ids
        out[-1] = END
        return out


def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    """One encoder a worker process."""
    if (vocabulary, ranks) not in _loaded:
        _loaded[vocabulary, ranks] = Encoder(vocabulary, ranks)
    return _loaded[vocabulary, ranks]
