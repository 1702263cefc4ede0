"""Token ids of whole texts by a word-level tokenizer file, memoised by pre-token."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

#: Distinct pre-tokens that one worker keeps; beyond it the memo starts anew.
MEMO_WORDS = 800_000
#: Characters outside those whose classes, lower case and composition are the same for Python and for the tokenizer.
_UNUSUAL = re.compile("[^\\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ÿ‘’“”–—…€]")
#: White space for Python but not for the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: The tokenizer's pre-tokens in lower-case text of those characters, the most frequent kind first: no two kinds begin alike.
_PRE_TOKENS = re.compile(r"[a-zß-öø-ÿ]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_ASCII_TOKENS = re.compile(r"[a-z]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\sa-z0-9]+")


def default_path() -> str:
    """The public word-level vocabulary that the production queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of every byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in kept}
    table.update((b, chr(256 + i)) for i, b in enumerate(x for x in range(256) if x not in table))
    return table


class _Memo(dict):
    """Pre-token -> packed ids, by the tokenizer's own model."""

    def __init__(self, model):
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, token: str) -> bytes:
        written = token if token.isascii() else token.encode().decode("latin-1")
        found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(written.translate(self.letters))])
        self[token] = found
        return found


class WordEncoder:
    """Encodes texts with a tokenizer of the kind of ``word_bpe_49k.json``: lower case, white space dropped.

    Texts of common characters are cut into pre-tokens here, and each distinct one is encoded once by the tokenizer's
    model and kept as packed little-endian unsigned 32-bit ids.  All other texts, and those that name a special token,
    go through the tokenizer as they are.  Tests hold both ways against the tokenizer.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo_words = memo_words
        self.memo = _Memo(self.tokenizer.model)

    def encode(self, text: str | None) -> bytes:
        """The packed ids of a text; null counts as empty."""
        if not text:
            return b""
        rule = _PRE_TOKENS
        if text.isascii():
            rule, odd = _ASCII_TOKENS, any(c in text for c in _SEPARATORS)
        else:
            odd = _UNUSUAL.search(text)
        if odd or any(s in text for s in self.special):
            import numpy as np

            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        memo = self.memo
        if len(memo) > self.memo_words:
            memo.clear()
        return b"".join([memo[w] for w in rule.findall(text.lower())])

    def encode_all(self, texts: Iterable[str | None]) -> Iterable[bytes]:
        return map(self.encode, texts)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This process's encoder of a file: a worker keeps its memo from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def forget() -> None:
    """Drop this process's encoders with their memos; the next task that needs one reads its file again."""
    import ctypes
    import gc

    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # else what the tokenizer freed stays with the process
            libc.malloc_trim(0)
