"""Token ids of whole texts, exactly as the tokenizers library gives them, with a cache of words.

The tokenizer's pre-tokens are encoded independently of one another, so a text whose characters
are all plain Latin is split by the same rule here and each distinct word is encoded once by the
library. Any other text goes to the library as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: The letters, digits and white space below U+0250 as the tokenizer's rule sees them.
LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}]+")
#: Texts with such characters are left to the library: beyond plain Latin, U+0130 (lowers to two
#: characters), and the separators that only Python takes for white space.
OUTSIDE = re.compile("[^\x00-\u012f\u0131-\u024f]")
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")

#: A worker forgets its words beyond this many.
CACHE_WORDS = 400_000


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is
    printable, else the next one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    odd = (chr(256 + k) for k in range(256))
    return [chr(b) if b in plain else next(odd) for b in range(256)]


class _Words(dict):
    def __init__(self, model):
        self.tokenize, self.letters = model.tokenize, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        if not word.isascii():
            spelled = "".join(self.letters[b] for b in word.encode())
        elif word.isprintable():
            spelled = word
        else:
            spelled = "".join(self.letters[b] for b in word.encode())
        ids = np.array([t.id for t in self.tokenize(spelled)], "<u4").tobytes()
        self[word] = ids
        return ids


class _Chunks(dict):
    """By what stands between white space."""

    def __init__(self, words: _Words):
        self.words = words

    def __missing__(self, chunk: str) -> bytes:
        ids = b"".join([self.words[w] for w in WORD.findall(chunk)])
        self[chunk] = ids
        return ids


class Encoder:
    """ids(text): little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer.model)
        self.chunks = _Chunks(self.words)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text or not text.isascii() and OUTSIDE.search(text) or any(x in text for x in SEPARATORS):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        for cache in (self.words, self.chunks):
            if len(cache) > CACHE_WORDS:
                cache.clear()
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def small_batches(batches, rows: int = 2000) -> Iterator:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
