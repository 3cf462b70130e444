"""Token ids from the ``tokenizers`` library, word by word through a bounded cache.

A text is cut in front of every space that follows a character which is not
white space. Both vocabularies in use start a new pre-token there whatever
stands on either side, so the ids of the pieces, strung together, are the ids
of the text. Words seen before are looked up. A new word of Latin letters alone is one
pre-token and goes straight to the library's merge model in the vocabulary's byte alphabet; a closing
mark or a line break behind such a word starts the next pre-token; anything else, and a text
with a space after other white space, goes to the library as it is.

Null counts as the empty text. Special-token strings inside texts are ordinary
text. The caches hold at most ``cache_size`` words of up to ``MAX_PIECE``
characters, then start anew, so memory is bounded however long the input.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

MAX_PIECE = 64
_ODD_SPACE = re.compile(r"\s ")
_CLOSING = ".,;:!?"


def _byte_alphabet() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: itself, or the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class _Words(dict):
    """Words to their ids; a missing one is made on the way."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(word) <= MAX_PIECE:
            self[word] = ids
        return ids


class CachedEncoder:
    def __init__(self, path: str, cache_size: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = True
        self._merge = self._library.model.tokenize
        self._letters = _byte_alphabet()
        self._cache_size = cache_size
        space = self._letters[0x20]
        self._keeps_space = self._library.encode(" a", add_special_tokens=False).tokens[0].startswith(space)
        self._spaced = _Words(lambda w: self._word(w, " ", self._spaced))
        self._bare = _Words(lambda w: self._word(w, "", self._bare)) if self._keeps_space else self._spaced
        self._lead = {" ": space if self._keeps_space else "", "": ""}
        self._closing = {c: self._raw(c) for c in _CLOSING}
        self._line = self._raw("\n")

    def _raw(self, text: str) -> bytes:
        return np.asarray(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() if text else b""

    @staticmethod
    def _latin(word: str) -> bool:
        return word.isalpha() and (word.isascii() or max(word) < "ɐ" and "İ" not in word)

    def _word(self, word: str, space: str, own: _Words) -> bytes:
        if self._latin(word):
            if not self._keeps_space:
                word = word.lower()
            if not word.isascii():
                word = "".join([self._letters[b] for b in word.encode()])
            return array("I", [t.id for t in self._merge(self._lead[space] + word)]).tobytes()
        if word[-1:] in self._closing and self._latin(word[:-1]):
            return own[word[:-1]] + self._closing[word[-1]]
        before, line, after = word.partition("\n")
        if line and before and after and not before[-1].isspace() and not after[0].isspace():
            return own[before] + self._line + self._bare[after]
        return self._raw(space + word)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self._spaced) + len(self._bare) * self._keeps_space > self._cache_size:
            self._spaced.clear()
            self._bare.clear()
        spaced, bare, out = self._spaced.__getitem__, self._bare, []
        for text in texts:
            if not text or _ODD_SPACE.search(text):
                out.append(self._raw(text or ""))
                continue
            words = text.split(" ")
            first = words[0]
            words[0] = ""
            ids = map(spaced, words)
            next(ids)
            out.append((bare[first] if first else b"") + b"".join(ids))
        return out


_encoders: dict[tuple[str, int], CachedEncoder] = {}


def encoder(path: str, cache_size: int = 500_000) -> CachedEncoder:
    """One for each Python worker, kept between tasks."""
    key = (path, cache_size)
    if key not in _encoders:
        _encoders[key] = CachedEncoder(path, cache_size)
    return _encoders[key]
