"""Encoding with a public tokenizer file, one call of the library per distinct word.

Text between ASCII white space is encoded by itself: the file's normaliser and splitter never
look across it. What was seen is kept as packed ids, in caches of a fixed number of bytes.
The string of an added token in a text is that token, as in the library's own call.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from array import array

import numpy as np

# Of each of the two generations of a cache.
CACHE_BYTES = 36 << 20
_ODD_SPACE = re.compile(r"[\x1c-\x1f]")
_PLAIN = re.compile(r"[\x21-\x7eÀ-ɏ]+\Z")
# The file's own splitter, for words of the signs above.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Cache(dict):
    """A dict that computes what it lacks, in two generations of at most ``limit`` bytes each.

    When the younger one is full it becomes the older, and what the older one held since is forgotten unless
    it was asked for again.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit
        self.older: dict = {}
        self.used = 0

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        # about what a key, its value and their places take
        self.used += len(key) + len(value) + 130
        if self.used > self.limit:
            self.older = dict(self)
            self.clear()
            self.used = 0
        self[key] = value
        return value

    def drop(self) -> None:
        self.clear()
        self.older, self.used = {}, 0


class WordEncoder:
    """Ids of whole texts under a lower-casing word BPE file, as the tokenizers library gives them."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        # Texts that hold one of these go through the library whole; tokens looked for after normalising may be anywhere.
        self._added = ("",) if any(t.normalized for t in added) else tuple(t.content for t in added)
        self.vocabulary = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self._kind = "H" if self.vocabulary <= 1 << 16 else "I"
        self._words = Cache(self._word, cache_bytes)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self._bytes = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self._merge = self.library.model.tokenize

    def _whole(self, text: str) -> bytes:
        return array(self._kind, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self._bytes)
        return array(self._kind, [t.id for t in self._merge(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(word)
        if not _PLAIN.match(word):
            return self._whole(word)
        parts = _SPLIT.findall(word)
        return self._piece(word) if len(parts) == 1 else b"".join(map(self._words.__getitem__, parts))

    def forget(self) -> None:
        """Drop what was seen; at the end of a task, so that an idle worker holds no cache."""
        self._words.drop()

    def _holds_added(self, text: str) -> bool:
        return any(t in text for t in self._added)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.dtype)
        if text.isascii():
            if _ODD_SPACE.search(text):
                return np.frombuffer(self._whole(text), self.dtype)
            low = text.lower()
        else:
            if _ODD_SPACE.search(text) or "Σ" in text or "İ" in text:
                return np.frombuffer(self._whole(text), self.dtype)
            low = unicodedata.normalize("NFC", text).lower()
            # some letters only compose in lower case; the library composes before, and not again
            if not unicodedata.is_normalized("NFC", low):
                return np.frombuffer(self._whole(text), self.dtype)
        # of the text as it is the library makes the token itself; of a word in lower case it must not
        if self._holds_added(text) or self._holds_added(low):
            return np.frombuffer(self._whole(text), self.dtype)
        return np.frombuffer(b"".join(map(self._words.__getitem__, low.split())), self.dtype)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder for each file in a Python worker."""
    return WordEncoder(path)
