"""Token ids of whole texts by a public tokenizer file, with caches of bounded size.

The tokenizer drops white space and never merges across it, so a text's ids are the ids of its
white-space-separated words in turn; words repeat, so most come from a cache.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import regex

from .common import CACHES

#: The tokenizer's own pre-tokenization pattern (a fixed value of its file).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Control characters that str.split() takes as white space and the tokenizer does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
WORDS_KEPT = 200_000

_encoders: dict[str, WordEncoder] = {}
CACHES.append(_encoders.clear)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes; forgets all when it is full."""

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        super().__init__()
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.kept = kept
        self.pieces: dict[str, bytes] = {}
        self.table = byte_alphabet()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.kept:
            self.clear()
        # Plain Latin words are split here as the tokenizer does; anything rarer goes to it whole.
        if len(word) <= 100 and max(word) < "ƀ" and "<|" not in word:
            low = word.lower()
            if low.isalpha():
                ids = self._piece(low)
            elif low[:-1].isalpha() and low[-1] in ".,":
                ids = self._piece(low[:-1]) + self._piece(low[-1])
            else:
                ids = b"".join(map(self._piece, PRETOKEN.findall(low)))
        else:
            ids = self._slow(word)
        self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.kept:
                self.pieces.clear()
            chars = piece.encode().decode("latin-1").translate(self.table)
            ids = struct.pack(f"<{len(t)}I", *[x.id for x in t]) if (t := self.model.tokenize(chars)) else b""
            self.pieces[piece] = ids
        return ids

    def _slow(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        if ODD_SPACE.search(text):
            return self._slow(text)
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
