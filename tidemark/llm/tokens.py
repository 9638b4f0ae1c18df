"""Whole texts to ids of a word-level BPE tokenizer file, word by word.

White space never lies inside a token of such a file and its normalizer works
within words, so a text's ids are the ids of its words in a row. Words repeat:
each worker keeps the ids of the words it has seen, up to a bound, and runs the
merges for new ones only.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: The pattern of the tokenizer file for lower-case words of these characters,
#: which its normalizer changes in nothing but case.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]*")
PLAIN_TOKENS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-įı-ſ]+|[0-9]|[^\sa-z0-9À-ÖØ-öø-įı-ſ]+")
KEPT_WORDS = 300_000


def _byte_names() -> dict[int, str]:
    """How byte-level files write each byte: printable ones as they are, others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """ids as packed little-endian 32-bit words, equal to ``Tokenizer.encode`` without special tokens."""

    def __init__(self, path: str, kept: int = KEPT_WORDS) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.names = _byte_names()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.kept = kept

    def _part(self, token: str) -> bytes:
        found = self.parts.get(token)
        if found is None:
            found = np.array([t.id for t in self.model.tokenize(token)], "<u4").tobytes()
            if len(self.parts) >= self.kept:
                self.parts.clear()
            self.parts[token] = found
        return found

    def _word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word):
            low = word.lower()
            tokens = (low,) if low.isalpha() else PLAIN_TOKENS.findall(low)
            if low.isascii():
                return b"".join(map(self._part, tokens))
            return b"".join(self._part(t.encode().decode("latin-1").translate(self.names)) for t in tokens)
        normal = self.tokenizer.normalizer.normalize_str(word)
        return b"".join(self._part(t) for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))

    def encode(self, text: str) -> bytes:
        words = self.words
        pieces = text.replace("\n", " ").replace("\t", " ").split(" ")
        try:
            return b"".join(map(words.__getitem__, pieces))
        except KeyError:
            pass
        if len(words) >= self.kept:
            words.clear()
        for piece in set(pieces):
            if piece not in words:
                words[piece] = self._word(piece)
        return b"".join(map(words.__getitem__, pieces))


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def texts_of(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]
