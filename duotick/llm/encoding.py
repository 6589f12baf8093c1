"""Token ids as the ``tokenizers`` library gives them, with its model called once for each distinct piece of text.

A byte-level BPE never merges across the pieces of its pre-tokenizer, and those never run on past a single space or line feed
between words.  So a text is cut before every space and around every line feed; each distinct cut is pre-tokenized and encoded by
the library once and kept in a bounded cache.  Texts for which the cut could differ (runs of white space, other white
space, special tokens, NUL) go to the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import cache
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

#: Cuts that a worker remembers, when there are more, it starts afresh; and characters of one, as a cut may be a whole text.
CACHE_CUTS, CACHE_CHARS = 900_000, 64
_SPACE = re.compile("[\\s᠎]")


class _Whole(Exception):
    """The text must be encoded whole."""


@cache
def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write the 256 bytes: printable ones as they are, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(rest)) for b in range(256)}


def byte_level(piece: str) -> str:
    if piece.isascii():
        return piece.replace(" ", "Ġ") if piece.isprintable() else piece.translate(_byte_letters())
    return piece.encode("utf-8").decode("latin-1").translate(_byte_letters())


#: Signs that form one piece after a word; the apostrophe doesn't, for the sake of contractions.
_SIGNS = ".,!?;:#*$%&)"


class _Cuts(dict):
    def __init__(self, tokenizer: Tokenizer, specials: tuple[str, ...], code: str):
        super().__init__()
        self._pre, self._tokenize, self._specials, self._code = tokenizer.pre_tokenizer.pre_tokenize_str, tokenizer.model.tokenize, specials, code

    def _ids(self, letters: str) -> bytes:
        return array(self._code, [t.id for t in self._tokenize(letters)]).tobytes()

    def __missing__(self, cut: str) -> bytes:
        if len(self) >= CACHE_CUTS:
            self.clear()
        body = cut.rstrip(_SIGNS)
        word = body[1:] if body[:1] == " " else body
        if word.isalpha():  # the common case: a word, and signs after it
            if len(body) == len(cut):
                ids = self._ids(byte_level(cut))
            else:
                tail = cut[len(body) :]
                ids = self[body] + (self.get(tail) or self._ids(tail))
        elif cut == "\n":
            ids = self._ids(byte_level(cut))
        elif not word and not cut.strip(" ") or _SPACE.search(cut, 1 if cut[0] == " " else 0) or any(s in cut for s in self._specials):
            raise _Whole
        else:
            ids = b"".join([self._ids(piece) for piece, _ in self._pre(cut)])
        if len(cut) <= CACHE_CHARS:
            self[cut] = ids
        return ids


def _cuts_are_safe(path: str) -> bool:
    """Whether the file's settings are those for which texts may be cut; with any others texts go to the library whole."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    return byte_level and not spec.get("normalizer") and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in odd)


class Encoder:
    """``encode(text)`` gives ids as bytes of ``dtype``, little-endian unsigned, as narrow as the vocabulary allows."""

    def __init__(self, path: str, special_as_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = special_as_text
        self._safe = _cuts_are_safe(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        specials = () if special_as_text else tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self._cuts = _Cuts(self.tokenizer, specials, "H" if self.dtype == "<u2" else "I")

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self._safe or "\0" in text:
            return self.whole(text)
        try:
            return b"".join(map(self._cuts.__getitem__, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))
        except _Whole:
            return self.whole(text)


@cache
def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """One for each worker process, kept from task to task."""
    return Encoder(path, special_as_text)
