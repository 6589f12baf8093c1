"""BPE with a segment tree over the ranks of adjacent pairs.

The leaves of the tree are the pairs of neighbouring symbols, its nodes the least (rank, place) below: the root is the leftmost
pair of the lowest rank.  A merge changes three leaves, each in logarithmic time, and the next merge is at the root again, until
the root holds no mergeable pair.  So a piece of n symbols takes O(n log n), however long it is.

Texts are cut at white space, which no piece crosses; each distinct cut is encoded once and remembered in a bounded cache.  The new
pieces of a batch are merged together: their trees are the rows of one array, and a step merges at every root at once.

Defined results.  Null or empty text: no ids, decoded to the empty text.  Empty table: no rows.  Repeated rows and null ids: a row
each.  Very long texts, also without white space: whole.  Other columns are ignored.

Cuts and shortcuts are for files with the settings of ``_KNOWN``; with other settings each text is normalized and pre-tokenized whole by the library.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from . import common

#: Cuts that a worker remembers, and characters of one, as a cut may be a whole text.
CACHE_CUTS, CACHE_CHARS = 600_000, 64
#: Signs that form one piece after a word.
_SIGNS = ".,!?;:#*$%&)"
_SPACES = re.compile("[^\\S\x1c-\x1f]+")
# The normalizer and the pre-tokenizer whose pieces no white space is in, and which lower-case words.
_KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "decoder": None,
}
_NONE = 1 << 62
_PLACE = 32  # bits of the place below the rank


def merge_symbols(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """``merges`` maps a pair of symbols to (rank, merged symbol)."""
    n = len(symbols) - 1
    if n < 1:
        return symbols
    width = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * width)
    for i in range(n):
        if found := merges.get((symbols[i], symbols[i + 1])):
            tree[width + i] = found[0] << _PLACE | i
    for i in range(width - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low

    symbols = symbols.copy()
    after = list(range(1, n + 2))  # the symbol to the right, by place; n + 1 is the end
    before = list(range(-1, n))
    while tree[1] < _NONE:
        i = tree[1] & ((1 << _PLACE) - 1)
        j = after[i]
        symbols[i] = merges[symbols[i], symbols[j]][1]
        symbols[j] = -1
        after[i] = k = after[j]
        if j < n:
            put(j, _NONE)
        if k <= n:
            before[k] = i
            found = merges.get((symbols[i], symbols[k]))
            put(i, found[0] << _PLACE | i if found else _NONE)
        else:
            put(i, _NONE)
        if (h := before[i]) >= 0:
            found = merges.get((symbols[h], symbols[i]))
            put(h, found[0] << _PLACE | h if found else _NONE)
    return [s for s in symbols if s >= 0]


class Merges:
    """Pairs of symbols with their rank and what they merge to, for one piece or for many at once."""

    #: Pieces of up to so many symbols are merged together, in trees of one shape.
    WIDTH = 16

    def __init__(self, merges: dict[tuple[int, int], tuple[int, int]]):
        self.one = merges
        self._size = 1 + max((max(a, b, m) for (a, b), (_, m) in merges.items()), default=0)
        rows = sorted((a * self._size + b, rank, m) for (a, b), (rank, m) in merges.items())
        table = np.array(rows, dtype=np.int64).reshape(len(rows), 3)
        self._keys, self._ranks, self._merged = (np.ascontiguousarray(table[:, i]) for i in range(3))

    def _leaf(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, place) in one number, and the merged symbol; for pairs with a symbol below 0, or that never merge, no rank."""
        key = a * self._size + b
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        found = (self._keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(found, self._ranks[at] << _PLACE | place, _NONE), self._merged[at]

    def merge(self, pieces: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        short = [i for i, p in enumerate(pieces) if len(p) <= self.WIDTH]
        for i, p in enumerate(pieces):
            if len(p) > self.WIDTH:
                out[i] = merge_symbols(p, self.one)
        if short and len(self._keys):
            for i, merged in zip(short, self._together([pieces[i] for i in short]), strict=True):
                out[i] = merged
        else:
            for i in short:
                out[i] = list(pieces[i])
        return out

    def _together(self, pieces: list[list[int]]) -> list[list[int]]:
        """The same trees as in ``merge_symbols``, one in each row: every step merges at the root of each row that still has a pair."""
        w, m = self.WIDTH, len(pieces)
        symbols = np.full((m, w + 1), -1, dtype=np.int64)  # the last column stands for the end
        for i, p in enumerate(pieces):
            symbols[i, : len(p)] = p
        place = np.arange(w)
        after = np.broadcast_to(np.minimum(np.arange(1, w + 2), w), (m, w + 1)).copy()
        before = np.broadcast_to(np.arange(-1, w), (m, w + 1)).copy()
        tree = np.full((m, 2 * w), _NONE, dtype=np.int64)
        merged = np.zeros((m, w), dtype=np.int64)
        tree[:, w:], merged[:] = self._leaf(symbols[:, :-1], symbols[:, 1:], place)
        for node in range(w - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            i = tree[rows, 1] & ((1 << _PLACE) - 1)
            j = after[rows, i]
            k = after[rows, j]
            symbols[rows, i] = merged[rows, i]
            symbols[rows, j] = -1
            after[rows, i] = k
            before[rows, k] = i  # the column of the end takes what no one reads
            h = before[rows, i]
            first = np.maximum(h, 0)
            tree[rows, w + j] = _NONE
            tree[rows, w + i], merged[rows, i] = self._leaf(symbols[rows, i], symbols[rows, k], i)
            left, joined = self._leaf(symbols[rows, first], symbols[rows, i], first)
            has = np.flatnonzero(h >= 0)
            tree[rows[has], w + first[has]], merged[rows[has], first[has]] = left[has], joined[has]
            for node in (w + j, w + i, w + first):
                node = node >> 1
                while node[0]:  # all nodes are on one level
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] < _NONE]
        return [r[r >= 0].tolist() for r in symbols]


class Codec:
    """Ids of cuts, and their tokens as the vocabulary writes them."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, self._tokenizer = spec["model"], Tokenizer.from_file(path)
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges")):
            raise ValueError(f"{path}: not a plain BPE model")
        self._known = all(spec.get(k) == v for k, v in _KNOWN.items())
        self._normalize = self._tokenizer.normalizer.normalize_str if self._tokenizer.normalizer else str
        self._pre = self._tokenizer.pre_tokenizer.pre_tokenize_str
        self._vocab: dict[str, int] = model["vocab"]
        self._suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        prefix = len(model.get("continuing_subword_prefix") or "")
        self.merges = Merges({(self._vocab[a], self._vocab[b]): (rank, self._vocab[a + b[prefix:]]) for rank, (a, b) in enumerate(pairs)})
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._token = {i: t for t, i in (self._vocab | self._special).items()}
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        self._seen: dict[str, tuple[bytes, str]] = {}
        self._pieces: dict[str, tuple[bytes, str]] = {s: self._entry([i]) for s, i in self._special.items()}

    def _entry(self, ids: list[int]) -> tuple[bytes, str]:
        return array("I", ids).tobytes(), " ".join([self._token[i] for i in ids])

    def _pieces_of(self, cut: str) -> list[str]:
        """What the normalizer and the pre-tokenizer make of a cut; special tokens are pieces of their own."""
        body = cut.rstrip(_SIGNS)
        if self._known and body.isascii() and body.isalpha():  # what the general case below gives, sooner
            return [body.lower()] if len(body) == len(cut) else [body.lower(), cut[len(body) :]]
        parts = self._split.split(cut) if self._split and (not self._known or "<" in cut) else [cut]
        return [p for part in parts if part for p in ([part] if part in self._special else [x for x, _ in self._pre(self._normalize(part))])]

    def _learn(self, cuts: set[str]) -> None:
        if len(self._seen) + len(cuts) > CACHE_CUTS:
            self._seen.clear()
            self._pieces = {s: self._pieces[s] for s in self._special}
        pieces_of = {cut: self._pieces_of(cut) for cut in cuts}
        new = [p for p in dict.fromkeys(p for pieces in pieces_of.values() for p in pieces) if p not in self._pieces]
        symbols = [[self._vocab[s] for s in (*p[:-1], p[-1] + self._suffix) if s in self._vocab] for p in new]
        for piece, ids in zip(new, self.merges.merge(symbols), strict=True):
            self._pieces[piece] = self._entry(ids)
        for cut, pieces in pieces_of.items():
            found = [self._pieces[p] for p in pieces]
            self._seen[cut] = found[0] if len(found) == 1 else (b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]]))
        for piece in new:
            if len(piece) > CACHE_CHARS:
                del self._pieces[piece]

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids, little-endian unsigned of 32 bits, and the decoded text."""
        if not self._known:
            self._learn(set(texts))
            ids = {t: self._seen.pop(t)[0] for t in set(texts)}
            return [(ids[t], self._tokenizer.decode(np.frombuffer(ids[t], dtype="<u4").tolist(), skip_special_tokens=False)) for t in texts]
        odd = re.compile("[\x1c-\x1f]").search  # white space to Python, not to the pre-tokenizer
        cut_texts = [_SPACES.split(t) if odd(t) else t.split() for t in texts]
        cuts = {c for cuts in cut_texts for c in cuts}
        if new := cuts - self._seen.keys():
            self._learn(cuts if len(self._seen) + len(new) > CACHE_CUTS else new)
        seen = self._seen
        out = []
        for cuts in cut_texts:
            found = [seen[c] for c in cuts]
            out.append((b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[1]])))
        for cut in new:
            if len(cut) > CACHE_CHARS:
                del seen[cut]
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        return self.encode_batch([text])[0]


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, tokenizer_path: str, keep: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``; with ``keep`` also ``ids`` and ``decoded`` themselves."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(tokenizer_path)
        n, ids_sha, text_sha, ids, decoded = [], [], [], [], []
        for _, texts in common.text_pieces(b):
            for raw, back in c.encode_batch(texts):
                n.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if keep:
                    ids.append(raw)
                    decoded.append(back)
        columns = [common.column(b, "doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        if keep:
            columns += [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep
    return common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batch, schema)
