"""Toxicity by compression distance.

Two zstandard dictionaries are learned apart from each other.  The ordinary one is trained by the library on windows of eight words of ordinary text.  The
toxic one is made of stretches of toxic text, chosen by compression alone: a stretch, that is a word or a beginning that several words share,
is added to the ordinary dictionary if it recurs in toxic documents, and windows of both kinds that have a part of it are compressed with and without it.  It is
kept if the documents in which it saves ``LEAST_SAVED`` bytes, and stretches that were kept before don't, are toxic beyond what the shares of
labels explain (a likelihood ratio; near copies are counted once).

A window's distance is its length with the ordinary dictionary less its length with the toxic one, which has the ordinary content in front as
background: without that, lengths differ more by how either happens to express ordinary text than by what is toxic.  A logistic curve maps
the largest distances of a whole text, and how many of its windows reach ``LEAST_SAVED``, to a score.  It is calibrated by cross-fitting: each
document's distances come from dictionaries that were learned without it.

Dictionaries and curve are fitted on a bounded sample of labelled rows (``SAMPLE``); every whole text is scored.

Defined results.  Null or empty text: scored like a text of no windows.  No label, or labels of one class: every score is the share of toxic
labels (0 without any); so too if no stretch recurs in three toxic documents.  Empty table: no rows.  Repeated rows and null ids: a row each; a null
id is not held out.  A ``doc_id`` labelled twice is toxic if any label says so; of several texts of one labelled id, the least is learned from.  Other columns are
ignored, and no column but the text enters a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import common

#: Labelled documents that are learned from at most, by a hash of the id: ordinary, toxic.
SAMPLE = (2400, 600)
WINDOW_WORDS = 8
THRESHOLD = 0.3
#: Bytes that a toxic stretch saves in a window.
LEAST_SAVED = 2
#: Documents in which a stretch has to recur, and the evidence it needs (natural logarithm of the likelihood ratio).
LEAST_DOCS, LEAST_EVIDENCE = 3, 8.0
#: A stretch that saves enough in less than half of so many windows is given up.
TRIALS = 24
#: A beginning of words is passed over for one that is longer by a byte and in so large a share of its documents.
SAME = 0.9
FOLDS = 3

_WORD = re.compile(rb"[^\s.,!?;:#*$%&|<>\"]+")
#: Bytes of the ordinary dictionary; its header and tables, less than the margin, are cut off.  A larger one has more of the parts of toxic words, which
#: then save less.
_ORDINARY_BYTES, _HEADER_BYTES = 8_192, 1_024
#: A stretch can only save bytes in windows with which it shares so many in a row.
_SHARED_BYTES = 6


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.lower().encode("utf-8", "surrogatepass"))


def windows_of(words: list[bytes], width: int = WINDOW_WORDS) -> list[bytes]:
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(0, len(words), width)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Of windows, with the content as dictionary; its last bytes are padded, as the library doesn't look for matches there."""
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, min_match=5, window_log=17, chain_log=16, hash_log=16, search_log=6, target_length=32,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content + bytes(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


@lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    return _compressor(ordinary), _compressor(ordinary + toxic)


def saved(windows: list[bytes], ordinary: bytes, toxic: bytes) -> list[int]:
    """For each window, the bytes that the toxic dictionary saves."""
    plain, foul = (c.compress for c in _compressors(ordinary, toxic))
    return [len(plain(w)) - len(foul(w)) for w in windows]


def distances(text: str, ordinary: bytes, toxic: bytes) -> list[int]:
    return saved(windows_of(words_of(text)), ordinary, toxic)


def features(found: list[int]) -> tuple[float, ...]:
    top = sorted(found, reverse=True)[:3] + [0] * (3 - min(3, len(found)))
    n = max(1, len(found))
    hits = sum(s >= LEAST_SAVED for s in found)
    return (*(float(max(0, min(t, 8))) for t in top), float(hits > 0), math.sqrt(hits), hits / n)


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    center: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]  # the last is the intercept
    prior: float  # the score of all texts if there are no dictionaries

    def score(self, text: str) -> float:
        if not self.toxic:
            return self.prior
        x = features(distances(text, self.ordinary, self.toxic))
        z = self.weights[-1] + sum(w * (v - c) / s for w, v, c, s in zip(self.weights, x, self.center, self.scale, strict=False))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _near_copies_once(texts: list[str]) -> list[int]:
    """The places of texts that share few of 16 least shingle hashes with those before."""
    seen: set[int] = set()
    out = []
    for i, text in enumerate(texts):
        w = words_of(text)
        least = sorted({xxhash.xxh32_intdigest(b" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))})[:16]
        if sum(h in seen for h in least) < min(4, len(least)):
            out.append(i)
            seen.update(least)
    return out


def ordinary_dictionary(windows: list[bytes]) -> bytes:
    """Content that the library's trainer chooses; the windows themselves, if they are too few to train on."""
    try:
        return zstandard.train_dictionary(_ORDINARY_BYTES + _HEADER_BYTES, windows, k=128, d=8).as_bytes()[_HEADER_BYTES:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(windows))[-_ORDINARY_BYTES:]


def evidence(toxic: int, ordinary: int, share: float) -> float:
    """How much likelier the counts of toxic and ordinary documents are by themselves than by the share of toxic ones; 0 if that isn't exceeded."""
    p = toxic / (toxic + ordinary) if toxic else 0.0
    return toxic * math.log(p / share) + (ordinary * math.log((1 - p) / (1 - share)) if ordinary else 0.0) if p > share else 0.0


def _parts(x: bytes) -> set[bytes]:
    return {x[i : i + _SHARED_BYTES] for i in range(len(x) - _SHARED_BYTES + 1)}


def _holders(docs: list[list[bytes]], stretches: list[bytes]) -> dict[bytes, list[tuple[int, bytes]]]:
    """For each part of the stretches, the windows that have it, with the numbers of their documents."""
    wanted = {g for p in stretches for g in _parts(p)}
    out: dict[bytes, list[tuple[int, bytes]]] = {g: [] for g in wanted}
    for number, doc in enumerate(docs):
        for window in doc:
            for g in _parts(window) & wanted:
                out[g].append((number, window))
    return out


def _windows_for(stretch: bytes, holders: dict[bytes, list[tuple[int, bytes]]]) -> Iterator[tuple[int, bytes]]:
    """Windows that have a part of the stretch, with their documents; those that have it whole come first."""
    lists = [holders[stretch[i : i + _SHARED_BYTES]] for i in range(len(stretch) - _SHARED_BYTES + 1)]
    whole = dict.fromkeys(x for x in min(lists, key=len) if stretch in x[1])
    yield from whole
    yield from (x for x in dict.fromkeys(x for found in lists for x in found) if x not in whole)


def _beginnings(docs: list[list[bytes]]) -> Counter[bytes]:
    """Beginnings of words, and words with the space behind, with the number of documents that have them."""
    words = ({b" " + w + b" " for window in doc for w in window.split()} for doc in docs)
    return Counter(p for doc in words for p in {w[:n] for w in doc for n in range(_SHARED_BYTES, len(w) + 1)})


def toxic_stretches(ordinary: list[list[bytes]], toxic: list[list[bytes]], background: bytes, least_evidence: float | None = None) -> list[bytes]:
    """Stretches of toxic text that save bytes in windows of toxic documents, by rising evidence; each document is the list of its windows.

    A stretch is a word or the beginning of several.  One that shares a part with a chosen one counts only where the chosen ones don't save
    enough, so a beginning stands for all words that have it.
    """
    least_evidence = LEAST_EVIDENCE if least_evidence is None else least_evidence
    share = len(toxic) / max(1, len(ordinary) + len(toxic))

    plain = _compressor(background).compress
    length: dict[bytes, int] = {}

    def saved_in(stretch: bytes, chosen: bytes, holders: dict[bytes, list[tuple[int, bytes]]], enough) -> int:
        """Documents with a window in which the stretch saves enough and the chosen ones don't; ``enough(tried, found)`` may end the search."""
        known, foul, found, tried = _compressor(background + chosen).compress, _compressor(background + stretch + chosen).compress, set(), 0
        for number, window in _windows_for(stretch, holders):
            if number not in found:
                if window not in length:
                    length[window] = len(plain(window))
                most = length[window] - LEAST_SAVED
                if not (chosen and len(known(window)) <= most) and len(foul(window)) <= most:
                    found.add(number)
                tried += 1
                if enough(tried, len(found)):
                    break
        return len(found)

    idle = lambda tried, found: tried >= TRIALS and 2 * found < TRIALS
    refuted = lambda n: lambda tried, found: evidence(n, found, share) < least_evidence
    enough_for = lambda n: n >= LEAST_DOCS and evidence(n, 0, share) >= least_evidence

    recur = _beginnings(toxic)
    same = {p[:-1] for p, n in recur.items() if n >= SAME * recur.get(p[:-1], math.inf)}
    recurring = sorted(p for p, n in recur.items() if enough_for(n) and p not in same)
    in_toxic = _holders(toxic, recurring)
    saving = {p: n for p in recurring if enough_for(n := saved_in(p, b"", in_toxic, idle))}
    in_ordinary = _holders(ordinary, list(saving))
    told = [(evidence(n, saved_in(p, b"", in_ordinary, refuted(n)), share), len(p), p) for p, n in saving.items()]
    chosen: list[bytes] = []
    parts: set[bytes] = set()
    for e, _, p in sorted(told, reverse=True):
        if e < least_evidence:
            break
        if _parts(p) & parts:
            before = b"".join(reversed(chosen))
            n = saved_in(p, before, in_toxic, idle)
            if not enough_for(n) or evidence(n, saved_in(p, before, in_ordinary, refuted(n)), share) < least_evidence:
                continue
        chosen.append(p)
        parts |= _parts(p)
    return chosen[::-1]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionaries(ordinary: list[list[bytes]], toxic: list[list[bytes]]) -> tuple[bytes, bytes]:
    """The ordinary content and the toxic stretches, learned from documents as lists of windows."""
    background = ordinary_dictionary([w for doc in ordinary for w in doc])
    return background, b"".join(toxic_stretches(ordinary, toxic, background))


def train(ordinary: list[str], toxic: list[str]) -> Model:
    prior = len(toxic) / max(1, len(ordinary) + len(toxic))
    none = Model(b"", b"", (), (), (), prior)
    kinds = [[windows_of(words_of(texts[i])) for i in _near_copies_once(texts)] for texts in (ordinary, toxic)]
    if not all(kinds):
        return none
    x, y = [], []
    for fold in range(FOLDS):
        learned = dictionaries(*([d for i, d in enumerate(docs) if i % FOLDS != fold] for docs in kinds))
        for label, docs in enumerate(kinds):
            held = docs[fold::FOLDS]
            x += [features(saved(d, *learned)) for d in held]
            y += [float(label)] * len(held)
    background, stretches = dictionaries(*kinds)
    if not stretches:
        return none
    x = np.array(x)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = _logistic((x - center) / scale, np.array(y))
    return Model(background, stretches, tuple(center.tolist()), tuple(scale.tolist()), tuple(weights.tolist()), prior)


def training_sample(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> tuple[list[str], list[str]]:
    """Ordinary and toxic texts, only of ids that aren't held out; at most ``sample`` ids of either, whatever the length of their texts."""
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ranked = one.select("doc_id", "toxic", F.xxhash64("doc_id").alias("h"))
    chosen = None
    for label, most in enumerate(sample):
        part = ranked.where(F.col("toxic") == label).orderBy("h", "doc_id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # bounded by ``sample``: a few thousand rows of three numbers
    rows = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "h", "toxic").agg(F.min("text").alias("text"))
    found = sorted(rows.select("h", "doc_id", "toxic", "text").collect(), key=lambda r: (r["h"], r["doc_id"]))
    return [r["text"] for r in found if not r["toxic"]], [r["text"] for r in found if r["toxic"]]


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every row."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        scores: list[float] = []
        for _, texts in common.text_pieces(b):
            scores += map(model.score, texts)
        return pa.RecordBatch.from_arrays([common.column(b, "doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), batch, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    return score_documents(docs, train(*training_sample(docs, labels, sample)))
