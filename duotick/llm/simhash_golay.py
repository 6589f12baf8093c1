"""Near-duplicates by SimHash: fingerprints of 64 bits, joined through keys of the Golay code.

The fingerprint is cut into four segments of 16 bits.  Of three differing bits at most three segments have any, so some
segment is equal while its successor (cyclically) has at most one: if segment z is equal and its successor has two or more, at
most one further segment differs, and the equal one among the remaining two has a successor with at most one.  A key is
therefore the number and value of a segment with one Golay index of the next (``golay.keys``): fingerprints that link share
one.  Fingerprints with a common key are compared bit by bit, so links are exact.

Only distinct fingerprints are joined, each standing for its documents by the least ``doc_id``.  A key's fingerprints yield a
spanning forest of their links, not all pairs.  A key of more than ``block`` fingerprints is cut into blocks, and each pair of blocks
is compared in a task of its own.

Defined results.  Null or wordless text: fingerprint zero, linked like any other.  Empty table: no rows.  Repeated rows: a row
each, in one component.  Null ``doc_id``: its row stays; a component whose ids are all null has none.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common, golay
from .components import connected_components

SEED = 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Fingerprints of one key that one task compares.
BLOCK = 4096


def shingle_hashes(text: str, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included; unsigned."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle_words:
        return np.array([digest(flat, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-shingle_words]]).tolist()
    stops = (ends[shingle_words - 1 :] - 1).tolist()
    return np.array([digest(flat[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)


def fingerprint(text: str, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64 bits: a bit is set if over half of the shingles' hashes have it."""
    return fingerprint_of(shingle_hashes(text, shingle_words))


def fingerprint_of(hashes: np.ndarray) -> int:
    """A bit is set if over half of the unsigned hashes have it."""
    hashes = hashes.astype("<u8")
    set_in = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * set_in > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _fingerprint_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    prints: list[int] = []
    for _, texts in common.text_pieces(batch):
        prints += map(fingerprint, texts)
    return pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""
    return common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _fingerprint_batch, "doc_id long, fp long")


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of unsigned fingerprints: 2 bits of segment number, 16 of its value, 12 of the next one's index."""
    table = golay.keys(16)
    rows, found = [], []
    segment = [(prints >> np.uint64(16 * s)).astype(np.uint16) for s in range(4)]
    for s in range(4):
        index = table[segment[(s + 1) % 4]]
        r, k = np.nonzero(index >= 0)
        rows.append(r)
        found.append((np.int64(s) << 28) | (segment[s][r].astype(np.int64) << 12) | index[r, k].astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def _keys_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    prints = common.column(batch, "fp").to_numpy(zero_copy_only=False).astype(np.int64)
    row, key = golay_keys(prints.view(np.uint64))
    rep = common.column(batch, "rep").to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(prints[row]), pa.array(rep[row])], names=["key", "fp", "rep"])


def _forest(prints: np.ndarray, reps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that span each component of fingerprints within ``max_bits``."""
    n = len(prints)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= max_bits)
        for j in (near + i + 1).tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                out.append((int(reps[i]), int(reps[j])))
    return out


def _links_of_groups(max_bits: int):
    """Rows come sorted by ``grp``; groups run on from batch to batch, and only the last one is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * 3

        def links(group: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(group)) + 1
            starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(group)]])
            src: list[int] = []
            dst: list[int] = []
            sizes = stops - starts
            # pairs of two, by far the most groups, at once
            two = starts[sizes == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= max_bits]
            src += rep[near].tolist()
            dst += rep[near + 1].tolist()
            for a, b in zip(starts[sizes > 2].tolist(), stops[sizes > 2].tolist(), strict=True):
                for x, y in _forest(fp[a:b], rep[a:b], max_bits):
                    src.append(x)
                    dst.append(y)
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

        for batch in batches:
            now = [common.column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("grp", "fp", "rep")]
            group, fp, rep = (np.concatenate([a, b]) for a, b in zip(kept, now, strict=True))
            if not len(group):
                continue
            last = int(np.searchsorted(group, group[-1]))
            if last:
                yield links(group[:last], fp[:last].view(np.uint64), rep[:last])
            kept = [group[last:], fp[last:], rep[last:]]
        if len(kept[0]):
            yield links(kept[0], kept[1].view(np.uint64), kept[2])

    return run


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``prints(fp, rep)``, fp distinct, to links ``(src, dst)`` between reps that span every component within ``max_bits``."""
    keyed = common.map_batches(prints.select("fp", "rep"), _keys_batch, "key long, fp long, rep long")
    grouped = common.in_blocks(keyed, "fp", block, ["fp", "rep"])
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grouped.repartition(n, "grp").sortWithinPartitions("grp").mapInArrow(_links_of_groups(max_bits), "src long, dst long").distinct()


def near_duplicate_components(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``fp`` (signed long) and ``component_id`` of every row."""
    prints = common.materialize(fingerprints(docs), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    links = fingerprint_links(classes.where("rep IS NOT NULL"), max_bits)
    parts = connected_components(links)
    of_class = classes.join(parts, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("cfp"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of_class, F.col("fp") == F.col("cfp")).select("doc_id", "fp", "component_id")


def one_of_each_component(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component: the one whose ``doc_id`` is the component's, the least.

    Rows that repeat this id count once; rows without an id can't be told from others and all stay.
    """
    keep = common.materialize(near_duplicate_components(docs, max_bits).where("doc_id = component_id").select("doc_id").distinct(), "keep")
    kept = docs.join(keep.hint("merge"), "doc_id", "left_semi")
    return kept.dropDuplicates(["doc_id"]).select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
