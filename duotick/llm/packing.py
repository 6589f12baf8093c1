"""Packing of token sequences by non-negative least squares over the histogram of lengths.

A document is cut at multiples of the window, so all its pieces but the last fill one by themselves.  The lengths of the pieces
make a histogram of at most ``window`` entries, all that reaches the driver.  Shallow combinations of two or three lengths
that fill a window exactly are its columns; their repeat counts solve a non-negative least squares problem, are rounded to what
the histogram holds, and the residue is packed greedily, best fit first.  The plan maps (length, rank among the pieces
of that length) to a place; its size is bounded by the number of combinations, however many pieces there are.

Ranks come from counts for each (length, salt), so a length that a third of the pieces share is numbered by many tasks.

Defined results.  Null or empty text: one piece, the end id alone.  Empty table: no rows.  Repeated rows: pieces for each.  Null
``doc_id``: packed like any other, with a null id.  Other columns are ignored.  Only the last sequences have padding.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import common, encoding

WINDOW = 1024
PIECES_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def crc32_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document; with ``keep_ids`` also their ids, as little-endian unsigned integers of 32 bits."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding.encoder(tokenizer_path)
        doc_ids = common.column(batch, "doc_id")
        row, start, length, crc, total, raw = [], [], [], [], [], []
        for at, texts in common.text_pieces(batch):
            for i, text in enumerate(texts, at):
                ids = np.append(np.frombuffer(enc.encode(text), dtype=enc.dtype), end_id).astype("<u4")
                data = memoryview(ids.tobytes())
                for s in range(0, len(ids), window):
                    part = data[4 * s : 4 * (s + window)]
                    row.append(i)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids))
                    if keep_ids:
                        raw.append(bytes(part))
        columns = [doc_ids.take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        return pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

    return common.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, PIECES_SCHEMA + ", ids binary" * keep_ids)


# -- the plan ---------------------------------------------------------------------------------------------------------------


def combinations_of(window: int, present: np.ndarray) -> np.ndarray:
    """Every way to fill the window with two or three lengths that occur: rows of three, ascending, 0 where there are two."""
    have = np.zeros(window + 1, dtype=bool)
    have[present] = True
    have[0] = have[window] = False
    rows = []
    for a in range(window // 3 + 1):
        if a and not have[a]:
            continue
        b = np.arange(max(a, 1), (window - a) // 2 + 1)
        b = b[have[b] & have[window - a - b]]
        rows.append(np.column_stack([np.full(len(b), a), b, window - a - b]))
    return np.concatenate(rows).astype(np.int64) if rows else np.zeros((0, 3), dtype=np.int64)


def solve_nnls(combos: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """min ||A x - hist|| over x >= 0 by accelerated projected gradients; A counts the lengths of each combination, by index."""
    if not len(combos):
        return np.zeros(0)
    size = len(hist)

    def times(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(combos[:, k], weights=x, minlength=size) for k in range(3))
        y[0] = 0
        return y

    def transposed(y: np.ndarray) -> np.ndarray:
        y = np.concatenate([[0.0], y[1:]])
        return y[combos].sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(30):  # the largest eigenvalue
        v = transposed(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 0.99 / norm
    target = hist.astype(float).copy()
    target[0] = 0
    x = np.zeros(len(combos))
    z, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0.0, z - step * transposed(times(z) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / t_new * (new - x)
        if np.abs(new - x).max() < 1e-4:
            x = new
            break
        x, t = new, t_new
    return x


def _greedy(left: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit on the histogram: the longest length takes what fills its window exactly, or else the longest that fits."""
    out = []
    left = left.copy()
    while (held := np.flatnonzero(left)).size:
        first = int(held[-1])
        left[first] -= 1
        parts, gap = [first], window - first
        while gap:
            if left[gap]:
                parts.append(gap)
                left[gap] -= 1
                break
            a = np.arange(1, gap // 2 + 1)
            pair = np.flatnonzero((left[a] > 0) & (left[gap - a] > (a == gap - a)))
            if len(pair):
                a = int(pair[-1]) + 1
                parts += [gap - a, a]
                left[a] -= 1
                left[gap - a] -= 1
                break
            fits = np.flatnonzero(left[1:gap])
            if not len(fits):
                break
            parts.append(int(fits[-1]) + 1)
            left[parts[-1]] -= 1
            gap -= parts[-1]
        need = np.bincount(parts, minlength=len(left))
        used = np.flatnonzero(need)
        more = int((left[used] // need[used]).min())
        left[used] -= more * need[used]
        out.append((tuple(parts), 1 + more))
    return out


@dataclass(frozen=True)
class Plan:
    """Runs of ranks: piece ``rank`` of ``length`` lies in the run of the greatest key (length << 44 | first rank) not above its own."""

    keys: np.ndarray
    first_sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    padding: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length.astype(np.int64) << 44) | rank
        run = np.searchsorted(self.keys, key, side="right") - 1
        return self.first_sequence[run] + key - self.keys[run], self.offset[run]


def plan_packing(hist: np.ndarray, window: int = WINDOW) -> Plan:
    """``hist[l]`` pieces have length l, 1 to ``window``."""
    left = hist.astype(np.int64).copy()
    uses: list[tuple[tuple[int, ...], int]] = []
    if left[window]:
        uses.append(((window,), int(left[window])))
        left[window] = 0
    combos = combinations_of(window, np.flatnonzero(left))
    x = solve_nnls(combos, left)
    counts = np.rint(x).astype(np.int64)
    for i in np.argsort(-x, kind="stable")[: int((counts > 0).sum())].tolist():
        parts = [p for p in combos[i].tolist() if p]
        need = {p: parts.count(p) for p in parts}
        n = min(int(counts[i]), *(int(left[p]) // k for p, k in need.items()))
        if n > 0:
            uses.append((tuple(parts), n))
            for p, k in need.items():
                left[p] -= k * n
    uses += _greedy(left, window)

    taken = np.zeros(window + 1, dtype=np.int64)
    keys, first, offset = [], [], []
    sequences = padding = 0
    for parts, n in uses:
        at = 0
        for p in parts:
            keys.append((p << 44) | int(taken[p]))
            first.append(sequences)
            offset.append(at)
            taken[p] += n
            at += p
        if at & (at - 1):
            padding += n * (window - at)
        sequences += n
    order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
    pick = lambda v: np.array(v, dtype=np.int64)[order]
    return Plan(pick(keys), pick(first), pick(offset), sequences, padding)


# -- the operator -----------------------------------------------------------------------------------------------------------


def pack_pieces(pieces: DataFrame, window: int = WINDOW, rows_of_salt: int = 50_000) -> DataFrame:
    """``pieces``, a stored table with doc_id, start, length, ids_crc32, to the same with ``sequence_id`` and ``offset``."""
    lengths = pieces.groupBy("length").count().collect()  # at most ``window`` rows
    hist = np.zeros(window + 1, dtype=np.int64)
    for r in lengths:
        hist[r["length"]] = r["count"]
    plan = plan_packing(hist, window)
    salts = int(np.clip(hist.sum() // rows_of_salt, 32, 1 << 16))

    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "__salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("length", "__salt", F.coalesce(before, F.lit(0)).alias("__base"))
    within = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = salted.withColumn("__n", within).join(bases, ["length", "__salt"]).withColumn("__rank", F.col("__base") + F.col("__n") - 1)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = lambda c: common.column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64)
        sequence, offset = plan.place(values("length"), values("__rank"))
        kept = [c for c in batch.schema.names if c != "__rank"]
        return pa.RecordBatch.from_arrays([*(common.column(batch, c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    columns = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return common.map_batches(ranked.select(*columns, "__rank"), place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    pieces = common.materialize(cut_documents(docs, tokenizer_path, end_id, window, keep_ids), "pieces")
    return pack_pieces(pieces, window)


def packed_sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``sequence_id`` and ``ids`` (binary, 32 bits each): pieces joined by offset, padded unless their sum is a power of two.

    Takes pieces with their ids.  A sequence has at most ``window`` pieces, so its group is bounded.
    """
    joined = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.aggregate("p", F.expr("X''"), lambda acc, x: F.concat(acc, x["ids"]))
    used = F.octet_length("ids") / 4
    pad = F.unhex(F.expr(f"repeat(hex(X'{np.uint32(pad_id).astype('<u4').tobytes().hex()}'), int({window} - octet_length(ids) / 4))"))
    return joined.select("sequence_id", ids.alias("ids")).select("sequence_id", F.when(F.bit_count(used.cast("int")) == 1, F.col("ids")).otherwise(F.concat("ids", pad)).alias("ids"))
