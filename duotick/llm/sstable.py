"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of ``doc_id``:

    data blocks | block index | Bloom filter | footer

An entry of a data block is: bytes of the key shared with the one before, the count of its other bytes, bytes of the value
(all varints), the other key bytes, the value.  The first entry of a block shares none.  A block is compressed on its own.  The index has, for each
block, its last key and its place, so a key's block is found by binary search; the Bloom filter answers most absent keys.  The
fixed-size footer tells where both are, and the width of an id.

The key is ``doc_id`` as 9 bytes that sort as the numbers do (null first).

Documents are dealt by ranges of ``doc_id``: one shard each, in order, so the ids before a document are those of earlier shards,
from a manifest of one row for each shard, and of earlier documents in its own.

Defined results.  Null or empty text: the end id alone.  Empty table: no shard, no rows.  Repeated ``doc_id``: every row is kept, in
order of its ids; lookup gives them all.  Null ``doc_id``: before all others.  Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, encoding, shared_files

MAGIC = b"DTSST001"
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQB7x8s")  # index at, size; filter at, size; documents, ids; bytes of an id; magic


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def doc_id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    def __init__(self, out, width: int):
        self._out, self._width = out, width
        self._block, self._last, self._size = [], b"", 0
        self._at, self._index, self._keys = 0, [], []
        self._pack = zstandard.ZstdCompressor(level=1)
        self.documents = self.ids = 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self._block:
            while shared < len(key) and shared < len(self._last) and key[shared] == self._last[shared]:
                shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self._block += [entry, value]
        self._size += len(entry) + len(value)
        if not self._keys or self._keys[-1] != key:
            self._keys.append(key)
        self._last = key
        self.documents += 1
        self.ids += len(value) // self._width
        if self._size >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> tuple[int, int]:
        at = self._at
        self._out.write(data)
        self._at += len(data)
        return at, len(data)

    def _flush(self) -> None:
        if self._block:
            at, size = self._write(self._pack.compress(b"".join(self._block)))
            self._index.append(_varint(len(self._last)) + self._last + _varint(at) + _varint(size))
            self._block, self._size = [], 0

    def finish(self) -> None:
        self._flush()
        index = self._write(b"".join(self._index))
        bits = max(64, BLOOM_BITS * len(self._keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self._keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at, bloom_size = self._write(bits.to_bytes(8, "little") + bytes(bloom))
        self._write(_FOOTER.pack(*index, bloom_at, bloom_size, self.documents, self.ids, self._width, MAGIC))


class ShardReader:
    """Reads the footer, the index and the filter once; blocks as they are asked for."""

    def __init__(self, file):
        self._file = file
        size = file.size()
        index_at, index_size, bloom_at, bloom_size, self.documents, self.ids, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self._last_keys: list[bytes] = []
        self._places: list[tuple[int, int]] = []
        index, at = self._read(index_at, index_size), 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self._last_keys.append(index[at : at + n])
            place, at = _read_varint(index, at + n)
            length, at = _read_varint(index, at)
            self._places.append((place, length))
        bloom = self._read(bloom_at, bloom_size)
        self._bits, self._bloom = int.from_bytes(bloom[:8], "little"), bloom[8:]
        self._unpack = zstandard.ZstdDecompressor()

    def _read(self, at: int, size: int) -> bytes:
        self._file.seek(at)
        return self._file.read(size)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        data, at, key = self._unpack.decompress(self._read(*self._places[block])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self._places)):
            yield from self._entries(block)

    def may_have(self, key: bytes) -> bool:
        return all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self._bits))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row of ``doc_id``: none if there is no such document."""
        key, out = key_of(doc_id), []
        if not self.may_have(key):
            return out
        for block in range(bisect_left(self._last_keys, key), len(self._places)):
            for k, value in self._entries(block):
                if k > key:
                    return out
                if k == key:
                    out.append(np.frombuffer(value, dtype=f"<u{self.width}"))
        return out


# -- the operator -----------------------------------------------------------------------------------------------------------


def shard_bounds(docs: DataFrame, shards: int) -> np.ndarray:
    """The first ``doc_id`` of every shard but the first, from a quantile sketch over all ids: ``shards - 1`` numbers at most."""
    if shards < 2:
        return np.zeros(0, dtype=np.int64)
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / shards for i in range(1, shards)], min(100 * shards, 100_000)).alias("q")).first()["q"]
    return np.unique(np.array([c for c in cuts or [] if c is not None], dtype=np.int64))


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, shards: int) -> DataFrame:
    """Writes one file for each non-empty range of ids; returns the manifest: shard, file, documents, ids, in a stored table."""
    bounds = shard_bounds(docs, shards)

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoding.encoder(tokenizer_path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        values: list[bytes] = []
        for _, texts in common.text_pieces(batch):
            values += [enc.encode(t) + end for t in texts]
        doc_id = common.column(batch, "doc_id")
        shard = np.searchsorted(bounds, doc_id.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(shard), doc_id, pa.array(values, pa.binary())], names=["shard", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = int(encoding.encoder(tokenizer_path).dtype[-1])
        done = []

        def rows() -> Iterator[tuple[int, int | None, bytes]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield from zip(*(common.column(part, c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True)

        stream = rows()
        row = next(stream, None)
        while row is not None:
            shard, name = row[0], f"shard-{row[0]:06d}.sst"
            with shared_files.atomic_writer(folder, name) as out:
                writer = ShardWriter(out, width)
                while row is not None and row[0] == shard:
                    writer.add(key_of(row[1]), row[2])
                    row = next(stream, None)
                writer.finish()
            done.append((shard, name, writer.documents, writer.ids))
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "file", "documents", "ids"), d, strict=True)) for d in done], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = common.map_batches(source, encode, "shard int, doc_id long, ids binary").repartitionById(len(bounds) + 1, F.col("shard"))
    return common.materialize(dealt.sortWithinPartitions("shard", "doc_id", "ids").mapInArrow(write, "shard int, file string, documents long, ids long"), "manifest")


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` crc of every document, from the files."""
    files = [tuple(r) for r in manifest.orderBy("shard").select("file", "ids").collect()]  # a row for each shard
    starts = np.concatenate([[0], np.cumsum([n for _, n in files])]).tolist()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(common.column(batch, "file").to_pylist(), common.column(batch, "start").to_pylist(), strict=True):
                with shared_files.open_file(folder, name) as file:
                    reader = ShardReader(file)
                    rows: list[tuple] = []
                    for key, value in reader:
                        n = len(value) // reader.width
                        rows.append((doc_id_of(key), at, n, zlib.crc32(np.frombuffer(value, dtype=f"<u{reader.width}").astype("<u4").tobytes())))
                        at += n
                        if len(rows) == 8192:
                            yield _as_batch(rows)
                            rows = []
                    yield _as_batch(rows)

    if not files:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(name, start) for (name, _), start in zip(files, starts, strict=False)], "file string, start long")
    return listed.repartition(max(1, min(len(files), 4096))).mapInArrow(read, schema)


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shards: int | None = None, folder: str | None = None) -> DataFrame:
    """Write all documents to shards and read every one back."""
    spark = docs.sparkSession
    folder = folder or common.scratch_path(spark, "sst")
    common.prepare(spark)
    shards = shards or common.partitions_for(docs)
    return read_shards(spark, folder, write_shards(docs, folder, tokenizer_path, end_id, shards))
