"""Near-duplicates by word shingles: documents whose sets of shingles have a Jaccard similarity of ``PERCENT`` or more.

Candidates come from two sides, and every link is held against the whole sets.  First the SimHash operator: fingerprints of the same
shingles within three bits, found by Golay keys; it brings most near copies into few components cheaply.  At this similarity
fingerprints may differ in ten bits and more, so the links that it can't see are then found by the sets themselves:

- Two similar sets of a and b shingles differ in at most 1/9 of a + b, and a set of n lacks at most n - ceil(0.8 n) of its shingles in
  the other.  This also holds for the shingles in a fixed range of hashes (``SHARE``).  So a document of which more of these are in no other
  document has no partner at all; documents are sifted by this until few remain.
- Of a document that remains, the rarest n - ceil(0.8 n) + 1 shingles of the range are its keys, so a passage that very many documents share is a
  key only for documents made of such passages.  Two similar documents share a key.
- A document with too few shingles in the range for that many keys has all of them as keys, and takes part a second time, among its like, with the range of all
  hashes.  So no link is lost.

Documents with a common key, not yet in one component, are compared by bits: each has a sketch whose bit i is the parity of the shingles that fall on i.  Sketches
differ in at most as many bits as sets in shingles, so what they rule out is no link.  A key of very many documents is compared in blocks.

Equal sets are one class.

Defined results.  A text of fewer words than a shingle has is one shingle; null and wordless texts are one class.  Null ``doc_id``: the row
stays.  Rows that share an id but not their set are told apart.  Words are cut at ASCII white space, and capitals of ASCII count as small letters,
as in ``simhash_golay``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common, simhash_golay
from .components import connected_components

SHINGLE_WORDS = 5
#: Similarity in percent, so that bounds are whole numbers.
PERCENT = 80
#: The share of all hashes that is in the range.
SHARE = 0.3
#: Times that documents are sifted; any number gives the same links.
SIFTS = 1
#: Bits of a sketch at least and at most: as many as the set has shingles, but longer ones would outweigh what they spare.
SKETCH_BITS = (64, 2048)
#: Documents of one key that one task compares.
BLOCK = 2048


def may_lack(n, percent: int = PERCENT):
    """Shingles of a set of n that a similar one may lack."""
    return n - -(-percent * n // 100)


def parity(found: np.ndarray) -> bytes:
    """Bit ``h mod bits`` is the parity of the hashes that fall on it."""
    least, most = SKETCH_BITS
    bits = min(most, max(least, 1 << max(0, len(found) - 1).bit_length()))
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, pa.int64()))


def _class_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) >> 1


_CLASSES = "first struct<doc_id: long, version: long>, cls long, n int, fp long, parity binary, low array<long>, full array<long>"


def _classes(shingle_words: int, percent: int, share: float):
    below = np.uint64(min(int(share * (1 << 64)), (1 << 64) - 1))
    none = np.zeros(0, dtype=np.uint64)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        cls, sizes, prints, sketch, low, full = [], [], [], [], [], []
        for _, texts in common.text_pieces(batch):
            for text in texts:
                hashes = simhash_golay.shingle_hashes(text, shingle_words)
                found = np.unique(hashes)
                inside = found[: int(np.searchsorted(found, below))]
                cls.append(_class_of(found))
                sizes.append(len(found))
                prints.append(simhash_golay.fingerprint_of(hashes))
                sketch.append(parity(found))
                low.append(inside)
                # too few for its keys: again with all hashes
                full.append(found if len(inside) <= may_lack(len(found), percent) else none)
        arrays = [common.column(batch, "first"), pa.array(cls, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(sketch, pa.binary()), _lists(low), _lists(full)]
        return pa.RecordBatch.from_arrays(arrays, names=["first", "cls", "n", "fp", "parity", "low", "full"])

    return run


def _sets(shingle_words: int):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(simhash_golay.shingle_hashes(t, shingle_words)) for _, texts in common.text_pieces(batch) for t in texts]
        return pa.RecordBatch.from_arrays([common.column(batch, "doc_id"), pa.array(map(_class_of, found), pa.int64()), _lists(found)], names=["doc_id", "cls", "hashes"])

    return run


def _similar(pairs: DataFrame, docs: DataFrame, classes: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The pairs ``(src, dst)`` of classes that are similar enough, by their whole sets."""
    wanted = common.materialize(pairs.select(F.explode(F.array("src", "dst")).alias("cls")).distinct().join(classes.select("cls", "doc_id"), "cls"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    sets = common.map_batches(texts, _sets(shingle_words), "doc_id long, cls long, hashes array<long>")
    # rows that share an id may have other sets
    sets = common.materialize(sets.join(wanted, ["cls", "doc_id"], "left_semi").dropDuplicates(["cls"]).select("cls", "hashes"), "sets")
    one, two = sets.select(F.col("cls").alias("src"), F.col("hashes").alias("a")), sets.select(F.col("cls").alias("dst"), F.col("hashes").alias("b"))
    both = pairs.join(one.hint("merge"), "src").join(two.hint("merge"), "dst")
    shared = F.size(F.array_intersect("a", "b"))
    return common.materialize(both.where((100 + percent) * shared >= percent * (F.size("a") + F.size("b"))).select("src", "dst"), "links")


def golay_candidates(classes: DataFrame) -> DataFrame:
    """Pairs of classes whose fingerprints are equal or linked by the SimHash operator."""
    prints = common.materialize(classes.groupBy("fp").agg(F.min("cls").alias("rep")), "fingerprints")
    equal = classes.select("cls", "fp").join(prints.hint("merge"), "fp").where("cls <> rep").select(F.col("rep").alias("src"), F.col("cls").alias("dst"))
    return common.materialize(simhash_golay.fingerprint_links(prints).unionByName(equal), "candidates")


def rare_keys(classes: DataFrame, percent: int = PERCENT, sifts: int = SIFTS) -> DataFrame:
    """``key`` and ``cls``: the keys that two classes or more have, of classes that may have a partner."""
    first = classes.select(F.col("cls").alias("ent"), "cls", "n", F.col("low").alias("keys"))
    again = classes.where("size(full) > 0").select(F.xxhash64("cls").alias("ent"), "cls", "n", F.transform("full", lambda h: F.xxhash64(h)).alias("keys"))
    entities = first.unionByName(again).select("ent", "cls", F.size("keys").alias("size"), (F.col("n") - F.ceil(percent * F.col("n") / 100)).cast("int").alias("lacks"), "keys")
    sizes = entities.select("ent", "cls", "size", "lacks")
    rows = entities.select("ent", F.explode("keys").alias("key"))
    for sift in range(sifts + 1):
        shared = common.materialize(rows.groupBy("key").agg(F.count("*").alias("docs")).where("docs > 1"), "shared-keys")
        rows = common.materialize(rows.select("ent", "key").join(shared.hint("merge"), "key"), "keys")
        common.free_shuffles(classes.sparkSession)
        counts = rows.groupBy("ent").agg(F.count("*").alias("held")).join(sizes.hint("merge"), "ent").where("held >= size - lacks")
        kept = common.materialize(counts.select("ent", "cls", (F.col("lacks") + 1 - F.col("size") + F.col("held")).alias("take")), "kept")
        rows = rows.join(kept.hint("merge"), "ent")
    nth = F.row_number().over(Window.partitionBy("ent").orderBy("docs", "key"))
    return common.materialize(rows.withColumn("nth", nth).where("nth <= take").select("key", "cls"), "rare-keys")


def likely_pairs(n: np.ndarray, part: np.ndarray, sketches: list[bytes], percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places of others) that sizes and sketches don't rule out, of different parts; each pair once."""
    order = np.argsort(n, kind="stable")
    n, part = n[order].astype(np.int64), part[order]
    width = np.array([len(sketches[i]) for i in order])
    stop = np.searchsorted(n, 100 * n // percent, side="right")
    tables = {}
    for w in np.unique(width).tolist():
        table = np.zeros((len(n), w // 8), dtype=np.uint64)
        for k in np.flatnonzero((width == w) | (width == 2 * w)).tolist():
            words = np.frombuffer(sketches[order[k]], dtype="<u8")
            table[k] = words if len(words) == w // 8 else words[: w // 8] ^ words[w // 8 :]
        tables[w] = table
    for i in range(len(n)):
        others = slice(i + 1, int(stop[i]))  # at most 1.25 times as large, so their sketches are as wide or twice
        table = tables[int(width[i])]
        differ = np.bitwise_count(table[others] ^ table[i]).sum(axis=1, dtype=np.int64)
        near = ((100 + percent) * differ <= (100 - percent) * (n[others] + n[i])) & (part[others] != part[i])
        if near.any():
            yield int(order[i]), order[np.flatnonzero(near) + i + 1]


def _compare_groups(percent: int):
    """Rows come sorted by ``grp``; only one group is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def pairs() -> pa.RecordBatch:
            cls, n, part = (np.array(c, dtype=np.int64) for c in list(zip(*group, strict=True))[1:4])
            src, dst = [], []
            for i, others in likely_pairs(n, part, [g[4] for g in group], percent):
                src.append(np.minimum(cls[i], cls[others]))
                dst.append(np.maximum(cls[i], cls[others]))
            flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64))
            return pa.RecordBatch.from_arrays([flat(src), flat(dst)], names=["src", "dst"])

        for batch in batches:
            for row in zip(*(common.column(batch, c).to_pylist() for c in ("grp", "cls", "n", "part", "parity")), strict=True):
                if group and row[0] != group[0][0]:
                    if len(group) > 1:
                        yield pairs()
                    group = []
                group.append(row)
        if len(group) > 1:
            yield pairs()

    return run


def rare_candidates(classes: DataFrame, parts: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Pairs of classes in different ``parts(node, component)`` that share a key and that sketches don't rule out."""
    keys = rare_keys(classes, percent)
    told = keys.join(parts.hint("merge"), F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("component", "cls").alias("part"))
    told = common.materialize(told, "told")
    mixed = common.materialize(told.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key"), "mixed")
    facts = classes.select("cls", "n", "parity")
    left = common.materialize(told.join(mixed.hint("merge"), "key", "left_semi").join(facts.hint("merge"), "cls").select("key", "cls", "n", "part", "parity"), "compared")
    tasks = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = common.in_blocks(left, "cls", block, ["cls", "n", "part", "parity"]).repartition(tasks, "grp").sortWithinPartitions("grp")
    return common.materialize(dealt.mapInArrow(_compare_groups(percent), "src long, dst long").distinct(), "pairs")


def _version() -> Column:
    return F.xxhash64("text").alias("version")


def near_duplicate_classes(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT, share: float = SHARE, block: int = BLOCK) -> DataFrame:
    """``cls``, the least ``first(doc_id, version)`` of the class and its ``component``; the version is a hash of the text."""
    spark = docs.sparkSession
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), _version()).alias("first"), "text").where("first.doc_id IS NOT NULL")
    found = common.map_batches(rows, _classes(shingle_words, percent, share), _CLASSES)
    same = (F.first(c).alias(c) for c in ("n", "fp", "parity", "low", "full"))
    classes = common.materialize(found.groupBy("cls").agg(F.min("first").alias("first"), *same).withColumn("doc_id", F.col("first.doc_id")), "classes")
    common.free_shuffles(spark)
    near = _similar(golay_candidates(classes), docs, classes, shingle_words, percent)
    common.free_shuffles(spark)
    parts = common.materialize(connected_components(near), "parts")
    rest = _similar(rare_candidates(classes, parts, percent, block), docs, classes, shingle_words, percent)
    parts = connected_components(near.unionByName(rest))
    return classes.select("cls", "first").join(parts.hint("merge"), F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("component", "cls").alias("component"))


def one_of_each_component(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component: the one with the least ``doc_id``.

    Rows that repeat its id and text count once; rows without an id can't be told from others and all stay.
    """
    least = near_duplicate_classes(docs, shingle_words, percent).groupBy("component").agg(F.min("first").alias("first"))
    keep = common.materialize(least.select("first.doc_id", "first.version").distinct(), "keep")
    common.free_shuffles(docs.sparkSession)
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _version())
    kept = keyed.join(keep.hint("merge"), ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"])
    return kept.select("row.*").unionByName(docs.where("doc_id IS NULL"))
