"""Line dedup by a tree of line templates.

A line's path in the tree has a fixed depth: its number of tokens, then its first token, where a token that has a digit is a wildcard.
The path ends in a leaf.  In a leaf, lines are taken in the order of their hashes: a line that agrees with a template's first line in
``SIMILARITY`` of all tokens, place by place, joins the template (the first such), and else founds one.  A template found in ``min_docs``
documents or more is recurring: its lines are dropped from every document but the first that has it.

Leaves of too few documents fall away first, as no template of theirs can recur; of the rest, each distinct line is one row, so a passage
that a third of the documents share is one row as well.  A leaf of at most ``PART_LINES`` distinct lines is merged in one task.  A larger
one is dealt by bands: of lines that may differ in m places, each is cut into m + 1 bands, so two that agree share a band, and only lines that
share one are compared.  Founders are then found by rounds (no earlier line that is open agrees), with the same templates as in one task.

A line is told by 64 bits of a hash, a token behind the path by 16.  Texts move once, to meet the places of their dropped lines.

Defined results.  Lines without a token have no path and stay.  A line of one or two tokens that all have digits is told by the tokens as
they are.  Lines that differ in the first token are not merged, nor are lines of different numbers of tokens.  Null text stays null.  A
text of which all lines are dropped is empty.  Empty table: no rows.  Copies: their lines stay in the first alone, "first" by ``doc_id``,
null last; rows that share an id count as one document, and each is rewritten by its own text.  All columns are kept.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import common

MIN_DOCS = 2
SIMILARITY = 0.8
WILDCARD = b"<*>"
#: Distinct lines that one task compares with one another.
PART_LINES = 2000
#: Bytes of banded rows that are handed on at once.
BAND_BYTES = 4 << 20

_DIGIT = re.compile(rb"\d")


def tokens_of(line: bytes) -> list[bytes]:
    words = line.split()
    if _DIGIT.search(line):
        tokens = [WILDCARD if _DIGIT.search(w) else w for w in words]
        return words if len(words) < 3 and all(t is WILDCARD for t in tokens) else tokens
    return words


def may_differ(n_tokens: int, similarity: float = SIMILARITY) -> int:
    """The places in which a line may differ from its template's first."""
    return n_tokens - math.ceil(similarity * n_tokens - 1e-9)


def _hash(data: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def line_rows(text: str) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(place, tokens, leaf, line, tail) of every line that has a token; the tail is 16 bits for each token but the first."""
    for place, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        tokens = tokens_of(line)
        n = len(tokens)
        if n:
            yield place, n, _hash(b"%d %b" % (n, tokens[0])), _hash(b" ".join(tokens)), array("H", [zlib.crc32(t) & 0xFFFF for t in tokens[1:]]).tobytes()


_LINES = "doc long, version long, place int, n int, leaf long, line long, tail binary"


def _lines_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    row: list[int] = []
    columns: tuple[list, ...] = ([], [], [], [], [])
    for at, texts in common.text_pieces(batch):
        for i, text in enumerate(texts, at):
            found = list(line_rows(text))
            row += [i] * len(found)
            for c, values in zip(columns, zip(*found, strict=True), strict=False):
                c += values
    taken = pa.array(row, pa.int64())
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    arrays = [common.column(batch, "doc").take(taken), common.column(batch, "version").take(taken), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
    return pa.RecordBatch.from_arrays(arrays, names=["doc", "version", "place", "n", "leaf", "line", "tail"])


def merge_leaf(n: int, tails: np.ndarray, similarity: float = SIMILARITY) -> list[int]:
    """For each row of token codes the row that founded its template: the first founder with which it agrees, or itself."""
    most = may_differ(n, similarity)
    if not most:
        return list(range(len(tails)))
    known, founders, of = np.empty_like(tails), [], []
    for i, tail in enumerate(tails):
        near = (known[: len(founders)] != tail).sum(axis=1) <= most
        at = int(near.argmax()) if founders else 0
        if founders and near[at]:
            of.append(founders[at])
        else:
            known[len(founders)] = tail
            founders.append(i)
            of.append(i)
    return of


def _codes(tails: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(tails), dtype="<u2").reshape(len(tails), -1)


def _by_group(columns: tuple[str, ...], of_group, names: tuple[str, ...]):
    """Rows come sorted by the first column; ``of_group`` turns one group's rows into rows of longs.  Only one group is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            found = list(zip(*out, strict=True)) if out else [()] * len(names)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=list(names))

        group: list[tuple] = []
        for batch in batches:
            for r in zip(*(common.column(batch, c).to_pylist() for c in columns), strict=True):
                if group and r[0] != group[0][0]:
                    out += of_group(group)
                    group = []
                    if len(out) >= 8192:
                        yield flush()
                group.append(r)
        if group:
            out += of_group(group)
        yield flush()

    return run


def _merge_groups(similarity: float):
    def of_group(group: list[tuple]) -> list[tuple]:
        if len(group) == 1:
            return [(group[0][1], group[0][1])]
        return [(g[1], group[f][1]) for g, f in zip(group, merge_leaf(group[0][2], _codes([g[3] for g in group]), similarity), strict=True)]

    return _by_group(("leaf", "line", "n", "tail"), of_group, ("line", "template"))


def _agreeing(similarity: float, founders_only: bool):
    """For each line the first line of its group that agrees with it: of those before it, or, for lines that aren't founders, of the founders."""

    def of_group(group: list[tuple]) -> list[tuple]:
        most, tails, out = may_differ(group[0][2], similarity), _codes([g[3] for g in group]), []
        chosen = [i for i, g in enumerate(group) if g[4]]
        among = tails[chosen]
        for i, g in enumerate(group):
            if founders_only and g[4]:
                continue
            near = ((among if founders_only else tails[:i]) != tails[i]).sum(axis=1) <= most
            if near.any():
                at = int(near.argmax())
                out.append((g[1], group[chosen[at] if founders_only else at][1]))
        return out

    return _by_group(("grp", "line", "n", "tail", "founder"), of_group, ("line", "other"))


def _banded(similarity: float):
    """A row for each band of each line."""
    names = ["grp", "line", "n", "tail"]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for leaf, line, n, tail in zip(*(common.column(batch, c).to_pylist() for c in ("leaf", "line", "n", "tail")), strict=True):
                bands, places = may_differ(n, similarity) + 1, n - 1
                for b in range(bands):
                    band = tail[2 * (b * places // bands) : 2 * ((b + 1) * places // bands)]
                    out.append((_hash(b"%d %d %b" % (leaf, b, band)), line, n, tail))
                    held += len(tail) + 20
                    if held > BAND_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def _large_leaves(lines: DataFrame, similarity: float, part_lines: int) -> DataFrame:
    """``line`` and ``template`` of lines that are too many for a task."""
    shuffles = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = common.materialize(lines.mapInArrow(_banded(similarity), "grp long, line long, n int, tail binary"), "bands")
    sizes = common.materialize(keyed.groupBy("grp").count().where("count > 1").select("grp", F.ceil(F.col("count") * 2 / part_lines).cast("int").alias("blocks"), "count"), "band-sizes")
    # a group of too many lines is cut into blocks, and every pair of blocks is a group; a row goes to each pair that its block is in
    own = F.pmod(F.xxhash64("line"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("grp", F.least(o, F.col("own")), F.greatest(o, F.col("own"))))
    marked = keyed.join(sizes.hint("merge"), "grp").withColumn("own", own)
    grouped = common.materialize(marked.select(F.explode(F.when(F.col("count") <= part_lines, F.array("grp")).otherwise(pairs)).alias("grp"), "line", "n", "tail"), "grouped")

    def agreeing(rows: DataFrame, founders_only: bool) -> DataFrame:
        dealt = rows.select("grp", "line", "n", "tail", "founder").repartition(shuffles, "grp").sortWithinPartitions("grp", "line")
        return dealt.mapInArrow(_agreeing(similarity, founders_only), "line long, other long")

    founders, open_ = None, common.materialize(lines.select("line"), "open")
    while not open_.isEmpty():
        rows = grouped.join(open_.hint("merge"), "line", "left_semi")
        blocked = common.materialize(agreeing(rows.withColumn("founder", F.lit(False)), False).select("line").distinct(), "blocked")
        new = common.materialize(open_.join(blocked.hint("merge"), "line", "left_anti"), "founders")
        founders = new if founders is None else founders.unionByName(new)
        told = rows.join(new.withColumn("founder", F.lit(True)).hint("merge"), "line", "left").withColumn("founder", F.col("founder").isNotNull())
        open_ = common.materialize(blocked.join(agreeing(told, True).select("line").distinct().hint("merge"), "line", "left_anti"), "open")
    if founders is None:
        return lines.select("line", F.col("line").alias("template"))
    told = grouped.join(founders.withColumn("founder", F.lit(True)).hint("merge"), "line", "left").withColumn("founder", F.col("founder").isNotNull())
    joined = agreeing(told, True).groupBy("line").agg(F.min("other").alias("template"))
    return founders.select("line", F.col("line").alias("template")).unionByName(joined)


def line_templates(lines: DataFrame, similarity: float = SIMILARITY, part_lines: int = PART_LINES) -> DataFrame:
    """``lines(leaf, line, n, tail)``, lines distinct, to ``line`` and ``template``."""
    shuffles = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    large = common.materialize(lines.groupBy("leaf").count().where(F.col("count") > part_lines).select("leaf"), "large-leaves")
    some = not large.isEmpty()
    small = lines.join(large, "leaf", "left_anti") if some else lines
    dealt = small.select("leaf", "line", "n", "tail").repartition(shuffles, "leaf").sortWithinPartitions("leaf", "line")
    merged = dealt.mapInArrow(_merge_groups(similarity), "line long, template long")
    return merged.unionByName(_large_leaves(lines.join(large, "leaf", "left_semi"), similarity, part_lines)) if some else merged


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> DataFrame:
    """``doc``, ``version`` (hash of the text) and the sorted ``places`` of lines to drop, for documents that have any."""
    common.prepare(docs.sparkSession)
    source = docs.select(_doc().alias("doc"), F.xxhash64("text").alias("version"), "text").where("text IS NOT NULL")
    lines = common.materialize(common.map_batches(source, _lines_batch, _LINES), "lines")
    # written first, so that Spark can split the join for a leaf of very many lines
    shared = common.materialize(lines.select("leaf", "doc").distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf"), "leaves")
    near = common.materialize(lines.select("leaf", "line", "doc", "version", "place").join(shared.hint("merge"), "leaf", "left_semi").drop("leaf"), "near")
    each = lines.groupBy("leaf", "line").agg(F.first("n").alias("n"), F.first("tail").alias("tail"))
    distinct = common.materialize(each.join(shared.hint("merge"), "leaf", "left_semi"), "distinct")
    templates = common.materialize(line_templates(distinct, similarity), "lines-of-templates")
    found = near.join(templates.hint("merge"), "line").select("template", "doc", "version", "place")
    recurring = found.groupBy("template", "doc").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("docs"), F.min("doc").alias("first")).where(F.col("docs") >= min_docs)
    drops = found.join(common.materialize(recurring.select("template", "first"), "recurring").hint("merge"), "template").where("doc <> first")
    return drops.groupBy("doc", "version").agg(F.array_sort(F.collect_set("place")).alias("places"))


def _doc():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))


def drop_recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY, count_as: str | None = None) -> DataFrame:
    """``docs`` with the texts rewritten; ``count_as`` names a column for the number of dropped lines."""
    drops = dropped_lines(docs, min_docs, similarity).select(F.col("doc").alias("__doc"), F.col("version").alias("__version"), F.col("places").alias("__places"))
    keyed = docs.select(F.struct(*docs.columns).alias("__row"), _doc().alias("__doc"), F.xxhash64("text").alias("__version"))
    joined = keyed.join(drops.hint("merge"), ["__doc", "__version"], "left")
    lines = F.split(F.col("__row.text"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__places"))
    text = F.when(F.col("__places").isNull(), F.col("__row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    counted = [F.coalesce(F.size("__places"), F.lit(0)).alias(count_as)] if count_as else []
    return joined.select(*(text.alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns), *counted)
