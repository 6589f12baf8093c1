"""Token counts of documents from flat token files that have no index.

A file is nothing but ids, each document's followed by the end-of-document id.  Every file is read in blocks, by any task: the places of
separators in a block come from one vectorised comparison.  A document that runs over blocks is stitched by a prefix scan over the
blocks' summaries (separators so far, place of the last one), so blocks need no order of reading.

Texts are encoded with special tokens as ordinary text, so the end id occurs only as a separator.

Defined results.  Null or empty text: a document of no tokens.  Empty table: no files, no rows.  Repeated rows and null ids: a row each.
Other columns are ignored.  Ids after a file's last separator are no document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import common, encoding, shared_files

BLOCK_IDS = 1 << 21


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """One flat file for each input partition.  Returns which document is where: file, ordinal, doc_id, in a stored table.

    Each attempt of a task has a file of its own, so the table and the files it names are of the same attempts, whatever the order of a partition's rows.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding.encoder(tokenizer_path, special_as_text=True)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        name, ordinal, out = f"tokens-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin", 0, None
        with ExitStack() as closing:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if out is None:
                    out = closing.enter_context(shared_files.atomic_writer(folder, name))
                for _, texts in common.text_pieces(batch):
                    out.write(b"".join([enc.encode(t) + end for t in texts]))
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), common.column(batch, "doc_id")], names=["file", "ordinal", "doc_id"])
                ordinal += n

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.materialize(source.mapInArrow(write, "file string, ordinal long, doc_id long"), "places")


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``file`` and ``bytes`` of the files in a folder."""
    store, path = shared_files.open_folder(folder)
    found = store.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return spark.createDataFrame([(f.base_name, f.size) for f in found if f.base_name.endswith(".bin") and not f.base_name.startswith("_")], "file string, bytes long")


def scan_separators(files: DataFrame, folder: str, end_id: int, width: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``file``, ``ordinal`` and ``n_tokens`` of every document in the files; ``files(file, bytes)``, ids of ``width`` bytes."""
    common.prepare(files.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, block in zip(common.column(batch, "file").to_pylist(), common.column(batch, "block").to_pylist(), strict=True):
                with shared_files.open_file(folder, name) as file:
                    file.seek(block * block_ids * width)
                    ids = np.frombuffer(file.read(block_ids * width), dtype=f"<u{width}")
                places = np.flatnonzero(ids == end_id).astype(np.int64) + block * block_ids
                listed = pa.ListArray.from_arrays(pa.array([0, len(places)], pa.int32()), pa.array(places))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), listed], names=["file", "block", "places"])

    blocks = files.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / (block_ids * width)))).alias("block"))
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.repartition(n).mapInArrow(scan, "file string, block long, places array<long>")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.select(
        "file", "places",
        F.coalesce(F.sum(F.size("places")).over(earlier), F.lit(0)).alias("seen"),
        F.coalesce(F.max(F.array_max("places")).over(earlier), F.lit(-1)).alias("last"),
    ).where(F.size("places") > 0)
    starts = F.concat(F.array("last"), F.slice("places", 1, F.size("places") - 1))
    counted = stitched.select("file", "seen", F.posexplode(F.arrays_zip(F.col("places").alias("stop"), starts.alias("start"))).alias("i", "at"))
    return counted.select("file", (F.col("seen") + F.col("i")).alias("ordinal"), (F.col("at.stop") - F.col("at.start") - 1).alias("n_tokens"))


def document_token_counts(docs: DataFrame, tokenizer_path: str, end_id: int, block_ids: int = BLOCK_IDS, folder: str | None = None) -> DataFrame:
    """``doc_id`` and ``n_tokens``: documents are written to flat files, and these scanned."""
    spark = docs.sparkSession
    folder = folder or common.scratch_path(spark, "tokens")
    common.prepare(spark)
    places = write_token_files(docs, folder, tokenizer_path, end_id)
    width = int(encoding.encoder(tokenizer_path, special_as_text=True).dtype[-1])
    # files of attempts that were lost or not needed are named by no row
    files = token_files(spark, folder).join(places.select("file").distinct(), "file", "left_semi")
    counts = scan_separators(files, folder, end_id, width, block_ids)
    # both sides have a row for each document, whatever the planner makes of the short list of files
    return places.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
