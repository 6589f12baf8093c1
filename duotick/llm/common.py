"""Shared plumbing: scratch tables in the cluster's shared folder, and Arrow helpers."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all tasks run in this process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("duotick.scratch.dir", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="duotick-")
            spark.conf.set("duotick.scratch.dir", folder)
            import atexit

            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        folder = Path(folder).as_uri()
    if ":/" not in folder:  # tasks open files by URI, and must mean the same file system as Spark does
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/+", "file:///", folder)


_scope: ContextVar[list[str] | None] = ContextVar("scratch paths of the innermost scope", default=None)


@contextmanager
def scratch_scope() -> Iterator[list[str]]:
    """Gathers the scratch paths that are named inside, for a caller that knows when they are read no more."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(token)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder.  A lazy result may read it at any time, so it goes at the end of the application, unless a scope's owner removes it sooner."""
    uri = f"{scratch_dir(spark).rstrip('/')}/duotick/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    if (paths := _scope.get()) is not None:
        paths.append(uri)
    return uri


def remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage in a way that lost executors don't undo."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of tables that are written go when the driver collects its garbage, which it may not do for long by itself."""
    spark.sparkContext._jvm.System.gc()


def in_blocks(keyed: DataFrame, unit: str, block: int, columns: list[str]) -> DataFrame:
    """``keyed(key, ...)`` to ``grp`` and ``columns``: rows that share a key share a group of about ``block`` rows.

    A larger key is cut into blocks by ``unit``; there is a group for each pair of blocks, and a row goes to every pair that its block is in.
    """
    large = materialize(keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / max(1, block // 2)).cast("int").alias("blocks")), "large-keys")
    if large.isEmpty():
        return keyed.select(F.col("key").alias("grp"), *columns)
    own = F.pmod(F.xxhash64(unit), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("key", F.least(o, F.col("own")), F.greatest(o, F.col("own"))))
    marked = keyed.join(large.hint("merge"), "key", "left").withColumn("own", own)
    return marked.select(F.explode(F.when(F.col("blocks").isNull(), F.array(F.xxhash64("key", F.lit(-1), F.lit(-1)))).otherwise(pairs)).alias("grp"), *columns)


#: Bytes of stored input for each range of documents, and ranges at most: their bounds are held by the driver.
RANGE_BYTES, MOST_RANGES = 256 << 20, 20_000


def partitions_for(df: DataFrame) -> int:
    """As many partitions as the session's shuffles have, or more if the input's files ask for it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_RANGES, size // RANGE_BYTES)) if size < 1 << 60 else least  # a size that Spark doesn't know is told as the greatest


#: Bytes of a batch between the JVM and Python; both sides hold a few for each task.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches, unless the session has its own size, and this package on the executors."""
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(size, "67108864b") in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(size, str(BATCH_BYTES))
    _ship_package(spark)


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the executors unless their PYTHONPATH has it already (it then needs no copy)."""
    root = Path(__file__).resolve().parents[2]
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in on_path or spark.conf.get("duotick.shipped", None):
        return
    bundle = Path(tempfile.mkdtemp(prefix="duotick-zip-")) / "duotick.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for f in sorted((root / "duotick").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(bundle))
    spark.conf.set("duotick.shipped", "1")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str) -> DataFrame:
    """Apply ``fn`` to every Arrow batch; ``fn`` may return a batch or a table."""
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            else:
                yield out

    return df.mapInArrow(run, schema)


def text_pieces(batch: pa.RecordBatch, column: str = "text", rows: int = 256) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for short runs of rows, null as empty: Python strings of a whole batch never live at once."""
    col = batch.column(batch.schema.get_field_index(column))
    for at in range(0, len(col), rows):
        yield at, [t if t is not None else "" for t in col.slice(at, rows).to_pylist()]


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
