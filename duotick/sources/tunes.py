"""Tunes as text.  The JSON and CSV forms are this project's own: a row for each frame, registers that it doesn't set left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from ..operators.holds import change_only

REGISTERS = [f"r{i}" for i in range(14)]
TIMERS = "ADBC"  # the order of their columns
EFFECT_FIELDS = ("target", "source", "control", "count", "mapping")

#: 14 registers, and five fields for each of four timers.
FRAME_SCHEMA = T.StructType(
    [T.StructField("tune_id", T.LongType()), T.StructField("frame", T.LongType())]
    + [T.StructField(r, T.ShortType()) for r in REGISTERS]
    + [T.StructField(f"{t.lower()}_{f}", T.IntegerType()) for t in TIMERS for f in EFFECT_FIELDS]
)


def read_tune_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAME_SCHEMA).json(path)


def read_tune_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAME_SCHEMA).csv(path, header=True, nullValue="")


def write_tune_json(frames: DataFrame, path: str) -> None:
    frames.write.json(path, ignoreNullFields=True)


def write_tune_csv(frames: DataFrame, path: str) -> None:
    frames.write.csv(path, header=True, nullValue="")


def import_dump(dense: DataFrame, tune: str = "tune_id", frame: str = "frame", registers: list[str] | None = None, span: int | None = None) -> DataFrame:
    """A dump has every register in every frame; a tune has the changes."""
    return change_only(dense, tune, frame, registers or [c for c in dense.columns if c not in (tune, frame)], span)
