"""Clocks, and source tables read row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def frame_clock(tunes: DataFrame, frames: str, name: str = "frame") -> DataFrame:
    """A row for each frame from 0; none where ``frames`` is below 1."""
    return tunes.where(F.col(frames) >= 1).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(frames).cast("long") - 1)))


def tick_expand(effects: DataFrame, ticks: str, name: str = "tick") -> DataFrame:
    return frame_clock(effects, ticks, name)


def cyclic_row(n: Column, rows: int, repeat_row: int) -> Column:
    """The row that read number ``n`` is of: 0 to ``rows`` - 1, then from ``repeat_row`` on, again and again."""
    return F.when(n < rows, n).otherwise(repeat_row + F.pmod(n - repeat_row, F.lit(rows - repeat_row)))


def row_fetch(reads: DataFrame, rows: DataFrame, on: list[str]) -> DataFrame:
    return reads.join(rows, on)


def cyclic_read(reads: DataFrame, rows: DataFrame, n: str, length: int, repeat_row: int, row_no: str = "row_no") -> DataFrame:
    return row_fetch(reads.withColumn(row_no, cyclic_row(F.col(n), length, repeat_row)), rows, [row_no])


def one_shot(reads: DataFrame, rows: DataFrame, n: str, length: int, row_no: str = "row_no") -> DataFrame:
    """Reads beyond the last row give no more rows."""
    return row_fetch(reads.where(F.col(n) < length).withColumn(row_no, F.col(n)), rows, [row_no])


def source_lookup(effects: DataFrame, index: DataFrame, source: str = "source") -> DataFrame:
    """Effects with the source that the index names; source 0 stops a timer and names none.  Spark broadcasts the index if it is small."""
    return effects.where(F.col(source) != 0).join(index, source)


def refill_schedule(frames: DataFrame, frame: str, columns: str = "ABCD") -> DataFrame:
    """Frame f, from 1, refills column (f - 1) mod k with its next k rows; the first k rows are there at the start."""
    k = len(columns)
    turn = F.col(frame) - 1
    first = F.expr(f"(({frame} - 1) div {k}) * {k} + {k + 1}")
    return frames.select("*", F.substr(F.lit(columns), F.pmod(turn, F.lit(k)).cast("int") + 1, F.lit(1)).alias("col"), first.alias("first_row"), (first + (k - 1)).alias("last_row"))


def precompute_source(instruments: DataFrame, pitch: str, arpeggio: list[int], vibrato: list[int], volume: list[int]) -> DataFrame:
    """Arpeggio, vibrato and volume worked into one table of (row_no, period, volume) for each instrument."""
    at = lambda values, i: F.get(F.array(*map(F.lit, values)), F.pmod(i, F.lit(len(values))).cast("int"))
    i = F.col("row_no")
    stepped = instruments.withColumn("row_no", F.explode(F.sequence(F.lit(0), F.lit(len(volume) - 1))))
    return stepped.withColumn("period", F.col(pitch) + at(arpeggio, i) + at(vibrato, i)).withColumn("volume", at(volume, i))


def pattern_to_frames(pattern: DataFrame, notes: DataFrame, row: str, note: str, frames_per_row: int) -> DataFrame:
    """Pattern rows at their frames with the period of their note."""
    return pattern.withColumn("frame", F.col(row) * frames_per_row).join(notes, note)
