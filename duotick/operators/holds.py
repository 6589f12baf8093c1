"""Sparse columns: a null is an omitted write."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import ordered


def hold(rows: DataFrame, key: str, frame: str, columns: list[str], span: int | None = None) -> DataFrame:
    """Each column keeps its value where the write is omitted; null before the first write."""
    held = ordered.running_last(rows, [key], frame, {f"__held_{c}": F.col(c) for c in columns}, span)
    return held.select(*(F.col(f"__held_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns))


def change_only(rows: DataFrame, key: str, frame: str, columns: list[str], span: int | None = None) -> DataFrame:
    """The inverse: a value equal to the row's before is omitted."""
    found = ordered.previous_row(rows, [key], frame, {f"__was_{c}": F.col(c) for c in columns}, span)
    changed = lambda c: F.when(~F.col(c).eqNullSafe(F.col(f"__was_{c}")), F.col(c))
    return found.select(*(changed(c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def set_writes(rows: DataFrame, ids: list[str], columns: list[str], register: str = "register", value: str = "value") -> DataFrame:
    """One row for each write that isn't omitted."""
    return rows.unpivot(ids, columns, register, value).where(F.col(value).isNotNull())


def frame_wide(writes: DataFrame, ids: list[str], register: str, value: str, registers: list[str]) -> DataFrame:
    """One row for each frame, a column for each register; the registers are given, so no pass is needed to find them."""
    return writes.groupBy(*ids).pivot(register, registers).agg(F.max(value))


def rolling_buffer(rows: DataFrame, key: str, frame: str, size: int, span: int | None = None, **aggregates) -> DataFrame:
    """Aggregates over the last ``size`` rows, the current one among them."""
    return ordered.rolling(rows, [key], frame, size, aggregates, span)


def last_write(writes: DataFrame, instant: list[str], register: str, value: str, seq: str) -> DataFrame:
    """Of several writes to a register at one instant, the one with the greatest ``seq``."""
    return writes.groupBy(*instant, register).agg(F.max_by(value, seq).alias(value))


def voice_select(effect: DataFrame, tune: DataFrame, keys: list[str], effect_value: str, tune_value: str, chosen: str) -> DataFrame:
    """Where both write a voice the effect is heard."""
    return effect.join(tune, keys, "full").withColumn(chosen, F.coalesce(effect_value, tune_value))
