"""Streaming twins of ``timer_state``, ``hold``, ``deferred_start`` and ``active_ticks``: one small state for each tune, rows in the order of their frames.

A stream gives the rows of a key micro-batch by micro-batch; in a batch they are put in order of the frame, and across batches they
have to come in order, as a player's do.  The state store has to keep several values for each key: set
``spark.sql.streaming.stateStore.providerClass`` to ``STATE_STORE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _together(batches: Iterator[pd.DataFrame], frame: str) -> pd.DataFrame:
    """The rows of one key in one micro-batch, bounded by the trigger's limit."""
    return pd.concat(list(batches), ignore_index=True).sort_values(frame, kind="stable")


class TimerMachine(StatefulProcessor):
    """Idle or active after each operation, and whether it had effect."""

    def __init__(self, key: str, frame: str, op: str):
        self._key, self._frame, self._op = key, frame, op

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._active = handle.getValueState("active", "active boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        active = bool(self._active.get()[0]) if self._active.exists() else False
        batch = _together(rows, self._frame)
        states, effects = [], []
        for op in batch[self._op]:
            effects.append(True if op == "start" else active)
            active = op == "start" or (active and op != "stop")
            states.append("active" if active else "idle")
        self._active.update((active,))
        yield pd.DataFrame({self._key: batch[self._key], self._frame: batch[self._frame], self._op: batch[self._op], "state": states, "effective": effects})

    def close(self) -> None:
        pass


class HoldMachine(StatefulProcessor):
    """Each column keeps its value where the write is omitted; ``types`` are those of the columns."""

    def __init__(self, key: str, frame: str, types: dict[str, str]):
        self._key, self._frame, self._types = key, frame, types

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState("held", ", ".join(f"{c} {t}" for c, t in self._types.items()))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = list(self._held.get()) if self._held.exists() else [None] * len(self._types)
        batch = _together(rows, self._frame)
        out = batch[[self._key, self._frame]].copy()
        for k, (c, kind) in enumerate(self._types.items()):
            whole = kind in ("tinyint", "smallint", "int", "bigint")
            filled = []
            for v in batch[c]:
                if not pd.isna(v):
                    held[k] = int(v) if whole else v
                filled.append(held[k])
            out[c] = pd.Series(filled, index=batch.index, dtype="Int64" if whole else object)
        self._held.update(tuple(held))
        yield out

    def close(self) -> None:
        pass


class DeferredStartMachine(StatefulProcessor):
    """A start that comes before the one before it has ended waits for its end."""

    def __init__(self, key: str, at: str, length: str):
        self._key, self._at, self._length = key, at, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._end = handle.getValueState("end", "end_frame long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        end = int(self._end.get()[0]) if self._end.exists() else None
        batch = _together(rows, self._at)
        begins, ends = [], []
        for at, length in zip(batch[self._at], batch[self._length], strict=True):
            begins.append(int(at) if end is None else max(int(at), end))
            end = begins[-1] + int(length)
            ends.append(end)
        self._end.update((end,))
        yield batch[[self._key, self._at, self._length]].assign(begin_frame=begins, end_frame=ends)

    def close(self) -> None:
        pass


class TickMachine(StatefulProcessor):
    """Two clocks: a row is a frame of the slow one; while the timer is active, its ticks are those of the fast one."""

    def __init__(self, key: str, frame: str, op: str, ticks: str):
        self._key, self._frame, self._op, self._ticks = key, frame, op, ticks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._state = handle.getValueState("timer", "active boolean, position long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        active, position = self._state.get() if self._state.exists() else (False, 0)
        batch = _together(rows, self._frame)
        for k, frame, op, ticks in zip(*(batch[c] for c in (self._key, self._frame, self._op, self._ticks)), strict=True):
            if op == "start":
                active, position = True, 0
            elif op == "stop":
                active = False
            if active:
                yield pd.DataFrame({self._key: k, self._frame: frame, "tick": range(ticks), "position": range(position, position + ticks)})
                position += int(ticks)
        self._state.update((bool(active), int(position)))

    def close(self) -> None:
        pass


def timer_states(ops: DataFrame, key: str, frame: str, op: str) -> DataFrame:
    out = f"{key} long, {frame} long, {op} string, state string, effective boolean"
    return _run(ops.select(key, frame, op), key, TimerMachine(key, frame, op), out)


def held_values(rows: DataFrame, key: str, frame: str, columns: list[str]) -> DataFrame:
    types = {c: rows.schema[c].dataType.simpleString() for c in columns}
    out = f"{key} long, {frame} long, " + ", ".join(f"{c} {t}" for c, t in types.items())
    return _run(rows.select(key, frame, *columns), key, HoldMachine(key, frame, types), out)


def deferred_starts(requests: DataFrame, key: str, at: str, length: str) -> DataFrame:
    out = f"{key} long, {at} long, {length} long, begin_frame long, end_frame long"
    return _run(requests.select(key, at, length), key, DeferredStartMachine(key, at, length), out)


def ticks(ops: DataFrame, key: str, frame: str, op: str, ticks: str) -> DataFrame:
    out = f"{key} long, {frame} long, tick long, position long"
    return _run(ops.select(key, frame, op, ticks), key, TickMachine(key, frame, op, ticks), out)


def _run(rows: DataFrame, key: str, machine: StatefulProcessor, out: str) -> DataFrame:
    return rows.groupBy(key).transformWithStateInPandas(machine, StructType.fromDDL(out), "Append", "None")
