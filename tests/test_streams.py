"""A stream gives what the batch gives."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from duotick.operators import holds, timers
from duotick.plans import catalog
from duotick.streaming import machines

from .conftest import SF


def _stream(spark, tmp_path, df, frame):
    """The rows in two files, in order, read one a trigger."""
    half = df.agg(F.expr(f"percentile({frame}, 0.5)")).first()[0]
    folder = tmp_path / "in"
    for i, part in enumerate((df.where(F.col(frame) <= half), df.where(F.col(frame) > half))):
        part.coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
    folder.mkdir()
    for i in range(2):
        for f in (tmp_path / f"p{i}").glob("*.parquet"):
            f.rename(folder / f"{i}.parquet")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(folder))


def _run(spark, tmp_path, df):
    name = "out_" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_timer_machine(spark, tmp_path):
    ops = catalog._timer_ops(spark, SF)
    got = _run(spark, tmp_path, machines.timer_states(_stream(spark, tmp_path, ops, "event_id"), "user_id", "event_id", "op"))
    want = timers.timer_state(ops, "user_id", "event_id", "op").select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_hold_machine(spark, tmp_path):
    rows = catalog._events(spark, SF).select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("a"), F.when(F.col("event_type") == "view", F.col("value")).alias("b"))
    got = _run(spark, tmp_path, machines.held_values(_stream(spark, tmp_path, rows, "event_id"), "user_id", "event_id", ["a", "b"]))
    want = holds.hold(rows, "user_id", "event_id", ["a", "b"])
    clean = lambda df: sorted((r[0], r[1], *(None if v is None or v != v else v for v in r[2:])) for r in df.collect())
    key = lambda r: tuple((v is not None, v or 0) for v in r)
    assert sorted(clean(got), key=key) == sorted(clean(want), key=key)


def test_hold_keeps_types(spark, tmp_path):
    rows = catalog._events(spark, SF).select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("event_id")).alias("n"), F.when(F.col("event_type") == "view", F.lit("v")).alias("s"))
    got = _run(spark, tmp_path, machines.held_values(_stream(spark, tmp_path, rows, "event_id"), "user_id", "event_id", ["n", "s"]))
    want = holds.hold(rows, "user_id", "event_id", ["n", "s"]).select(got.columns)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_deferred_start_machine(spark, tmp_path):
    requests = catalog._events(spark, SF).where("event_type = 'signup'").select("user_id", "event_id", (F.col("event_id") % 50 + 1).alias("length"))
    got = _run(spark, tmp_path, machines.deferred_starts(_stream(spark, tmp_path, requests, "event_id"), "user_id", "event_id", "length"))
    want = timers.deferred_start(requests, "user_id", "event_id", "length").select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stop_and_restart(spark, tmp_path):
    """A query that is stopped and started again from its checkpoint goes on with its state: two clocks, one file before the stop and one after."""
    ops = catalog._timer_ops(spark, SF).withColumn("ticks", F.col("event_id") % 4 + 1)
    stream = _stream(spark, tmp_path, ops, "event_id")
    (tmp_path / "in" / "1.parquet").rename(tmp_path / "later.parquet")
    counts = []
    for _ in range(2):
        q = machines.ticks(stream, "user_id", "event_id", "op", "ticks").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        counts.append(spark.read.parquet(str(tmp_path / "out")).count())
        if (tmp_path / "later.parquet").exists():
            (tmp_path / "later.parquet").rename(tmp_path / "in" / "1.parquet")
    want = timers.active_ticks(ops, "user_id", "event_id", "op", "ticks").select("user_id", "event_id", "tick", "position")
    assert 0 < counts[0] < counts[1] == want.count()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect()))
