"""The worked examples, and properties of the operators."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from duotick.functions import registers
from duotick.operators import checks, cycles, holds, mapping, ordered, reports, timers


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


FRAMES = [(1, 0, 0xDE, 0x01, 0x0F), (1, 24, 0x7B, None, None), (1, 48, 0x3F, None, 0x0C)]
HELD = [(1, 0, 222, 1, 15), (1, 24, 123, 1, 15), (1, 48, 63, 1, 12)]


def frames(spark):
    return spark.createDataFrame(FRAMES, "tune long, frame long, r0 int, r1 int, r8 int")


def test_hold_and_periods(spark):
    for span in (None, 10, 24, 1000):
        held = holds.hold(frames(spark), "tune", "frame", ["r0", "r1", "r8"], span)
        assert rows(held, "frame") == HELD
    periods = held.select("frame", registers.tone_period(F.col("r1"), F.col("r0")).alias("p"))
    assert rows(periods, "frame") == [(0, 478), (24, 379), (48, 319)]


def test_change_only_is_the_inverse(spark):
    held = holds.hold(frames(spark), "tune", "frame", ["r0", "r1", "r8"])
    assert rows(holds.change_only(held, "tune", "frame", ["r0", "r1", "r8"]), "frame") == FRAMES


def test_hex(spark):
    df = spark.createDataFrame([("0xDE",), ("7B",), (None,)], "s string").select(registers.hex_to_int(F.col("s")))
    assert [r[0] for r in df.collect()] == [222, 123, None]


def test_running_values_do_not_depend_on_the_span(spark):
    data = [(k, i, (i * 7 + k) % 5 if (i + k) % 3 else None) for k in range(3) for i in range(50)]
    df = spark.createDataFrame(data, "k long, i long, v long")
    one = rows(ordered.running_sum(ordered.running_last(df, ["k"], "i", {"l": F.col("v")}), ["k"], "i", {"s": F.coalesce("v", F.lit(0))}), "k", "i")
    for span in (1, 7, 64):
        cut = ordered.running_sum(ordered.running_last(df, ["k"], "i", {"l": F.col("v")}, span), ["k"], "i", {"s": F.coalesce("v", F.lit(0))}, span)
        assert rows(cut, "k", "i") == one


def test_rows_before_and_maxima_do_not_depend_on_the_span(spark):
    data = [(k, i, (i * 7 + k) % 5 if (i + k) % 3 else None) for k in range(3) for i in range(50)]
    df = spark.createDataFrame(data, "k long, i long, v long")
    both = lambda span: rows(ordered.previous_row(ordered.running_max(df, ["k"], "i", {"m": F.col("v")}, span), ["k"], "i", {"p": F.col("v")}, span), "k", "i")
    assert both(1) == both(7) == both(64) == both(None)


OPS = [
    (100, "A", "start", "SID"), (110, "B", "start", "Sync buzzer"), (120, "A", "stop", "SID"), (120, "D", "start", "Digidrum"), (130, "A", "start", "Wavetable"),
    (140, "A", "retune", "Wavetable"), (140, "D", "stop", "Digidrum"), (150, "A", "remap", "Wavetable"), (150, "B", "stop", "Sync buzzer"), (160, "A", "stop", "Wavetable"),
]


def ops(spark):
    return spark.createDataFrame(OPS, "frame long, timer string, op string, effect string")


def test_runs(spark):
    found = timers.runs(ops(spark), "timer", "frame", F.col("op") == "start", F.col("op") == "stop")
    got = rows(found.select("timer", "run", "start", "stop", (F.col("stop") - F.col("start")).alias("len")), "timer", "run")
    assert got == [("A", 1, 100, 120, 20), ("A", 2, 130, 160, 30), ("B", 1, 110, 150, 40), ("D", 1, 120, 140, 20)]


def test_active_effects_equal_the_theta_join(spark):
    found = timers.runs(ops(spark), "timer", "frame", F.col("op") == "start", F.col("op") == "stop").select("timer", "run", "start", "stop")
    clock = spark.range(95, 165).select(F.col("id").alias("f"))
    want = rows(clock.join(found, (F.col("f") >= F.col("start")) & (F.col("f") < F.col("stop"))), "f", "timer")
    for bucket in (1, 16, 1024):
        assert rows(timers.active_effects(clock, found, "f", bucket), "f", "timer") == want


def test_active_effects_of_odd_clocks(spark):
    """Frames that repeat beyond a list, are null, below zero or missing, and further columns; runs that are empty, open or longer than the clock."""
    at = [*range(-300, 300, 7), *[5] * 300, *[128] * 3, None, None]
    clock = spark.createDataFrame([(f, i) for i, f in enumerate(at)], "f long, row long")
    found = [("a", -1000, 1000), ("b", 5, 6), ("c", 6, 6), ("d", 9, 3), ("e", 0, None), ("f", None, 9), ("g", -128, 129), ("h", 127, 128), ("g", -128, 129)]
    want = sorted((f, i, *r) for i, f in enumerate(at) for r in found if None not in (f, r[1], r[2]) and r[1] <= f < r[2])
    for bucket in (1, 16, 1024):
        got = timers.active_effects(clock, spark.createDataFrame(found, "timer string, start long, stop long"), "f", bucket)
        assert got.columns == ["f", "row", "timer", "start", "stop"] and sorted(rows(got)) == want


def test_active_effects_leave_small_files(spark, tmp_path):
    """Many rows, which repeat: under half a byte for each, also where no table is small enough to be broadcast."""
    whole = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    clock = spark.range(20_000).select(F.col("id").alias("f"))
    found = spark.range(1500).selectExpr("id AS timer", "pmod(xxhash64(id), 16000) AS start").selectExpr("timer", "start", "start + 1 + pmod(xxhash64(timer, start), 4000) AS stop")
    try:
        timers.active_effects(clock, found, "f").write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", whole)
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n == found.select(F.sum(F.col("stop") - F.col("start"))).first()[0] > 1_000_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < n / 2


def test_active_effects_are_written_in_bounded_row_groups(spark, tmp_path):
    """Parquet's writer looks at its memory after every row of a long row group of small rows.  What can't be null has no marks for it; types stay; a caller's own setting stands."""
    clock = spark.range(16_384).select(F.col("id").cast("int").alias("f"))
    found = spark.range(100).selectExpr("CASE WHEN id <> 7 THEN id END AS timer", "CAST(id AS SMALLINT) AS start", "id + 16000 AS stop")
    timers.active_effects(clock, found, "f").write.parquet(str(tmp_path / "out"))
    files = [pq.ParquetFile(p) for p in (tmp_path / "out").glob("*.parquet")]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert sum(groups) == 1_600_000 and max(groups) == 1 << 19
    schema = files[0].schema_arrow
    assert [(c.name, str(c.type), c.nullable) for c in schema] == [("f", "int32", False), ("timer", "int64", True), ("start", "int16", False), ("stop", "int64", False)]
    spark.conf.set("parquet.block.row.count.limit", "1000000")
    try:
        timers.active_effects(clock, found, "f").write.parquet(str(tmp_path / "own"))
    finally:
        spark.conf.unset("parquet.block.row.count.limit")
    files = [pq.ParquetFile(p) for p in (tmp_path / "own").glob("*.parquet")]
    assert max(f.metadata.row_group(i).num_rows for f in files for i in range(f.num_row_groups)) == 1_000_000


def test_active_effects_are_dealt_to_several_tasks_a_partition(spark):
    df = timers.active_effects(spark.range(10).select(F.col("id").alias("f")), spark.createDataFrame([("a", 1, 5)], "timer string, start long, stop long"), "f")
    assert df.rdd.getNumPartitions() == 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def generated(plan):
    """Rows that the plan's generators made when it ran, the last one's first."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return generated(plan.executedPlan())
    if name.endswith("QueryStage"):
        return generated(plan.plan())
    below = [n for i in range(plan.children().size()) for n in generated(plan.children().apply(i))]
    return [plan.metrics().get("numOutputRows").get().value(), *below] if name.startswith("Generate") else below


def test_a_long_run_is_cut_into_few_rows(spark):
    """2,000 runs of a million frames meet the clock as 62 rows each, not as 978."""
    found = spark.range(2000).selectExpr("id AS timer", "id AS start", "id + 1000000 AS stop")
    df = timers.active_effects(spark.createDataFrame([(5,), (999_999,), (1_000_000,)], "f long"), found, "f")
    assert len(df.collect()) == 6 + 2000 + 1999
    assert generated(df._jdf.queryExecution().executedPlan())[-1] == 62 * 2000


def test_timer_state(spark):
    df = spark.createDataFrame([(1, 1, "stop"), (1, 2, "start"), (1, 3, "retune"), (1, 4, "stop"), (1, 5, "remap"), (1, 6, "stop")], "k long, frame long, op string")
    got = [(r.state, r.effective) for r in timers.timer_state(df, "k", "frame", "op").orderBy("frame").collect()]
    assert got == [("idle", False), ("active", True), ("active", True), ("idle", True), ("idle", False), ("idle", False)]


def test_asof_state_at_one_instant_sees_the_state(spark):
    state = spark.createDataFrame([(1, 10, "a"), (1, 20, "b")], "k long, at long, v string")
    asked = spark.createDataFrame([(1, 9), (1, 10), (1, 19), (1, 25), (2, 25)], "k long, at long")
    for span in (None, 4):
        got = rows(timers.asof_state(asked, state, "k", "at", ["v"], span), "k", "at")
        assert got == [(1, 9, None), (1, 10, "a"), (1, 19, "a"), (1, 25, "b"), (2, 25, None)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 30)), min_size=1, max_size=12, unique_by=lambda x: x[0]))
def test_deferred_start_equals_a_loop(spark, requests):
    df = spark.createDataFrame([(1, a, n) for a, n in requests], "k long, at long, n long")
    got = [(r.at, r.begin_frame, r.end_frame) for r in timers.deferred_start(df, "k", "at", "n").orderBy("at").collect()]
    end, want = -(10**9), []
    for a, n in sorted(requests):
        begin = max(a, end)
        end = begin + n
        want.append((a, begin, end))
    assert got == want


def test_refill_schedule(spark):
    df = cycles.refill_schedule(spark.range(1, 6).select(F.col("id").alias("frame")), "frame")
    assert rows(df, "frame") == [(1, "A", 5, 8), (2, "B", 5, 8), (3, "C", 5, 8), (4, "D", 5, 8), (5, "A", 9, 12)]


def test_cycles(spark):
    n = spark.range(18)
    got = [r[0] for r in n.orderBy("id").select(cycles.cyclic_row(F.col("id"), 8, 3)).collect()]
    assert got == [0, 1, 2, 3, 4, 5, 6, 7, 3, 4, 5, 6, 7, 3, 4, 5, 6, 7]
    assert [r[0] for r in n.orderBy("id").limit(4).select(cycles.cyclic_row(F.col("id"), 2, 0)).collect()] == [0, 1, 0, 1]  # square wave
    assert {r[0] for r in n.select(cycles.cyclic_row(F.col("id"), 1, 0)).collect()} == {0}  # one value
    source = spark.createDataFrame([(i, v) for i, v in enumerate([8, 9, 10, 11])], "row_no long, v int")
    assert rows(cycles.one_shot(n, source, "id", 4).select("id", "v"), "id") == [(0, 8), (1, 9), (2, 10), (3, 11)]
    assert cycles.tick_expand(spark.createDataFrame([(0,), (3,)], "ticks int"), "ticks").count() == 3


def test_tick_mapping_and_fanout(spark):
    source = spark.createDataFrame([(1, 1, 14, [63, 1]), (2, 0, 14, [63, 1])], "id long, mapping int, target int, vals array<int>")
    table = spark.createDataFrame([(1, 1, 2)], "mapping int, k int, v int")
    done = mapping.target_fanout(mapping.map_last(source, table, "vals", "mapping"), registers.targets(spark), "target", "vals")
    assert rows(done.select("id", "register", "value"), "id", "register") == [(1, 0, 63), (1, 1, 2), (2, 0, 63), (2, 1, 1)]


def test_missing_mapping_key_is_a_parameter(spark):
    values = spark.createDataFrame([(1, 7), (0, 7)], "mapping int, v0 int")
    table = spark.createDataFrame([(1, 1, 2)], "mapping int, k int, v int")
    for missing, want in (("null", [(0, 7), (1, None)]), ("value", [(0, 7), (1, 7)])):
        got = mapping.mapping_lookup(values, table, "v0", "mapping", "out", missing).select("mapping", "out")
        assert rows(got, "mapping") == want


def test_source_index(spark):
    index = spark.createDataFrame([(1, "SID loop 1"), (3, "Tone period")], "source int, name string")
    effects = spark.createDataFrame([("A", 1), ("B", 3), ("C", 0)], "timer string, source int")
    assert rows(cycles.source_lookup(effects, index).select("timer", "name"), "timer") == [("A", "SID loop 1"), ("B", "Tone period")]


COST = [("a", 575, 556, 0), ("b", 740, 811, 2747), ("c", 903, 1092, 4228), ("d", 847, 1303, 11304)]


def test_costs(spark):
    df = spark.createDataFrame(COST, "tune string, advance long, other long, timers long")
    costs = reports.cost_share(reports.cost_total(df, "tune", advance=F.col("advance"), other=F.col("other"), timers=F.col("timers")), "total", 160_000)
    assert rows(costs.select("total", "pct"), "total") == [(1131, 0.71), (4298, 2.69), (6223, 3.89), (13454, 8.41)]
    assert reports.scaled_share(costs, "total").where("scaled = 1").first()["tune"] == "d"


def test_sizes(spark):
    parts = spark.createDataFrame([("core", 3402), ("data", 408), ("workspace", 17862), ("image", 102080)], "part string, bytes long")
    assert {r[0]: r[1] for r in reports.size_rollup(parts, ["part"], "bytes").collect()}[None] == 123752
    one = reports.size_ratio(spark.createDataFrame([(102080, 1278499)], "a long, b long"), "a", "b")
    assert one.first()["smaller_pct"] == 92.0


def test_rates(spark):
    one = spark.range(1).select(registers.ticks_per_frame(F.lit(2400), F.lit(50)), registers.cycles_per_frame(F.lit(50)), registers.frame_period_ms(F.lit(50)), registers.ticks_per_frame(F.lit(1), F.lit(0)))
    assert tuple(one.first()) == (48.0, 160000.0, 20.0, None)


def test_register_groups_and_mask(spark):
    uses = {r["register"]: r["use"] for r in registers.register_groups(spark).collect()}
    assert len(uses) == 14 and uses[7] == "Mixer" and uses[13] == "Envelope"
    one = spark.range(1).select(registers.masked_merge(F.lit(0b10101010), F.lit(0b01000000), 0x3F)).first()[0]
    assert one == 0b01101010


def test_last_write_and_constant_columns(spark):
    df = spark.createDataFrame([(1, 0, 5, 1), (1, 0, 6, 2), (1, 1, 7, 0)], "frame long, register int, value int, seq int")
    assert rows(holds.last_write(df, ["frame"], "register", "value", "seq"), "register") == [(1, 0, 6), (1, 1, 7)]
    flags = {r[0]: r[1] for r in checks.constant_columns(df.withColumn("empty", F.lit(None).cast("int"))).collect()}
    assert flags == {"frame": True, "register": False, "value": False, "seq": False, "empty": True}


def test_range_check_and_rules(spark):
    df = spark.createDataFrame([(1, 5), (2, 300), (3, None)], "k long, r int")
    assert rows(checks.range_check(df, {"r": (0, 255)})) == [("r", 2, 1)]
    found = checks.rule_violations(df, "k", {"range": (~F.col("r").between(0, 255), F.col("r")), "missing": (F.col("r").isNull(), F.lit("r"))})
    assert rows(found, "key") == [("range", 2, "300"), ("missing", 3, "r")]


def test_empty_tables(spark):
    none = frames(spark).where("false")
    assert holds.hold(none, "tune", "frame", ["r0"], 10).count() == 0
    assert timers.runs(ops(spark).where("false"), "timer", "frame", F.col("op") == "start", F.col("op") == "stop").count() == 0


@pytest.mark.parametrize("span", [1, 2, 10, 1000])
def test_nulls_in_any_column(spark, span):
    """Null keys, orders and values: every span gives what one group gives."""
    data = [(None if k == 2 else k, i, None if (i * 3 + k) % 4 == 0 else (i * 7 + k) % 5) for k in range(3) for i in (0, 1, 2, 5, 9, 10, 11, 25)]
    data += [(k, None, 3 + (k or 0)) for k in (0, None)]
    df = spark.createDataFrame(data, "k long, i long, v long")
    v, last = F.col("v"), lambda f, *a, **b: sorted(map(str, f(df, ["k"], *a, **b).collect()))
    for f, args in (
        (ordered.running_last, ("i", {"x": v})), (ordered.running_sum, ("i", {"x": v})), (ordered.running_max, ("i", {"x": v})), (ordered.previous_row, ("i", {"x": v})),
        (ordered.next_row, (["i"], {"x": v})), (ordered.numbered, (["i"], "x")), (ordered.rolling, ("i", 3, {"x": F.sum("v"), "n": F.count("*")})),
    ):
        whole = last(f, *args)
        assert len(whole) == len(data) and last(f, *args, span=span) == whole, f


def test_sum_goes_on_over_a_null_at_a_cut(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, None), (1, 10, None), (1, 11, 2)], "k long, i long, v long")
    got = rows(ordered.running_sum(df, ["k"], "i", {"s": F.col("v")}, 10).select("i", "s"), "i")
    assert got == [(0, 5), (1, 5), (10, 5), (11, 7)]
