"""Queries of the two-clock operators on the test tables, each with the same query in SQL.

The tables stand in for tunes, by a convention of this project: an ``events`` row is a frame row, its user the tune, its ``event_id`` the frame;
signup starts, error stops, click retunes and view remaps a timer, purchase writes a register; ``part.p_size`` are source values; nation to
region is a mapping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import registers
from ..operators import checks, cycles, holds, mapping, ordered, reports, timers
from ..sources import tunes
from ..sources.tables import shared_path, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Frames of one stretch of a tune: a longer tune is the work of several tasks.
SPAN = 1 << 20
#: Days of one stretch of a customer's orders.
DAYS = 366
TYPES = ("click", "error", "purchase", "signup", "view")
OPS = {"signup": "start", "error": "stop", "click": "retune", "view": "remap"}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return table(spark, d, "events").select(*(columns or ("event_id", "user_id", "event_type", "value")))


def _is(kind: str):
    return F.col("event_type") == kind


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return timers.runs(_events(spark, d, "event_id", "user_id", "event_type"), "user_id", "event_id", _is("signup"), _is("error"), SPAN)


_RUNS = """
marked AS (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM events),
runs AS (SELECT user_id, run, min(event_id) AS start, min(CASE WHEN event_type = 'error' THEN event_id END) AS stop, max(event_id) AS last, count(*) AS n FROM marked WHERE run > 0 GROUP BY user_id, run)"""


# -- held values and writes -------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, " + ", ".join(f"last_value(CASE WHEN event_type = '{t}' THEN value END IGNORE NULLS) OVER w AS held_{t}" for t in TYPES) + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def hold(spark, d):
    wide = _events(spark, d).select("event_id", "user_id", *(F.when(_is(t), F.col("value")).alias(f"held_{t}") for t in TYPES))
    return holds.hold(wide, "user_id", "event_id", [f"held_{t}" for t in TYPES], SPAN)


@query("SELECT event_id, user_id, event_type FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p")
def change_only(spark, d):
    rows = holds.change_only(_events(spark, d, "event_id", "user_id", "event_type"), "user_id", "event_id", ["event_type"], SPAN)
    return rows.where("event_type IS NOT NULL")


@query("SELECT event_id, 'value' AS register, value FROM events WHERE event_type IN ('click', 'purchase') UNION ALL SELECT event_id, 'k' AS register, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def set_writes(spark, d):
    wide = _events(spark, d, "event_id", "event_type", "value", "props").select("event_id", F.when(F.col("event_type").isin("click", "purchase"), F.col("value")).alias("value"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    long = holds.set_writes(wide.withColumnRenamed("value", "v0"), ["event_id"], ["v0", "k"], "register", "value")
    return long.withColumn("register", F.when(F.col("register") == "v0", "value").otherwise(F.col("register")))


@query("SELECT event_id // 10 AS frame, " + ", ".join(f"max(CASE WHEN event_type = '{t}' THEN event_id END) AS {t}" for t in TYPES) + " FROM events GROUP BY event_id // 10")
def frame_wide(spark, d):
    writes = _events(spark, d, "event_id", "event_type").select(F.expr("event_id div 10").alias("frame"), "event_type", "event_id")
    return holds.frame_wide(writes, ["frame"], "event_type", "event_id", list(TYPES))


@query("SELECT event_id, user_id, count(*) OVER w AS n_held, CAST(sum(event_id) OVER w AS BIGINT) AS sum_held FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)")
def rolling_buffer(spark, d):
    return holds.rolling_buffer(_events(spark, d, "event_id", "user_id"), "user_id", "event_id", 4, SPAN, n_held=F.count("*"), sum_held=F.sum("event_id"))


@query("SELECT event_id // 50 AS frame, event_id % 14 AS register, arg_max(value, event_id) AS value FROM events GROUP BY event_id // 50, event_id % 14")
def last_write(spark, d):
    writes = _events(spark, d, "event_id", "value").select(F.expr("event_id div 50").alias("frame"), (F.col("event_id") % 14).alias("register"), "value", "event_id")
    return holds.last_write(writes, ["frame"], "register", "value", "event_id")


@query("""WITH e AS (SELECT user_id, event_id // 10 AS frame, max(value) AS effect FROM events WHERE event_type = 'signup' GROUP BY ALL),
t AS (SELECT user_id, event_id // 10 AS frame, max(value) AS tune FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT user_id, frame, effect, tune, coalesce(effect, tune) AS chosen FROM e FULL JOIN t USING (user_id, frame)""")
def voice_select(spark, d):
    rows = _events(spark, d).withColumn("frame", F.expr("event_id div 10"))
    part = lambda kind, name: rows.where(_is(kind)).groupBy("user_id", "frame").agg(F.max("value").alias(name))
    return holds.voice_select(part("signup", "effect"), part("purchase", "tune"), ["user_id", "frame"], "effect", "tune", "chosen")


# -- timers -----------------------------------------------------------------------------------------------------------------


@query(f"WITH {_RUNS} SELECT user_id, run, start, stop, last, n FROM runs")
def runs(spark, d):
    return _runs(spark, d)


@query(f"WITH {_RUNS} SELECT user_id, run, stop - start AS length FROM runs WHERE stop IS NOT NULL")
def effect_length(spark, d):
    return _runs(spark, d).where("stop IS NOT NULL").select("user_id", "run", (F.col("stop") - F.col("start")).alias("length"))


@query(f"WITH {_RUNS}, n AS (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY run) AS next_start FROM runs) SELECT user_id, run, start, stop, next_start, CASE WHEN stop IS NOT NULL THEN 'stop' WHEN next_start IS NOT NULL THEN 'start' ELSE 'open' END AS ended_by FROM n")
def superseded(spark, d):
    return timers.superseded(_runs(spark, d).select("user_id", "run", "start", "stop"), "user_id", SPAN)


@query("""WITH o AS (SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'stop' WHEN 'click' THEN 'retune' ELSE 'remap' END AS op FROM events WHERE event_type <> 'purchase'),
s AS (SELECT *, last_value(CASE WHEN op IN ('start', 'stop') THEN op END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM o),
p AS (SELECT *, coalesce(lag(l) OVER (PARTITION BY user_id ORDER BY event_id) = 'start', false) AS was FROM s)
SELECT event_id, user_id, op, CASE WHEN l = 'start' THEN 'active' ELSE 'idle' END AS state, CASE op WHEN 'start' THEN true WHEN 'stop' THEN was ELSE coalesce(l = 'start', false) END AS effective FROM p""")
def timer_state(spark, d):
    return timers.timer_state(_timer_ops(spark, d), "user_id", "event_id", "op", SPAN)


def _timer_ops(spark, d):
    op = F.create_map(*(F.lit(x) for kv in OPS.items() for x in kv))[F.col("event_type")]
    return _events(spark, d, "event_id", "user_id", "event_type").where(~_is("purchase")).select("event_id", "user_id", op.alias("op"))


@query("SELECT p.event_id, p.user_id, s.event_id AS start_id, s.value AS start_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.event_id >= s.event_id")
def asof_state(spark, d):
    rows = _events(spark, d)
    starts = rows.where(_is("signup")).select("user_id", "event_id", F.col("event_id").alias("start_id"), F.col("value").alias("start_value"))
    return timers.asof_state(rows.where(_is("purchase")).select("event_id", "user_id"), starts, "user_id", "event_id", ["start_id", "start_value"], SPAN)


@query(f"WITH {_RUNS} SELECT e.event_id AS frame, r.user_id, r.run, r.start, r.stop FROM runs r JOIN events e ON e.event_id >= r.start AND e.event_id < r.stop")
def active_effects(spark, d):
    """The clock has a frame for every event."""
    clock = _events(spark, d, "event_id").select(F.col("event_id").alias("frame"))
    run = F.coalesce("run", F.lit(0)).alias("run")  # never null
    return timers.active_effects(clock, _runs(spark, d).select("user_id", run, "start", "stop"), "frame")


@query("""WITH r AS (SELECT user_id, event_id AS request, event_id % 50 + 1 AS length FROM events WHERE event_type = 'signup'),
s AS (SELECT *, CAST(sum(length) OVER (PARTITION BY user_id ORDER BY request ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM r),
e AS (SELECT *, total + max(request - total + length) OVER (PARTITION BY user_id ORDER BY request ROWS UNBOUNDED PRECEDING) AS end_frame FROM s)
SELECT user_id, request, length, end_frame - length AS begin_frame, end_frame FROM e""")
def deferred_start(spark, d):
    requests = _events(spark, d, "event_id", "user_id", "event_type").where(_is("signup")).select("user_id", F.col("event_id").alias("request"), (F.col("event_id") % 50 + 1).alias("length"))
    return timers.deferred_start(requests, "user_id", "request", "length", SPAN)


@query("SELECT event_id, user_id, event_id % 48 + 1 AS ticks, CAST(coalesce(sum(event_id % 48 + 1) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset FROM events")
def continuous_position(spark, d):
    segments = _events(spark, d, "event_id", "user_id").withColumn("ticks", F.col("event_id") % 48 + 1)
    return timers.continuous_position(segments, "user_id", "event_id", "ticks", SPAN)


_PHASED = "SELECT event_id, user_id, event_id // 10 AS frame, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS phase FROM events"


@query(f"SELECT event_id, user_id, frame, phase, row_number() OVER (PARTITION BY user_id ORDER BY frame, phase, event_id) - 1 AS pos FROM ({_PHASED})")
def event_order(spark, d):
    rows = _events(spark, d, "event_id", "user_id", "event_type").select("event_id", "user_id", F.expr("event_id div 10").alias("frame"), F.when(_is("purchase"), 1).otherwise(0).alias("phase"))
    return timers.event_order(rows, "user_id", "frame", "phase", "event_id", span=SPAN)


@query("SELECT o_orderkey, o_custkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)) AS INTEGER) AS gap_days FROM orders")
def gaps(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"))
    return timers.gaps(rows, "o_custkey", "day", "o_orderkey", DAYS).select("o_orderkey", "o_custkey", "gap_days")


# -- clocks and sources -----------------------------------------------------------------------------------------------------


def _numbered(spark, d):
    return ordered.numbered(_events(spark, d, "event_id", "user_id"), ["user_id"], ["event_id"], "n", SPAN)


def _sizes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("row_no"), "p_size")


_N = "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events"
_CYCLE = "CASE WHEN n < 8 THEN n ELSE 3 + (n - 3) % 5 END"


@query(f"WITH r AS (SELECT *, {_CYCLE} AS row_no FROM ({_N})) SELECT event_id, user_id, n, row_no, p_size FROM r JOIN part ON p_partkey = row_no")
def cyclic_read(spark, d):
    return cycles.cyclic_read(_numbered(spark, d), _sizes(spark, d), "n", 8, 3)


@query(f"SELECT event_id, user_id, n, p_size FROM ({_N}) JOIN part ON p_partkey = n WHERE n < 8")
def one_shot(spark, d):
    return cycles.one_shot(_numbered(spark, d), _sizes(spark, d), "n", 8).select("event_id", "user_id", "n", "p_size")


@query("SELECT event_id, user_id, unnest(range(0, event_id % 48 + 1)) AS tick FROM events")
def tick_expand(spark, d):
    rows = _events(spark, d, "event_id", "user_id").withColumn("ticks", F.col("event_id") % 48 + 1)
    return cycles.tick_expand(rows, "ticks").drop("ticks")


@query("WITH t AS (SELECT event_id, user_id, unnest(range(0, event_id % 8 + 1)) AS tick FROM events) SELECT event_id, user_id, tick, row_number() OVER (PARTITION BY user_id ORDER BY event_id, tick) - 1 AS number FROM t")
def tick_number(spark, d):
    rows = _events(spark, d, "event_id", "user_id").withColumn("ticks", F.col("event_id") % 8 + 1)
    return ordered.numbered(cycles.tick_expand(rows, "ticks").drop("ticks"), ["user_id"], ["event_id", "tick"], "number", SPAN)


@query("SELECT event_id + 1 AS frame, substr('ABCD', CAST(event_id % 4 + 1 AS INTEGER), 1) AS col, (event_id // 4) * 4 + 5 AS first_row, (event_id // 4) * 4 + 8 AS last_row FROM events")
def refill_schedule(spark, d):
    return cycles.refill_schedule(_events(spark, d, "event_id").select((F.col("event_id") + 1).alias("frame")), "frame")


@query("SELECT event_id, event_id % 10 AS source, event_id // 10 % 20 AS row_no, p_size FROM events JOIN part ON p_partkey % 10 = event_id % 10 AND p_partkey // 10 = event_id // 10 % 20")
def row_fetch(spark, d):
    reads = _events(spark, d, "event_id").select("event_id", (F.col("event_id") % 10).alias("source"), F.expr("event_id div 10 % 20").alias("row_no"))
    rows = table(spark, d, "part").select((F.col("p_partkey") % 10).alias("source"), F.expr("p_partkey div 10").alias("row_no"), "p_size")
    return cycles.row_fetch(reads, rows, ["source", "row_no"]).select("event_id", "source", "row_no", "p_size")


@query("SELECT event_id, event_id % 7 AS source, p_name FROM events JOIN part ON p_partkey = event_id % 7 WHERE event_id % 7 <> 0")
def source_lookup(spark, d):
    effects = _events(spark, d, "event_id").withColumn("source", F.col("event_id") % 7)
    return cycles.source_lookup(effects, table(spark, d, "part").select(F.col("p_partkey").alias("source"), "p_name")).select("event_id", "source", "p_name")


@query("SELECT r_regionkey, unnest(range(0, CAST(r_regionkey * 10 + 5 AS BIGINT))) AS frame FROM region")
def frame_clock(spark, d):
    tunes = table(spark, d, "region").select("r_regionkey", (F.col("r_regionkey") * 10 + 5).alias("frames"))
    return cycles.frame_clock(tunes, "frames").drop("frames")


@query("SELECT p_partkey AS row_no, p_size FROM part")
def scan_source(spark, d):
    return _sizes(spark, d)


@query("SELECT event_id, user_id FROM events WHERE event_id % 10 = 0")
def every_nth(spark, d):
    return _events(spark, d, "event_id", "user_id").where("event_id % 10 = 0")


@query("SELECT event_id, 50 AS frame_rate, CAST(20.0 AS DOUBLE) AS period_ms, CAST(event_id * 20.0 AS DOUBLE) AS at_ms FROM events")
def tune_constants(spark, d):
    constants = spark.createDataFrame([(50,)], "frame_rate int").withColumn("period_ms", registers.frame_period_ms(F.col("frame_rate")))
    return _events(spark, d, "event_id").crossJoin(F.broadcast(constants)).withColumn("at_ms", F.col("event_id") * F.col("period_ms"))


@query("SELECT p_partkey AS row, CAST(p_partkey * 6 AS BIGINT) AS frame, n_name AS note, n_nationkey AS period FROM part JOIN nation ON n_nationkey = p_size % 25")
def pattern_to_frames(spark, d):
    pattern = table(spark, d, "part").select(F.col("p_partkey").alias("row"), (F.col("p_size") % 25).alias("key"))
    notes = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("note"), F.col("n_nationkey").alias("period"))
    return cycles.pattern_to_frames(pattern, notes, "row", "key", 6).select("row", "frame", "note", "period")


@query("SELECT p_partkey, CAST(i AS INTEGER) AS row_no, CAST(p_size + [0, 4, 7][CAST(i % 3 + 1 AS INTEGER)] + [0, 1, 0, -1][CAST(i % 4 + 1 AS INTEGER)] AS INTEGER) AS period, CAST(15 - i AS INTEGER) AS volume FROM (SELECT p_partkey, p_size, unnest(range(0, 16)) AS i FROM part)")
def precompute_source(spark, d):
    instruments = table(spark, d, "part").select("p_partkey", "p_size")
    return cycles.precompute_source(instruments, "p_size", [0, 4, 7], [0, 1, 0, -1], list(range(15, -1, -1))).drop("p_size")


# -- mappings and writes ----------------------------------------------------------------------------------------------------


def _mappings(spark, d):
    """Mapping 1: nation to region; mapping 2 has the first ten nations only."""
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("v"))
    return nations.select(F.lit(1).cast("long").alias("mapping"), "k", "v").unionByName(nations.where("k < 10").select(F.lit(2).cast("long").alias("mapping"), "k", (F.col("k") + 100).alias("v")))


_MAPPINGS = "m AS (SELECT 1 AS mapping, n_nationkey AS k, n_regionkey AS v FROM nation UNION ALL SELECT 2, n_nationkey, n_nationkey + 100 FROM nation WHERE n_nationkey < 10)"


@query(f"WITH {_MAPPINGS} SELECT c_custkey, c_custkey % 3 AS mapping, c_nationkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE v END AS INTEGER) AS mapped FROM customer LEFT JOIN m ON m.mapping = c_custkey % 3 AND k = c_nationkey")
def mapping_lookup(spark, d):
    values = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("mapping"), "c_nationkey")
    return mapping.mapping_lookup(values, _mappings(spark, d), "c_nationkey", "mapping", "mapped")


@query(f"WITH {_MAPPINGS} SELECT c_custkey, CAST(c_custkey % 10 AS INTEGER) AS first_value, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE coalesce(v, c_nationkey) END AS INTEGER) AS last_value FROM customer LEFT JOIN m ON m.mapping = c_custkey % 3 AND k = c_nationkey")
def map_last(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 3).alias("mapping"), F.array((F.col("c_custkey") % 10).cast("int"), "c_nationkey").alias("vals"))
    done = mapping.map_last(rows, _mappings(spark, d), "vals", "mapping", missing="value")
    return done.select("c_custkey", F.get("vals", F.lit(0)).alias("first_value"), F.get("vals", F.lit(1)).alias("last_value"))


@query("SELECT l_orderkey, l_linenumber, 0 AS register, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 1, l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 8, l_tax FROM lineitem")
def target_fanout(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit(17).alias("target"), F.array("l_quantity", "l_discount", "l_tax").alias("vals"))
    return mapping.target_fanout(rows, registers.targets(spark), "target", "vals")


@query(" UNION ALL ".join(f"SELECT event_id, '{t}' AS timer, event_id % {7 + i} AS source, event_id % {50 + i} AS count FROM events" for i, t in enumerate("ADBC")))
def effects_long(spark, d):
    wide = _events(spark, d, "event_id").select("event_id", *(c for i, t in enumerate("ADBC") for c in ((F.col("event_id") % (7 + i)).alias(f"{t}_source"), (F.col("event_id") % (50 + i)).alias(f"{t}_count"))))
    return mapping.effects_long(wide, ["event_id"], {t: {"source": f"{t}_source", "count": f"{t}_count"} for t in "ADBC"}, ["source", "count"])


_REGISTER = "SELECT event_id AS frame, user_id, CAST(0 AS BIGINT) AS tick, event_id % 14 AS register, value FROM events WHERE event_type = 'purchase'"
_TICKS = "SELECT frame, user_id, tick, (frame + tick) % 14 AS register, CAST(tick AS DOUBLE) AS value FROM (SELECT event_id AS frame, user_id, unnest(range(0, event_id % 4 + 1)) AS tick FROM events WHERE event_type = 'signup')"


@query(_REGISTER)
def register_trace(spark, d):
    return _events(spark, d).where(_is("purchase")).select(F.col("event_id").alias("frame"), "user_id", F.lit(0).cast("long").alias("tick"), (F.col("event_id") % 14).alias("register"), "value")


@query("SELECT event_id AS frame, user_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'stop' WHEN 'click' THEN 'retune' ELSE 'remap' END AS op FROM events WHERE event_type <> 'purchase'")
def timer_trace(spark, d):
    return _timer_ops(spark, d).withColumnRenamed("event_id", "frame")


@query(_TICKS)
def tick_trace(spark, d):
    started = _events(spark, d).where(_is("signup")).select(F.col("event_id").alias("frame"), "user_id", (F.col("event_id") % 4 + 1).alias("ticks"))
    return cycles.tick_expand(started, "ticks").select("frame", "user_id", "tick", ((F.col("frame") + F.col("tick")) % 14).alias("register"), F.col("tick").cast("double").alias("value"))


@query(f"{_REGISTER} UNION ALL {_TICKS}")
def union_writes(spark, d):
    return checks.union_writes(register_trace(spark, d), tick_trace(spark, d))


_TARGET_ROWS = " UNION ALL ".join(f"SELECT {t} AS target, {i} AS slot, {r} AS register, {len(regs)} AS width" for t, regs in registers.TARGETS.items() for i, r in enumerate(regs))


@query(f"""WITH {_MAPPINGS}, targets AS ({_TARGET_ROWS}),
a AS (SELECT p.event_id, p.user_id, s.event_id AS sid FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.event_id >= s.event_id),
t AS (SELECT *, unnest(range(0, event_id % 12 + 1)) AS tick FROM a),
r AS (SELECT *, CASE WHEN tick < 8 THEN tick ELSE 3 + (tick - 3) % 5 END AS row_no, sid % 3 AS mapping, CASE sid % 3 WHEN 0 THEN 8 WHEN 1 THEN 14 ELSE 17 END AS target FROM t),
v AS (SELECT r.*, slot, register, width, (p_size + slot) % 25 AS raw FROM r JOIN part ON p_partkey = row_no JOIN targets USING (target))
SELECT event_id, user_id, tick, register, CAST(CASE WHEN slot < width - 1 OR v.mapping = 0 THEN raw ELSE coalesce(m.v, raw) END AS INTEGER) AS value FROM v LEFT JOIN m ON m.mapping = v.mapping AND m.k = raw""")
def tick_pipeline(spark, d):
    """The state in force at each purchase, its ticks, the source row of each, the last value mapped, and the target's writes."""
    rows = _events(spark, d)
    starts = rows.where(_is("signup")).select("user_id", "event_id", F.col("event_id").alias("sid"))
    state = timers.asof_state(rows.where(_is("purchase")).select("event_id", "user_id"), starts, "user_id", "event_id", ["sid"], SPAN).where("sid IS NOT NULL")
    ticked = cycles.tick_expand(state.withColumn("ticks", F.col("event_id") % 12 + 1), "ticks").drop("ticks")
    target = F.when(F.col("sid") % 3 == 0, 8).when(F.col("sid") % 3 == 1, 14).otherwise(17)
    source = _sizes(spark, d).select("row_no", "p_size")
    read = cycles.cyclic_read(ticked.select("*", (F.col("sid") % 3).alias("mapping"), target.alias("target")), source, "tick", 8, 3)
    width = F.when(F.col("target") == 8, 1).when(F.col("target") == 14, 2).otherwise(3)
    vals = F.transform(F.sequence(F.lit(0), width - 1), lambda i: (F.col("p_size") + i) % 25)
    mapped = mapping.map_last(read.withColumn("vals", vals), _mappings(spark, d), "vals", "mapping", missing="value")
    return mapping.target_fanout(mapped, registers.targets(spark), "target", "vals").select("event_id", "user_id", "tick", "register", "value")


@query("SELECT p_partkey, p_size, p_partkey % 256 AS host, (CAST(p_size AS BIGINT) & 63) | (p_partkey % 256 & 192) AS merged FROM part")
def mask_merge(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 256).alias("host"))
    return rows.withColumn("merged", registers.masked_merge(F.col("p_size").cast("long"), F.col("host"), 0x3F))


@query("SELECT event_id, event_id % 256 AS control, event_id % 256 & 7 AS divider, event_id % 256 >> 4 AS flags FROM events")
def control_bits(spark, d):
    rows = _events(spark, d, "event_id").withColumn("control", F.col("event_id") % 256)
    divider, flags = registers.control_fields(F.col("control"), 3, 4)
    return rows.select("event_id", "control", divider.alias("divider"), flags.alias("flags"))


@query("SELECT event_id, event_id % 7 AS source, event_id % 7 = 0 AS stops FROM events")
def stop_predicate(spark, d):
    return _events(spark, d, "event_id").select("event_id", (F.col("event_id") % 7).alias("source"), (F.col("event_id") % 7 == 0).alias("stops"))


@query("SELECT event_id, CAST(event_id % 14 AS INTEGER) AS register, CASE WHEN event_id % 14 < 2 THEN 'Voice A tone' WHEN event_id % 14 < 4 THEN 'Voice B tone' WHEN event_id % 14 < 6 THEN 'Voice C tone' WHEN event_id % 14 = 6 THEN 'Noise' WHEN event_id % 14 = 7 THEN 'Mixer' WHEN event_id % 14 < 11 THEN 'Volume' ELSE 'Envelope' END AS use FROM events")
def reg_groups(spark, d):
    rows = _events(spark, d, "event_id").withColumn("register", (F.col("event_id") % 14).cast("int"))
    return rows.join(F.broadcast(registers.register_groups(spark)), "register").select("event_id", "register", "use")


@query("SELECT event_id, substr('ABCD', CAST(event_id % 4 + 1 AS INTEGER), 1) AS timer FROM events WHERE event_id % 4 <> 2")
def exclude_owned(spark, d):
    ops = _events(spark, d, "event_id").withColumn("timer", F.substr(F.lit("ABCD"), (F.col("event_id") % 4 + 1).cast("int"), F.lit(1)))
    return checks.exclude_owned(ops, spark.createDataFrame([("C",)], "timer string"), "timer").select("event_id", "timer")


@query("SELECT p_partkey, p_size, p_retailprice FROM part")
def project_regs(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")


# -- checks and reports -----------------------------------------------------------------------------------------------------


_RANGES = {"l_quantity": (5, 45), "l_discount": (0.0, 0.08), "l_tax": (0.0, 0.08), "l_linenumber": (1, 7)}


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n_checked, count(*) FILTER ({c} NOT BETWEEN {lo} AND {hi}) AS n_bad FROM lineitem" for c, (lo, hi) in _RANGES.items()))
def range_check(spark, d):
    return checks.range_check(table(spark, d, "lineitem").select(*_RANGES), _RANGES)


@query("""WITH o AS (SELECT event_id, event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT 'stop_after_stop' AS rule, event_id AS key, event_type AS detail FROM o WHERE event_type = 'error' AND p = 'error'
UNION ALL SELECT 'start_after_start', event_id, event_type FROM o WHERE event_type = 'signup' AND p = 'signup'
UNION ALL SELECT 'first_is_no_start', event_id, event_type FROM o WHERE p IS NULL AND event_type <> 'signup'""")
def rule_violations(spark, d):
    rows = ordered.previous_row(_events(spark, d, "event_id", "user_id", "event_type"), ["user_id"], "event_id", {"p": F.col("event_type")}, SPAN)
    same = lambda kind: _is(kind) & (F.col("p") == kind)
    rules = {"stop_after_stop": (same("error"), F.col("event_type")), "start_after_start": (same("signup"), F.col("event_type")), "first_is_no_start": (F.col("p").isNull() & ~_is("signup"), F.col("event_type"))}
    return checks.rule_violations(rows, "event_id", rules)


_CHECKED = ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, (min({c}) IS NOT DISTINCT FROM max({c})) AND count({c}) IN (0, count(*)) AS is_constant FROM lineitem" for c in _CHECKED) + " UNION ALL SELECT 'one', true")
def constant_columns(spark, d):
    return checks.constant_columns(table(spark, d, "lineitem").select(*_CHECKED).withColumn("one", F.lit(1)))


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS features FROM events GROUP BY user_id")
def features_used(spark, d):
    return checks.features_used(_events(spark, d, "user_id", "event_type"), "user_id", "event_type")


_COST = "SELECT l_suppkey, CAST(sum(l_linenumber) AS BIGINT) AS advance, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS other, CAST(sum(l_partkey % 100) AS BIGINT) AS timers FROM lineitem GROUP BY l_suppkey"


def _costs(spark, d):
    return reports.cost_total(table(spark, d, "lineitem"), "l_suppkey", advance=F.col("l_linenumber"), other=F.col("l_quantity").cast("long"), timers=F.col("l_partkey") % 100)


@query(f"SELECT *, advance + other + timers AS total FROM ({_COST})")
def cost_total(spark, d):
    return _costs(spark, d)


@query(f"SELECT l_suppkey, advance + other + timers AS total, round(CAST(100 * (advance + other + timers) AS DOUBLE) / 160000, 2) AS pct FROM ({_COST})")
def cost_share(spark, d):
    return reports.cost_share(_costs(spark, d).select("l_suppkey", "total"), "total", 160_000)


@query(f"SELECT l_suppkey, advance + other + timers AS total, round(CAST(advance + other + timers AS DOUBLE) / max(advance + other + timers) OVER (), 6) AS scaled FROM ({_COST})")
def scaled_share(spark, d):
    return reports.scaled_share(_costs(spark, d).select("l_suppkey", "total"), "total")


@query("SELECT l_returnflag, avg(l_quantity) AS mean FROM lineitem GROUP BY l_returnflag")
def frame_mean(spark, d):
    return reports.frame_mean(table(spark, d, "lineitem"), "l_returnflag", "l_quantity")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def size_rollup(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"))
    return reports.size_rollup(rows, ["l_returnflag", "l_linestatus"], "q")


@query("SELECT l_returnflag, count(*) FILTER (l_quantity < 10) AS packed, count(*) AS raw, round(100 * (1 - CAST(count(*) FILTER (l_quantity < 10) AS DOUBLE) / count(*)), 1) AS smaller_pct FROM lineitem GROUP BY l_returnflag")
def size_ratio(spark, d):
    sizes = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") < 10).alias("packed"), F.count("*").alias("raw"))
    return reports.size_ratio(sizes, "packed", "raw")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def group_counts(spark, d):
    return reports.group_counts(table(spark, d, "orders"), "o_orderpriority")


@query("SELECT event_id // 10 AS frame, CAST(sum(event_id % 48 + 1) AS BIGINT) AS ticks, CAST(sum(event_id % 48 + 1) AS DOUBLE) / 50 AS per_frame FROM events GROUP BY event_id // 10")
def ticks_per_frame(spark, d):
    rows = _events(spark, d, "event_id").select(F.expr("event_id div 10").alias("frame"), (F.col("event_id") % 48 + 1).alias("t")).groupBy("frame").agg(F.sum("t").alias("ticks"))
    return rows.withColumn("per_frame", registers.ticks_per_frame(F.col("ticks"), F.lit(50)))


# -- scalars ----------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, format('0x{:X}', event_id % 256) AS text, CAST(event_id % 256 AS INTEGER) AS value FROM events")
def hex_values(spark, d):
    rows = _events(spark, d, "event_id").withColumn("text", F.concat(F.lit("0x"), F.hex(F.col("event_id") % 256)))
    return rows.withColumn("value", registers.hex_to_int(F.col("text")))


@query("SELECT event_id, event_id // 256 % 16 AS high, event_id % 256 AS low, event_id // 256 % 16 * 256 + event_id % 256 AS period FROM events")
def tone_periods(spark, d):
    rows = _events(spark, d, "event_id").select("event_id", F.expr("event_id div 256 % 16").alias("high"), (F.col("event_id") % 256).alias("low"))
    return rows.withColumn("period", registers.tone_period(F.col("high"), F.col("low")))


@query("SELECT event_id, 2 << CAST(event_id % 6 AS INTEGER) AS divider, event_id % 256 AS count, CASE WHEN event_id % 256 > 0 THEN CAST(2457600.0 AS DOUBLE) / ((2 << CAST(event_id % 6 AS INTEGER)) * (event_id % 256)) END AS rate FROM events")
def effect_rates(spark, d):
    """A count of 0 has no rate."""
    rows = _events(spark, d, "event_id").select("event_id", F.expr("shiftleft(2, CAST(event_id % 6 AS INT))").alias("divider"), (F.col("event_id") % 256).alias("count"))
    return rows.withColumn("rate", registers.effect_rate(F.col("divider"), F.col("count")))


@query("SELECT event_id, event_id % 200 AS frame_rate, CASE WHEN event_id % 200 > 0 THEN CAST(8000000 AS DOUBLE) / (event_id % 200) END AS cycles, CASE WHEN event_id % 200 > 0 THEN CAST(1000.0 AS DOUBLE) / (event_id % 200) END AS period_ms FROM events")
def frame_budgets(spark, d):
    """A rate of 0 has no budget and no period."""
    rows = _events(spark, d, "event_id").withColumn("frame_rate", F.col("event_id") % 200)
    return rows.withColumn("cycles", registers.cycles_per_frame(F.col("frame_rate"))).withColumn("period_ms", registers.frame_period_ms(F.col("frame_rate")))


# -- tunes as files ---------------------------------------------------------------------------------------------------------


def _tune(spark, d):
    """Clicks set r0 and r8, signups start timer A; the other registers and timers are never set."""
    set_in = {"r0": (_is("click"), F.col("event_id") % 256), "r8": (_is("click"), F.col("event_id") % 16), "a_source": (_is("signup"), F.col("event_id") % 7), "a_count": (_is("signup"), F.col("event_id") % 256)}
    made = {f.name: F.when(*set_in[f.name]) if f.name in set_in else F.lit(None) for f in tunes.FRAME_SCHEMA.fields[2:]}
    rows = _events(spark, d).select(F.col("user_id").alias("tune_id"), F.col("event_id").alias("frame"), "event_type", "event_id")
    return rows.select("tune_id", "frame", *(made[f.name].cast(f.dataType).alias(f.name) for f in tunes.FRAME_SCHEMA.fields[2:]))


_SET = {"r0": "event_id % 256 FILTER click", "r8": "event_id % 16 FILTER click", "a_source": "event_id % 7 FILTER signup", "a_count": "event_id % 256 FILTER signup"}
_SQL_TYPES = {"smallint": "SMALLINT", "int": "INTEGER"}


def _tune_sql() -> str:
    def one(name: str, kind: str) -> str:
        if name not in _SET:
            return f"CAST(NULL AS {_SQL_TYPES[kind]}) AS {name}"
        value, of = _SET[name].split(" FILTER ")
        return f"CAST(CASE WHEN event_type = '{of}' THEN {value} END AS {_SQL_TYPES[kind]}) AS {name}"

    return "SELECT user_id AS tune_id, event_id AS frame, " + ", ".join(one(f.name, f.dataType.simpleString()) for f in tunes.FRAME_SCHEMA.fields[2:]) + " FROM events"


@query(_tune_sql())
def tune_json(spark, d):
    """A tune written as JSON and read again."""
    path = shared_path(spark, "tune-json")
    tunes.write_tune_json(_tune(spark, d), path)
    return tunes.read_tune_json(spark, path)


@query(_tune_sql())
def tune_csv(spark, d):
    """A tune written as CSV and read again."""
    path = shared_path(spark, "tune-csv")
    tunes.write_tune_csv(_tune(spark, d), path)
    return tunes.read_tune_csv(spark, path)


@query("SELECT tune_id, frame, " + ", ".join(f"CASE WHEN {c} IS DISTINCT FROM lag({c}) OVER w THEN {c} END AS {c}" for c in ("r0", "r1")) + " FROM (SELECT user_id AS tune_id, event_id AS frame, event_id // 64 % 4 AS r0, length(event_type) AS r1 FROM events) WINDOW w AS (PARTITION BY tune_id ORDER BY frame)")
def import_dump(spark, d):
    dense = _events(spark, d, "event_id", "user_id", "event_type").select(F.col("user_id").alias("tune_id"), F.col("event_id").alias("frame"), F.expr("event_id div 64 % 4").alias("r0"), F.length("event_type").cast("long").alias("r1"))
    return tunes.import_dump(dense, span=SPAN)


# -- two clocks -------------------------------------------------------------------------------------------------------------


@query(f"""WITH o AS (SELECT event_id, user_id, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'stop' WHEN 'click' THEN 'retune' ELSE 'remap' END AS op FROM events WHERE event_type <> 'purchase'),
s AS (SELECT *, last_value(CASE WHEN op IN ('start', 'stop') THEN op END IGNORE NULLS) OVER w = 'start' AS active, sum(CASE WHEN op = 'start' THEN 1 ELSE 0 END) OVER w AS run FROM o WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
p AS (SELECT *, coalesce(sum(event_id % 4 + 1) OVER (PARTITION BY user_id, run ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s WHERE active)
SELECT event_id, user_id, tick, CAST(before + tick AS BIGINT) AS position FROM (SELECT event_id, user_id, before, unnest(range(0, event_id % 4 + 1)) AS tick FROM p)""")
def active_ticks(spark, d):
    """The ticks of each operation's frame while its timer is active, with the source position, which goes on until the next start."""
    ops = _timer_ops(spark, d).withColumn("ticks", F.col("event_id") % 4 + 1)
    return timers.active_ticks(ops, "user_id", "event_id", "op", "ticks", SPAN).select("event_id", "user_id", "tick", "position")
