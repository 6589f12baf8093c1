"""Scalar functions and fixed tables of registers, targets and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# What registers are used for.
REGISTER_GROUPS = [
    (0, "Voice A tone"), (1, "Voice A tone"), (2, "Voice B tone"), (3, "Voice B tone"), (4, "Voice C tone"), (5, "Voice C tone"), (6, "Noise"),
    (7, "Mixer"), (8, "Volume"), (9, "Volume"), (10, "Volume"), (11, "Envelope"), (12, "Envelope"), (13, "Envelope"),
]

# The registers that a target code writes together.
TARGETS = {8: [8], 9: [9], 10: [10], 13: [13], 14: [0, 1], 17: [0, 1, 8], 21: [11, 12, 13], 22: [6, 8]}

# The clock of the timers, and of the processor.
TIMER_CLOCK = 2_457_600
PROCESSOR_CLOCK = 8_000_000


def register_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGISTER_GROUPS, "register int, use string")


def targets(spark: SparkSession) -> DataFrame:
    """A table whose size Spark knows."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, array({', '.join(map(str, v))}))" for k, v in TARGETS.items()) + " AS t(target, regs)")


def hex_to_int(text: Column) -> Column:
    return F.conv(F.regexp_replace(text, "^0[xX]", ""), 16, 10).cast("int")


def tone_period(high: Column, low: Column) -> Column:
    return high * 256 + low


def ticks_per_frame(tick_rate: Column, frame_rate: Column) -> Column:
    return F.try_divide(tick_rate, frame_rate)


def cycles_per_frame(frame_rate: Column, clock: int = PROCESSOR_CLOCK) -> Column:
    return F.try_divide(F.lit(clock), frame_rate)


def frame_period_ms(frame_rate: Column) -> Column:
    return F.try_divide(F.lit(1000.0), frame_rate)


def effect_rate(divider: Column, count: Column, clock: int = TIMER_CLOCK) -> Column:
    """The rate of a timer with a prescaler and a reload count; which dividers there are is the caller's table."""
    return F.try_divide(F.lit(float(clock)), divider * count)


def masked_merge(register: Column, host: Column, mask: int, width: int = 8) -> Column:
    """The player's bits under ``mask``, the host's elsewhere."""
    rest = ~mask & ((1 << width) - 1)
    return register.bitwiseAND(F.lit(mask)).bitwiseOR(host.bitwiseAND(F.lit(rest)))


def control_fields(control: Column, divider_bits: int, flag_shift: int) -> tuple[Column, Column]:
    """(divider, flags) of a control value; where they lie is the caller's to say."""
    return control.bitwiseAND(F.lit((1 << divider_bits) - 1)), F.shiftright(control, flag_shift)


def percent(part: Column, whole: Column, places: int = 2) -> Column:
    return F.round(F.try_divide(100 * part, whole), places)


def replace_last(values: Column, last: Column) -> Column:
    return F.concat(F.slice(values, 1, F.size(values) - 1), F.array(last))
