"""Lookups of values, and writes of several registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import registers


def mapping_lookup(values: DataFrame, mappings: DataFrame, value: str, mapping: str, out: str, missing: str = "null") -> DataFrame:
    """``mappings(mapping, k, v)``; mapping 0 passes a value through.  ``missing``: what a key that a mapping lacks gives, "null" or "value"."""
    table = mappings.select(F.col("mapping").alias(mapping), F.col("k").alias("__k"), F.col("v").alias("__v"))
    found = values.join(table, (values[mapping] == table[mapping]) & (values[value] == table["__k"]), "left").drop(table[mapping])
    looked = F.coalesce(F.col("__v"), F.col(value)) if missing == "value" else F.col("__v")
    return found.withColumn(out, F.when(F.col(mapping) == 0, F.col(value)).otherwise(looked)).drop("__k", "__v")


def map_last(rows: DataFrame, mappings: DataFrame, values: str, mapping: str, missing: str = "null") -> DataFrame:
    """Only the last of several values is mapped."""
    keyed = rows.withColumn("__last", F.element_at(values, -1))
    mapped = mapping_lookup(keyed, mappings, "__last", mapping, "__mapped", missing)
    return mapped.withColumn(values, registers.replace_last(F.col(values), F.col("__mapped"))).drop("__last", "__mapped")


def target_fanout(rows: DataFrame, targets: DataFrame, target: str, values: str, register: str = "register", value: str = "value") -> DataFrame:
    """One write for each register of the target.  Spark broadcasts the table of targets if it is small."""
    zipped = F.explode(F.arrays_zip(F.col("regs").alias("r"), F.col(values).alias("v")))
    kept = [c for c in rows.columns if c not in (values, target)]
    return rows.join(targets, target).select(*kept, zipped.alias("__w")).select(*kept, F.col("__w.r").alias(register), F.col("__w.v").alias(value)).where(F.col(register).isNotNull())


def effects_long(rows: DataFrame, ids: list[str], fields: dict[str, dict[str, str]], names: list[str]) -> DataFrame:
    """``fields[timer][name]`` is a column: one row for each timer, with columns ``names``."""
    structs = [F.struct(F.lit(t).alias("timer"), *(F.col(f[n]).alias(n) for n in names)) for t, f in fields.items()]
    return rows.select(*ids, F.explode(F.array(*structs)).alias("__e")).select(*ids, "__e.*")
