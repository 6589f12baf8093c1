"""Checks of tunes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def range_check(rows: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """For each column: values checked, and those outside its range; one pass."""
    aggregates = [a for c, (lo, hi) in ranges.items() for a in (F.count(c).alias(f"{c}__n"), F.count_if(~F.col(c).between(lo, hi)).alias(f"{c}__bad"))]
    one = rows.agg(*aggregates)
    listed = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("n_checked"), F.col(f"{c}__bad").alias("n_bad")) for c in ranges))
    return one.select(F.explode(listed).alias("r")).select("r.*")


def rule_violations(rows: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """``rules[name]`` = (violated, detail): a row for each violation, all rules in one pass."""
    found = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(n).alias("rule"), detail.cast("string").alias("detail"))) for n, (bad, detail) in rules.items())))
    return rows.select(F.col(key).alias("key"), F.explode(found).alias("v")).select("v.rule", "key", "v.detail")


def constant_columns(rows: DataFrame) -> DataFrame:
    """Whether all rows have one value, null counted as a value; from minima, maxima and counts in one pass."""
    plain = rows.columns
    one = rows.agg(F.count("*").alias("n"), *(f(c).alias(f"{c}__{k}") for c in plain for k, f in (("lo", F.min), ("hi", F.max), ("set", F.count))))
    constant = lambda c: F.col(f"{c}__lo").eqNullSafe(F.col(f"{c}__hi")) & ((F.col(f"{c}__set") == F.col("n")) | (F.col(f"{c}__set") == 0))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), constant(c).alias("is_constant")) for c in plain))).alias("r")).select("r.*")


def features_used(ops: DataFrame, key: str, op: str) -> DataFrame:
    """The operations a tune uses, sorted; the set is as small as the vocabulary of operations."""
    return ops.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(op)), ",").alias("features"))


def exclude_owned(ops: DataFrame, owned: DataFrame, timer: str) -> DataFrame:
    return ops.join(owned, timer, "left_anti")


def union_writes(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
