"""Sums and shares of costs and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.registers import percent


def cost_total(rows: DataFrame, key: str, **parts) -> DataFrame:
    """Parts summed for each key, and their total."""
    summed = rows.groupBy(key).agg(*(F.sum(p).cast("long").alias(n) for n, p in parts.items()))
    return summed.withColumn("total", sum((F.col(n) for n in parts), F.lit(0).cast("long")))


def cost_share(costs: DataFrame, cost: str, budget: int, name: str = "pct") -> DataFrame:
    return costs.withColumn(name, percent(F.col(cost), F.lit(budget)))


def scaled_share(costs: DataFrame, cost: str, name: str = "scaled") -> DataFrame:
    """Each cost against the greatest; the maximum is one row, so it is joined rather than windowed over a single partition."""
    top = costs.agg(F.max(cost).alias("__top"))
    return costs.crossJoin(F.broadcast(top)).withColumn(name, F.round(F.try_divide(F.col(cost), F.col("__top")), 6)).drop("__top")


def frame_mean(rows: DataFrame, key: str, value: str, name: str = "mean") -> DataFrame:
    return rows.groupBy(key).agg(F.avg(value).alias(name))


def size_rollup(rows: DataFrame, keys: list[str], size: str, name: str = "bytes") -> DataFrame:
    """Sizes of the parts, their subtotals and the total."""
    return rows.rollup(*keys).agg(F.sum(size).cast("long").alias(name))


def size_ratio(sizes: DataFrame, small: str, large: str, name: str = "smaller_pct") -> DataFrame:
    return sizes.withColumn(name, F.round(100 * (1 - F.try_divide(F.col(small), F.col(large))), 1))


def group_counts(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name))


