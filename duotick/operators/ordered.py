"""Running values along an order, for keys of any size.

Each function takes ``span``: with it, a key's rows are cut at multiples of ``span`` of the first (numeric or date) order column, each
stretch is one group, and what a stretch hands on is computed from one row for each stretch.  So one very long key is the work of many tasks.
Without it, a key's rows are one group.  Results don't depend on it, except among rows that tie in the whole order, which are in any order.

A null key is a key like any other, and rows whose order is null come first.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

_STRETCH = "__stretch"


def _whole(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def _with_stretch(df: DataFrame, order: str, span: int) -> DataFrame:
    at = F.unix_date(order) if dict(df.dtypes)[order] == "date" else F.col(order)
    return df.withColumn(_STRETCH, F.floor(at / span))


def _earlier(keys: list[str]):
    """The stretches before, of a key's."""
    return Window.partitionBy(*keys).orderBy(_STRETCH).rowsBetween(Window.unboundedPreceding, -1)


def _take_over(inside: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with what its stretch is handed; ``carried`` has a row for each stretch.  Nulls are equal here."""
    on = [*keys, _STRETCH]
    renamed = carried.withColumnsRenamed({c: f"__of_{c}" for c in on})
    return inside.join(renamed, reduce(and_, (inside[c].eqNullSafe(renamed[f"__of_{c}"]) for c in on)))


def running_last(df: DataFrame, keys: list[str], order: str, columns: dict[str, Column], span: int | None = None) -> DataFrame:
    """``columns[name]``: an expression whose last value that isn't null, up to and with the row, becomes column ``name``."""
    if span is None:
        w = _whole(keys, [order])
        return df.select("*", *(F.last(c, ignorenulls=True).over(w).alias(n) for n, c in columns.items()))
    cut = _with_stretch(df, order, span)
    ends = cut.groupBy(*keys, _STRETCH).agg(*(F.max_by(c, F.when(c.isNotNull(), F.struct(order))).alias(f"__{n}") for n, c in columns.items()))
    carried = ends.select(*keys, _STRETCH, *(F.last(f"__{n}", ignorenulls=True).over(_earlier(keys)).alias(f"__{n}") for n in columns))
    w = _whole([*keys, _STRETCH], [order])
    inside = cut.select("*", *(F.last(c, ignorenulls=True).over(w).alias(n) for n, c in columns.items()))
    return _take_over(inside, carried, keys).select(*df.columns, *(F.coalesce(n, f"__{n}").alias(n) for n in columns))


def running_sum(df: DataFrame, keys: list[str], order: str, columns: dict[str, Column], span: int | None = None) -> DataFrame:
    """``columns[name]``: an expression whose sum up to and with the row becomes column ``name``; null before its first value."""
    if span is None:
        w = _whole(keys, [order])
        return df.select("*", *(F.sum(c).over(w).alias(n) for n, c in columns.items()))
    cut = _with_stretch(df, order, span)
    sums = cut.groupBy(*keys, _STRETCH).agg(*(F.sum(c).alias(f"__{n}") for n, c in columns.items()))
    carried = sums.select(*keys, _STRETCH, *(F.sum(f"__{n}").over(_earlier(keys)).alias(f"__{n}") for n in columns))
    w = _whole([*keys, _STRETCH], [order])
    inside = cut.select("*", *(F.sum(c).over(w).alias(n) for n, c in columns.items()))
    both = lambda n: F.coalesce(F.col(n) + F.col(f"__{n}"), n, f"__{n}")
    return _take_over(inside, carried, keys).select(*df.columns, *(both(n).alias(n) for n in columns))


def running_max(df: DataFrame, keys: list[str], order: str, columns: dict[str, Column], span: int | None = None) -> DataFrame:
    """``columns[name]``: an expression whose greatest value up to and with the row becomes column ``name``."""
    if span is None:
        w = _whole(keys, [order])
        return df.select("*", *(F.max(c).over(w).alias(n) for n, c in columns.items()))
    cut = _with_stretch(df, order, span)
    tops = cut.groupBy(*keys, _STRETCH).agg(*(F.max(c).alias(f"__{n}") for n, c in columns.items()))
    carried = tops.select(*keys, _STRETCH, *(F.max(f"__{n}").over(_earlier(keys)).alias(f"__{n}") for n in columns))
    w = _whole([*keys, _STRETCH], [order])
    inside = cut.select("*", *(F.max(c).over(w).alias(n) for n, c in columns.items()))
    return _take_over(inside, carried, keys).select(*df.columns, *(F.greatest(n, f"__{n}").alias(n) for n in columns))  # greatest skips nulls


def previous_row(df: DataFrame, keys: list[str], order: str, columns: dict[str, Column], span: int | None = None) -> DataFrame:
    """``columns[name]``: an expression whose value in the row before becomes column ``name``; null in the first row."""
    return _neighbour(df, keys, [order], columns, span, F.lag, F.max_by)


def next_row(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column], span: int | None = None) -> DataFrame:
    """``columns[name]``: an expression whose value in the row after becomes column ``name``; null in the last row."""
    return _neighbour(df, keys, order, columns, span, F.lead, F.min_by)


def _neighbour(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column], span: int | None, step, edge) -> DataFrame:
    row = F.struct(*(c.alias(n) for n, c in columns.items()))
    if span is None:
        found = df.select("*", step(row).over(Window.partitionBy(*keys).orderBy(*order)).alias("__row"))
        return found.select(*df.columns, *(F.col("__row")[n].alias(n) for n in columns))
    cut = _with_stretch(df, order[0], span).withColumn("__now", row)
    edges = cut.groupBy(*keys, _STRETCH).agg(edge("__now", F.struct(*order)).alias("__edge"))
    carried = edges.select(*keys, _STRETCH, step("__edge").over(Window.partitionBy(*keys).orderBy(_STRETCH)).alias("__edge"))
    inside = cut.select("*", step("__now").over(Window.partitionBy(*keys, _STRETCH).orderBy(*order)).alias("__row"))
    joined = _take_over(inside, carried, keys).withColumn("__row", F.coalesce("__row", "__edge"))
    return joined.select(*df.columns, *(F.col("__row")[n].alias(n) for n in columns))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, span: int | None = None) -> DataFrame:
    """Rows of a key numbered from 0."""
    if span is None:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    cut = _with_stretch(df, order[0], span)
    carried = cut.groupBy(*keys, _STRETCH).agg(F.count("*").alias("__rows")).select(*keys, _STRETCH, F.sum("__rows").over(_earlier(keys)).alias("__rows"))
    inside = cut.withColumn("__nth", F.row_number().over(Window.partitionBy(*keys, _STRETCH).orderBy(*order)) - 1)
    return _take_over(inside, carried, keys).select(*df.columns, (F.coalesce("__rows", F.lit(0)) + F.col("__nth")).cast("long").alias(name))


def rolling(df: DataFrame, keys: list[str], order: str, size: int, aggregates: dict[str, Column], span: int | None = None) -> DataFrame:
    """``aggregates[name]`` over a key's last ``size`` rows up to and with the row.  A stretch is handed the last ``size`` - 1 rows before it."""
    if span is None or size < 2:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0)
        return df.select("*", *(a.over(w).alias(n) for n, a in aggregates.items()))
    cut = _with_stretch(df, order, span)
    ends = cut.withColumn("__back", F.row_number().over(Window.partitionBy(*keys, _STRETCH).orderBy(F.desc_nulls_last(order)))).where(F.col("__back") < size)
    tails = ends.groupBy(*keys, _STRETCH).agg(F.array_sort(F.collect_list(F.struct((-F.col("__back")).alias("at"), F.struct(*df.columns).alias("row")))).alias("__tail"))
    # every stretch has a row, so those before hold enough
    before = Window.partitionBy(*keys).orderBy(_STRETCH).rowsBetween(1 - size, -1)
    held = F.flatten(F.collect_list("__tail").over(before))
    latest = F.slice("__held", F.greatest(F.size("__held") - size + 2, F.lit(1)), size - 1)
    handed = tails.withColumn("__held", held).select(F.col(_STRETCH).alias("__to"), F.explode(latest).alias("__h"))
    halo = handed.select("__h.row.*", F.col("__to").alias(_STRETCH), F.lit(False).alias("__own"))
    both = cut.withColumn("__own", F.lit(True)).unionByName(halo)
    # rows that are handed on come before the stretch's own, also where the order is null or ties
    w = Window.partitionBy(*keys, _STRETCH).orderBy("__own", order).rowsBetween(1 - size, 0)
    return both.select("*", *(a.over(w).alias(n) for n, a in aggregates.items())).where("__own").select(*df.columns, *aggregates)
