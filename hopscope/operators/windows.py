"""Ordered operators over one partition: islands, runs, gaps and unwrapped counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def near_duplicates(rows: DataFrame, by: list[str], on: str, row: str, limit: int) -> DataFrame:
    """``rows`` with duplicate: within ``limit`` after the row before of the same keys."""
    gap = F.col(on) - F.lag(on).over(Window.partitionBy(*by).orderBy(on, row))
    return rows.withColumn("duplicate", F.coalesce(gap.between(0, limit), F.lit(False)))


def islands(rows: DataFrame, by: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """``rows`` numbered from 1 by runs: ``starts`` is true where a new one begins (it may use lag over the same order)."""
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_new", starts.cast("long")).withColumn(name, F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def changed(column: str, by: list[str], order: list[str]) -> Column:
    """True at the first row and where ``column`` differs from the row before, nulls being equal."""
    window = Window.partitionBy(*by).orderBy(*order)
    return (F.row_number().over(window) == 1) | ~F.col(column).eqNullSafe(F.lag(column).over(window))


def gap_over(on: str, by: list[str], order: list[str], limit: int) -> Column:
    """True at the first row and after a gap of more than ``limit``."""
    before = F.lag(on).over(Window.partitionBy(*by).orderBy(*order))
    return before.isNull() | (F.col(on) - before > limit)


def runs(rows: DataFrame, by: list[str], bucket: str, least: int) -> DataFrame:
    """Runs of consecutive whole numbers of ``bucket`` (distinct per key): first, last and length, from ``least`` on."""
    group = F.col(bucket) - F.row_number().over(Window.partitionBy(*by).orderBy(bucket))
    found = rows.withColumn("_run", group).groupBy(*by, "_run").agg(F.min(bucket).alias("first"), F.max(bucket).alias("last"), F.count(F.lit(1)).alias("length"))
    return found.filter(F.col("length") >= least).drop("_run")


def unwrap(rows: DataFrame, by: list[str], order: list[str], counter: str, bits: int, name: str) -> DataFrame:
    """``rows`` with a counter of ``bits`` bits continued past its wraps: each step is the nearest way round."""
    window, size = Window.partitionBy(*by).orderBy(*order), 1 << bits
    step = F.pmod(F.col(counter) - F.lag(counter).over(window) + size + size // 2, F.lit(size)) - size // 2
    first = F.first(counter).over(window.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({"_step": F.coalesce(step, F.lit(0)), "_first": first})
    return rows.withColumn(name, F.col("_first") + F.sum("_step").over(window.rowsBetween(Window.unboundedPreceding, 0))).drop("_step", "_first")


def rolling(rows: DataFrame, by: list[str], on: str, width: int, **aggregates: Column) -> DataFrame:
    """``rows`` with aggregates over the last ``width`` of ``on``, by a range frame on whole numbers."""
    frame = Window.partitionBy(*by).orderBy(on).rangeBetween(-width, 0)
    return rows.withColumns({name: a.over(frame) for name, a in aggregates.items()})


def ewma(rows: DataFrame, by: list[str], order: list[str], value: str, share: float, name: str) -> DataFrame:
    """Per key the final j of j += (x - j) * share over the values in order, from 0: a fold over the sorted list."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_x"))))
    fold = F.aggregate(listed, F.lit(0.0), lambda j, r: j + (r["_x"] - j) * F.lit(share))
    return rows.groupBy(*by).agg(fold.alias(name))


def longest_silence(rows: DataFrame, by: list[str], on: str, start: Column, end: Column) -> DataFrame:
    """Per key the longest gap between rows, clipped to [start, end], only between rows that bracket it."""
    before = F.lag(on).over(Window.partitionBy(*by).orderBy(on))
    gap = F.least(F.col(on), end) - F.greatest(before, start)
    return rows.withColumn("_gap", gap).groupBy(*by).agg(F.max(F.greatest("_gap", F.lit(0))).alias("silence_us"))
