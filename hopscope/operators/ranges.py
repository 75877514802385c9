"""Byte ranges: wrapped intervals, elementary atoms, their matching and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import U32
from .joins import interval_join


def intervals(rows: DataFrame, seq: str, length: Column, keep: list[str]) -> DataFrame:
    """``keep`` with lo and hi of each row's bytes on the u32 circle; a range over the wrap becomes two."""
    end = F.col(seq) + length
    first = F.struct(F.col(seq).alias("lo"), F.least(end, F.lit(U32)).alias("hi"))
    parts = F.when(end > U32, F.array(first, F.struct(F.lit(0).cast("long").alias("lo"), (end - U32).alias("hi")))).otherwise(F.array(first))
    return rows.filter(length > 0).select(*keep, F.explode(parts).alias("_p")).select(*keep, "_p.lo", "_p.hi")


def atoms(ranges: DataFrame, by: list[str]) -> DataFrame:
    """by, lo, hi: the intervals between neighbouring edges of any range of the keys that some range covers."""
    edges = ranges.select(*by, "lo").union(ranges.select(*by, "hi")).distinct()
    cells = edges.withColumn("hi", F.lead("lo").over(Window.partitionBy(*by).orderBy("lo"))).filter("hi IS NOT NULL")
    cover = cells.select(*by, F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    inside = interval_join(cover, ranges.select(*by, "lo", "hi"), by, "lo", "hi", 4096, "a_lo", "a_hi")
    return inside.select(*by, F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi")).distinct()


def atom_rows(ranges: DataFrame, by: list[str], extra: list[str]) -> DataFrame:
    """Each range cut into the atoms of its keys: by, extra, lo, hi."""
    cells = atoms(ranges, by).select(*by, F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"))
    cut = interval_join(cells, ranges.select(*by, *extra, "lo", "hi"), by, "lo", "hi", 4096, "a_lo", "a_hi")
    return cut.select(*by, *extra, F.col("a_lo").alias("lo"), F.col("a_hi").alias("hi"))


def coverage(cut: DataFrame, by: list[str], here: int, there: int) -> DataFrame:
    """Of the bytes seen at point ``here`` per keys: how many, how many of them at ``there``, and the missing ones.

    A range is later seen if all its atoms are, unknown if only some are.
    """
    at = cut.groupBy(*by, "lo", "hi").agg(F.bool_or(F.col("point") == here).alias("h"), F.bool_or(F.col("point") == there).alias("t")).filter("h")
    size = F.col("hi") - F.col("lo")
    sums = at.groupBy(*by).agg(F.sum(size).alias("bytes"), F.sum(F.when(F.col("t"), size).otherwise(0)).alias("seen"), F.bool_and("t").alias("_all"), F.bool_or("t").alias("_some"))
    state = F.when(F.col("_all"), "seen").when(F.col("_some"), "unknown").otherwise("missing")
    return sums.select(*by, "bytes", "seen", (F.col("bytes") - F.col("seen")).alias("missing"), state.alias("state"))
