"""What limits a transfer, why data was sent again, and translated numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.net import U32, u32_sub


def limitation(zero_window: Column, window_full: Column, lost: Column, rtt_up: Column, idle: Column, known: Column) -> Column:
    """receiver, network, application or unknown; without evidence it is unknown, then each guard in turn."""
    return (
        F.when(~known, "unknown").when(zero_window | window_full, "receiver").when(lost, "network").when(rtt_up & ~idle, "network").when(idle, "application").otherwise("unknown")
    )


def retry_kind(arrived: Column, selective: Column, duplicates: Column, wait_us: Column, rtt_us: Column, deviation_us: Column) -> Column:
    """Why data was sent again: it had arrived; a gap was reported; three repeats asked; or the timer ran out."""
    timer = F.greatest(rtt_us + 4 * deviation_us, F.lit(200_000))
    return F.when(arrived, "spurious").when(selective, "selective").when(duplicates >= 3, "fast").when(wait_us >= timer, "timeout").otherwise("unknown")


def learn_offsets(pairs: DataFrame, by: list[str], a: str, b: str, least: int = 3) -> DataFrame:
    """Per keys the constant difference b - a on the u32 circle, null with a reason if it is not constant or too little is known."""
    d = u32_sub(F.col(b), F.col(a))
    found = pairs.groupBy(*by).agg(F.min(d).alias("_lo"), F.max(d).alias("_hi"), F.count(F.lit(1)).alias("samples"))
    reason = F.when(F.col("_lo") != F.col("_hi"), "inconsistent").when(F.col("samples") < least, "too few samples")
    return found.select(*by, "samples", F.when(reason.isNull(), F.col("_lo")).alias("offset"), reason.alias("reason"))


def normalise(rows: DataFrame, offsets: DataFrame, by: list[str], column: str) -> DataFrame:
    """``rows`` with ``column`` moved back by the offset; rows of a key without one have normal_reason and keep it."""
    joined = rows.join(offsets.select(*by, "offset", F.col("reason").alias("normal_reason")), by, "left")
    moved = F.when(F.col("offset").isNotNull(), F.pmod(F.col(column) - F.col("offset"), F.lit(U32))).otherwise(F.col(column))
    return joined.withColumn(column, moved).drop("offset")


def contiguous_until(rows: DataFrame, by: list[str], lo: str, hi: str, on: str) -> DataFrame:
    """Per keys how far from 0 the ranges reach without a hole, and when the last byte of that came."""
    order = Window.partitionBy(*by).orderBy(lo, hi)
    ahead = F.coalesce(F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = rows.withColumn("_gap", F.col(lo) > ahead)
    whole = ~F.bool_or("_gap").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("_ok", whole).filter("_ok").groupBy(*by).agg(F.max(hi).alias("reached"), F.max(on).alias("completed_us"))


def identity_policy(pairs: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Per keys whether a field stays the same on the way: kept, changed, or unknown with under three rows."""
    same = F.count_if(F.col(a) == F.col(b))
    policy = F.when(F.count(F.lit(1)) < 3, "unknown").when(same == F.count(F.lit(1)), "kept").when(same > 0.9 * F.count(F.lit(1)), "kept").otherwise("changed")
    return pairs.groupBy(*by).agg(policy.alias("policy"), F.count(F.lit(1)).alias("n"))
