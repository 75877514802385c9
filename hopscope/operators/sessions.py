"""Linking, lifecycles and heuristics over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import connected_components
from .windows import runs


def partition_legs(rows: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``rows`` with key kept apart by leg: points that only an opaque hop joins never share a key.

    ``edges`` has a, b and opaque; a leg is a component of the others.
    """
    legs = connected_components(edges.filter("NOT opaque"), "a", "b").select(F.col("node").alias("point"), F.col("component").cast("string").alias("_leg"))
    named = rows.join(legs, "point", "left")
    leg = F.coalesce("_leg", F.col("point").cast("string"))
    return named.withColumn(key, F.md5(F.concat_ws("|", F.col(key).cast("string"), leg))).drop("_leg")


def link_sessions(rows: DataFrame, stream: str, key: str, least: int = 1) -> DataFrame:
    """(stream, session): streams that share at least ``least`` keys are one session, named by the smallest.

    Streams meet at their common keys, so a key is a hub and nothing is paired.
    """
    if least == 1:
        hub = rows.groupBy(key).agg(F.min(stream).alias("_first"))
        edges = rows.select(key, stream).distinct().join(hub, key).select(F.col("_first").alias("a"), F.col(stream).alias("b"))
    else:
        seen = rows.select(key, stream).distinct()
        hub = seen.groupBy(key).agg(F.min(stream).alias("a"))
        shared = seen.join(hub, key).filter(F.col("a") != F.col(stream)).groupBy("a", F.col(stream).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        edges = shared.filter(F.col("n") >= least).select("a", "b")
    found = connected_components(edges, "a", "b").select(F.col("node").alias(stream), F.col("component").alias("session"))
    return rows.select(stream).distinct().join(found, stream, "left").select(stream, F.coalesce("session", stream).alias("session"))


def lifecycle(opens: DataFrame, answers: DataFrame, ends: DataFrame, by: str, on: str, row: str, timeout: int) -> DataFrame:
    """Each opening with the first answer and the first completion after it within ``timeout`` of the step before.

    half_until is when it stops being half open: at its completion or when the time is up.
    """

    def first_after(rows: DataFrame, since: str, later: DataFrame, name: str) -> DataFrame:
        near = rows.select(row, by, F.col(since).alias("_s")).join(later.select(by, F.col(on).alias("_t")), by)
        near = near.filter((F.col("_t") > F.col("_s")) & (F.col("_t") <= F.col("_s") + timeout)).groupBy(row).agg(F.min("_t").alias(name))
        return rows.join(near, row, "left")

    rows = first_after(opens.select(row, by, on), on, answers, "answer_us")
    rows = first_after(rows, "answer_us", ends, "done_us")
    return rows.withColumn("half_until", F.least(F.coalesce("done_us", F.col(on) + timeout), F.col(on) + timeout))


def half_open(cycle: DataFrame, on: str, width: int) -> DataFrame:
    """Half-open openings per bucket: each is listed in the buckets that it touches, never against a grid."""
    buckets = F.sequence(F.floor(F.col(on) / width), F.floor(F.col("half_until") / width))
    return cycle.select(F.explode(buckets).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("half_open"))


def waves(cycle: DataFrame, by: str, on: str, width: int, least: int, sources: int, completed: float, sustained: int) -> DataFrame:
    """Runs of buckets with many openings from many sources of which few complete."""
    per = cycle.groupBy(F.floor(F.col(on) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(by).alias("s"), F.count("done_us").alias("d"))
    hot = per.filter((F.col("n") >= least) & (F.col("s") >= sources) & (F.col("d") < completed * F.col("n")))
    return runs(hot.withColumn("all", F.lit(1)), ["all"], "bucket", sustained).drop("all")


def fan_out(rows: DataFrame, by: str, on: str, target: str, failed: Column, width: int, targets: int, ratio: float) -> DataFrame:
    """Rows at which a source has tried ``targets`` or more in the last ``width``, a share ``ratio`` of the tries failing."""
    frame = Window.partitionBy(by).orderBy(on).rangeBetween(-width, 0)
    seen = rows.withColumns({"targets": F.size(F.collect_set(target).over(frame)).cast("long"), "tries": F.count(F.lit(1)).over(frame), "failures": F.count_if(failed).over(frame)})
    return seen.filter((F.col("targets") >= targets) & (F.col("failures") >= ratio * F.col("tries")))


def reset_storms(resets: DataFrame, on: str, row: str, flow: str, gap: int, flows: int = 2, width: int = 3_600_000_000) -> DataFrame:
    """Clusters of resets at most ``gap`` apart that hit ``flows`` or more.

    Gaps are looked at inside windows of time and across their borders by the windows' ends, so no
    task orders all resets.
    """
    cell = resets.withColumn("_w", F.floor(F.col(on) / width))
    edge = cell.groupBy("_w").agg(F.max(on).alias("_end"))
    reach = edge.withColumn("_before", F.max("_end").over(Window.orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)))
    inside = Window.partitionBy("_w").orderBy(on, row)
    rows = cell.join(reach.select("_w", "_before"), "_w").withColumn("_prev", F.coalesce(F.lag(on).over(inside), F.col("_before")))
    rows = rows.withColumn("_new", F.when(F.col("_prev").isNull() | (F.col(on) - F.col("_prev") > gap), F.col(on)))
    first = F.last("_new", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    # A storm that crosses a border takes the last start of the windows before.
    starts = rows.groupBy("_w").agg(F.max("_new").alias("_start"))
    carried = starts.withColumn("_carry", F.max("_start").over(Window.orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)))
    named = rows.withColumn("_own", first).join(carried.select("_w", "_carry"), "_w").withColumn("storm", F.coalesce("_own", "_carry"))
    found = named.groupBy("storm").agg(F.min(on).alias("start_us"), F.max(on).alias("end_us"), F.count(F.lit(1)).alias("resets"), F.countDistinct(flow).alias("flows"))
    return found.filter(F.col("flows") >= flows).drop("storm")


def reconnects(ends: DataFrame, opens: DataFrame, by: str, on: str, row: str, within: int) -> DataFrame:
    """Each end with the time until the next opening of its key, null if none comes within the limit."""
    from .joins import asof

    after = opens.select(by, (F.col(on) - 1).alias(on), F.col(on).alias("_open"))
    near = asof(ends.select(row, by, on), after, [by], on, ["_open"], forward=True)
    wait = F.col("r__open") - F.col(on)
    return near.select(row, by, F.when(wait <= within, wait).alias("after_us"))
