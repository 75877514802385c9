"""Matching records across points, missing appearances and what became of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import nearest
from .windows import near_duplicates

#: Kinds of missing appearances.
KINDS = ("capture_miss", "recovered", "impactful", "unrecovered", "unknown")


def hop_matches(obs: DataFrame) -> DataFrame:
    """A row per record, direction and pair of neighbouring hops at which it was seen, with its transit time."""
    a = obs.select("packet_key", "flow", "direction", "hop", F.col("t_us").alias("t_a"), "len")
    b = obs.select("packet_key", "direction", (F.col("hop") - 1).alias("hop"), F.col("t_us").alias("t_b"))
    return a.join(b, ["packet_key", "direction", "hop"]).withColumn("transit_us", F.col("t_b") - F.col("t_a"))


def latency_stats(matches: DataFrame, *by: str) -> DataFrame:
    """Count, extremes and exact quantiles of transit times, in one pass for all segments."""
    q = F.percentile("transit_us", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    stats = matches.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matched"), F.min("transit_us").alias("min_us"), q.alias("_q"), F.max("transit_us").alias("max_us"), F.count_if(F.col("transit_us") < 0).alias("negative")
    )
    return stats.select(*by, "matched", "min_us", *[F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(("p05_us", "p50_us", "p95_us"))], "max_us", "negative")


def missing_appearances(obs: DataFrame, last_hop: int) -> DataFrame:
    """First transmissions seen at a hop before ``last_hop`` and not at the next, with later_seen at any hop beyond."""
    first = obs.filter("attempt = 0")
    seen = first.filter(F.col("hop") < last_hop)
    nxt = first.select("packet_key", (F.col("hop") - 1).alias("hop"))
    beyond = first.groupBy("packet_key").agg(F.max("hop").alias("_top"))
    gone = seen.join(nxt, ["packet_key", "hop"], "left_anti").join(beyond, "packet_key")
    return gone.withColumn("later_seen", F.col("_top") > F.col("hop")).drop("_top")


def recoveries(missing: DataFrame, obs: DataFrame, within_us: int = 60_000_000) -> DataFrame:
    """``missing`` with recovery_us and attempts: the first later copy of the event at the next hop within the limit."""
    copies = obs.filter("attempt > 0").select("event_id", (F.col("hop") - 1).alias("hop"), F.col("t_us").alias("_t"))
    near = missing.select("event_id", "hop", "t_us").join(copies, ["event_id", "hop"])
    near = near.filter((F.col("_t") > F.col("t_us")) & (F.col("_t") <= F.col("t_us") + within_us))
    found = near.groupBy("event_id", "hop").agg(F.min(F.col("_t") - F.col("t_us")).alias("recovery_us"), F.count(F.lit(1)).alias("attempts"))
    return missing.join(found, ["event_id", "hop"], "left")


def loss_kind(later_seen: Column, recovery_us: Column, attempts: Column, stall_us: int) -> Column:
    """The kind, in the order of the evidence: seen later, then recovered by one quick copy, then at a cost, else not."""
    slow = (recovery_us >= stall_us) | (attempts > 1)
    return F.when(later_seen, "capture_miss").when(recovery_us.isNotNull() & ~slow, "recovered").when(recovery_us.isNotNull(), "impactful").otherwise("unrecovered")


def classify_losses(obs: DataFrame, last_hop: int = 3, stall_us: int = 200_000) -> DataFrame:
    """Every missing appearance with its kind."""
    rows = recoveries(missing_appearances(obs, last_hop), obs)
    return rows.withColumn("kind", loss_kind(F.col("later_seen"), F.col("recovery_us"), F.col("attempts"), stall_us))


def segment_report(obs: DataFrame, last_hop: int = 3, least: int = 1) -> DataFrame:
    """A row per direction and hop: latency, kinds, and loss_percent, null with a reason where evidence is short."""
    latency = latency_stats(hop_matches(obs), "direction", "hop")
    losses = classify_losses(obs, last_hop).groupBy("direction", "hop").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS[:-1]])
    rows = latency.join(losses, ["direction", "hop"], "full").fillna(0, ["matched", *KINDS[:-1]])
    lost, known = F.col("recovered") + F.col("impactful") + F.col("unrecovered"), F.col("matched") + F.col("recovered") + F.col("impactful") + F.col("unrecovered")
    reason = F.when(known < least, "too few matchable records")
    return rows.withColumns({"loss_percent": F.when(reason.isNull(), F.round(100 * lost / known, 6)), "reason": reason})


def prepare_occurrences(obs: DataFrame, identity: list[str], on: str, row: str, duplicate_us: int = 20) -> DataFrame:
    """``obs`` with eligible, base_key, occurrence and calibration.

    Near duplicates at a point are not eligible; the others of one identity are numbered in time; a
    record calibrates clocks if its identity is alone at its point.
    """
    base = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity]))
    rows = near_duplicates(obs.withColumn("base_key", base), ["point", "base_key"], on, row, duplicate_us)
    part = Window.partitionBy("point", "base_key", "duplicate")
    rows = rows.withColumns({"eligible": ~F.col("duplicate"), "occurrence": F.row_number().over(part.orderBy(on, row)).cast("long"), "_n": F.count(F.lit(1)).over(part)})
    return rows.withColumn("calibration", F.col("eligible") & (F.col("_n") == 1)).drop("_n", "duplicate")


def match_occurrences(rows: DataFrame, anchor: str, on: str, row: str, window: int) -> DataFrame:
    """``rows`` of prepare_occurrences with packet_key and excluded_reason.

    Per key the rows of every point are held against those at point ``anchor``. If all points have as
    many and every pairing in order lies within ``window``, that is the match. Else each row takes its
    nearest anchor and each anchor its nearest row; what is left is a collision and no longer eligible.
    """
    good = rows.filter("eligible")
    anchors = good.filter(F.col("point") == anchor).select("base_key", F.col(on).alias("_at"), F.col("occurrence").alias("_o"))
    counts = good.groupBy("base_key", "point").agg(F.count(F.lit(1)).alias("_n"))
    even = counts.groupBy("base_key").agg((F.min("_n") == F.max("_n")).alias("_even"), F.bool_or(F.col("point") == anchor).alias("_known"))
    paired = good.join(even, "base_key").join(anchors.withColumnRenamed("_o", "occurrence"), ["base_key", "occurrence"], "left")
    inside = F.coalesce(F.abs(F.col(on) - F.col("_at")) <= window, F.lit(False))
    paired = paired.withColumn("_bal", F.col("_even") & F.col("_known") & F.bool_and(inside).over(Window.partitionBy("base_key")))
    kept = [F.col(c) for c in rows.columns]
    settled = paired.filter("_bal OR NOT _known").select(*kept, F.col("occurrence").alias("_match"))
    rest = paired.filter("NOT _bal AND _known").select(*kept)
    close = nearest(rest, anchors.withColumnRenamed("_at", on), ["base_key"], on, "_o", window)
    order = F.row_number().over(Window.partitionBy("point", "base_key", "near__o").orderBy("gap", on, row))
    placed = close.withColumn("_r", order).select(*kept, F.when(F.col("_r") == 1, F.col("near__o")).alias("_match"))
    apart = rows.filter("NOT eligible").select(*kept, F.lit(None).cast("long").alias("_match"))
    out = settled.unionByName(placed).unionByName(apart)
    collided = F.col("eligible") & F.col("_match").isNull()
    return out.select(
        *[c for c in rows.columns if c != "eligible"], F.md5(F.concat_ws("|", "base_key", F.coalesce(F.col("_match"), F.lit(0)).cast("string"))).alias("packet_key"),
        (F.col("eligible") & ~collided).alias("eligible"), F.when(collided, "occurrence collision").when(~F.col("eligible"), "near duplicate").alias("excluded_reason"),
    )


