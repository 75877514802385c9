"""The whole analysis: records and a topology to a report of small tables."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings, matching, series
from .topology import Topology, overlapping, restrict_scope, select_observations

IDENTITY = ["proto", "src", "dst", "sport", "dport", "seq", "ack", "flags", "length", "ipid"]


@dataclass
class Analysis:
    """Frames of one analysis; all are lazy but the observations, which are written once."""

    observations: DataFrame
    clocks: dict[str, dict]
    matches: DataFrame
    losses: DataFrame
    segments: DataFrame
    buckets: DataFrame
    onsets: DataFrame
    flows: DataFrame

    def sections(self) -> dict[str, DataFrame]:
        order = ["direction", "point_a"]
        return {
            "segments": self.segments.orderBy(*order),
            "findings": findings.severity(self.losses.groupBy(*order, "kind").agg(F.count(F.lit(1)).alias("n"), F.min("t_us").alias("first_us"))),
            "onsets": self.onsets.orderBy(*order),
            "flows": self.flows.orderBy(F.desc("bytes"), "flow"),
        }


def clock_samples(observations: DataFrame, limit: int = 20_000) -> DataFrame:
    """Two-way samples of each pair of sources from records that are alone at their points, at most ``limit`` a pair."""
    alone = observations.filter("calibration").select("base_key", "direction", "source", "point", F.col("t_us").alias("t"))
    a, b = alone.alias("a"), alone.alias("b")
    pairs = a.join(b, (F.col("a.base_key") == F.col("b.base_key")) & (F.col("a.direction") == F.col("b.direction")) & (F.col("a.source") < F.col("b.source")))
    rows = pairs.select(F.concat_ws("\t", "a.source", "b.source").alias("pair"), F.col("a.t").alias("ref_us"), F.col("b.t").alias("other_us"), (F.col("a.direction") == "forward").alias("forward"))
    return series.sample_by_hash(rows, ["pair"], ["ref_us", "other_us"], limit)


def analyse(records: DataFrame, topology: Topology, identity: list[str] | None = None) -> Analysis:
    """From typed records (source, iface, row_id, t_us, flow, direction and the identity columns) to segments and series.

    The order matters: duplicates and calibration, clocks, matching by corrected time, then losses. The observations
    are cut from their lineage once after matching; only clock models, a row per pair of sources, reach the driver.
    """
    spark, identity = records.sparkSession, identity or IDENTITY
    selected = select_observations(records, topology)
    if not overlapping(selected).isEmpty():
        raise ValueError("two points select the same record")
    scoped, _ = restrict_scope(selected)
    rows = scoped.withColumn("uid", F.concat_ws("/", "source", "point", F.col("row_id").cast("string")))
    prepared = matching.prepare_occurrences(rows, [*identity, "direction"], "t_us", "uid", topology.duplicate_us).checkpoint()
    fitted = {tuple(r["pair"].split("\t")): r.asDict() for r in series.clock_models(clock_samples(prepared), "pair").collect()}
    sources = list(dict.fromkeys(p.source for p in topology.points))
    domains = {p.source: p.domain for p in topology.points}
    clocks = findings.align({k: m | {"offset_us": m["offset_us"]} for k, m in fitted.items()}, sources, domains, {s: o for s, (o, _) in topology.overrides.items()})
    epoch = min((m["epoch_us"] for m in fitted.values() if m["epoch_us"] is not None), default=0.0)
    table = spark.createDataFrame([(s, c["offset_us"], c["drift"], c["reason"]) for s, c in clocks.items()], "source string, offset_us double, drift double, clock_reason string")
    timed = prepared.join(F.broadcast(table), "source")  # a row per source
    fixed = F.round(series.corrected(F.col("t_us"), F.lit(epoch), F.coalesce("offset_us", F.lit(0.0)), F.coalesce("drift", F.lit(0.0)))).cast("long")
    timed = timed.withColumns({"recorded_us": F.col("t_us"), "t_us": fixed}).drop("offset_us", "drift")
    matched = matching.match_occurrences(timed, topology.forward[0], "t_us", "uid", topology.match_window_ms * 1000)
    places = [(d, p, k) for d in ("forward", "reverse") for k, p in enumerate(topology.path(d))]
    hops = spark.createDataFrame(places, "direction string, point string, hop int")
    observed = matched.join(F.broadcast(hops), ["direction", "point"])  # at most 128 rows
    attempt = F.when(F.col("eligible"), F.lit(0)).otherwise(F.lit(1))
    observed = observed.withColumns({"len": F.col("length").cast("long"), "event_id": F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in identity if c != "ipid"])), "attempt": attempt})
    observed = observed.filter("eligible").checkpoint()
    last = len(topology.forward) - 1
    pairs = spark.createDataFrame([(d, k, a, b) for d in ("forward", "reverse") for k, (a, b) in enumerate(itertools.pairwise(topology.path(d)))], "direction string, hop int, point_a string, point_b string")

    def named(frame: DataFrame) -> DataFrame:
        return frame.join(F.broadcast(pairs), ["direction", "hop"])

    losses = named(_losses(observed, last, topology.stall_ms * 1000))
    matches = named(matching.hop_matches(observed))
    segments = _segments(matches, losses)
    width = int(topology.bucket_seconds * 1_000_000)
    buckets = _buckets(observed, losses, width, topology.min_eligible_ratio, last)
    onsets = series.detect_onsets(named(buckets), ["direction", "point_a"], "bucket", "lost")
    flows = observed.groupBy("flow").agg(F.count(F.lit(1)).alias("rows"), F.sum("len").alias("bytes"), F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))
    return Analysis(observed, clocks, matches, losses, segments, buckets, onsets, flows)


def _losses(observed: DataFrame, last: int, stall_us: int) -> DataFrame:
    """Missing appearances; a later record with the same content at the next hop is the copy that recovered it."""
    gone = matching.missing_appearances(observed, last)
    later = observed.select("event_id", (F.col("hop") - 1).alias("hop"), "direction", F.col("t_us").alias("_t"), F.col("packet_key").alias("_k"))
    near = gone.select("event_id", "hop", "direction", "packet_key", "t_us").join(later, ["event_id", "hop", "direction"])
    near = near.filter((F.col("_k") != F.col("packet_key")) & (F.col("_t") > F.col("t_us")) & (F.col("_t") <= F.col("t_us") + 60_000_000))
    found = near.groupBy("packet_key", "hop").agg(F.min(F.col("_t") - F.col("t_us")).alias("recovery_us"), F.count(F.lit(1)).alias("attempts"))
    rows = gone.join(found, ["packet_key", "hop"], "left")
    return rows.withColumn("kind", matching.loss_kind(F.col("later_seen"), F.col("recovery_us"), F.col("attempts"), stall_us))


def _segments(matches: DataFrame, losses: DataFrame) -> DataFrame:
    keys = ["direction", "hop", "point_a", "point_b"]
    latency = matching.latency_stats(matches, *keys)
    kinds = losses.groupBy(*keys).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in matching.KINDS[:-1]])
    rows = latency.join(kinds, keys, "full").fillna(0, ["matched", *matching.KINDS[:-1]])
    lost = F.col("recovered") + F.col("impactful") + F.col("unrecovered")
    known = F.col("matched") + lost
    reason = F.when(known == 0, "no matchable records")
    return rows.withColumns({"loss_percent": F.when(reason.isNull(), F.round(100 * lost / known, 6)), "reason": reason})


def _buckets(observed: DataFrame, losses: DataFrame, width: int, ratio: float, last: int) -> DataFrame:
    spans = observed.groupBy("direction", "hop").agg(F.min("t_us").alias("a"), F.max("t_us").alias("b")).filter(F.col("hop") < last)
    cells = series.grid(spans, F.col("a"), F.col("b"), width)
    bucket, keys = F.floor(F.col("t_us") / width).alias("bucket"), ["direction", "hop", "bucket"]
    eligible = observed.filter(F.col("hop") < last).groupBy("direction", "hop", bucket).agg(F.count(F.lit(1)).alias("eligible"))
    lost = losses.groupBy("direction", "hop", bucket).agg(F.count_if(F.col("kind") != "capture_miss").alias("lost"), F.count_if(F.col("kind") == "capture_miss").alias("missed"))
    rows = cells.join(eligible, keys, "left").join(lost, keys, "left").fillna(0, ["eligible", "lost", "missed"])
    start = F.col("bucket") * width
    rows = rows.withColumn("coverage", series.coverage_state(start, start + width, F.col("a"), F.col("b")))
    value, reason = series.gated(F.round(100 * F.col("lost") / F.nullif("eligible", F.lit(0)), 6), F.col("coverage"), F.col("eligible"), F.col("eligible") - F.col("missed"), ratio)
    return rows.select(*keys, "coverage", "eligible", "lost", value.alias("loss_percent"), reason.alias("reason"))
