"""Clock propagation, onset order, labels and sentences: small results that are put together at the end."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align(models: dict[tuple[str, str], dict], sources: list[str], domains: dict[str, str] | None = None, overrides: dict[str, float] | None = None) -> dict[str, dict]:
    """Clock of every source against the first one's: offsets add up along the paths of least uncertainty.

    ``models`` has (reference, other): a fit. Sources of one domain share a clock; an override fixes one. A source that no
    usable fit reaches is unknown, with the reason. The points of a path are few: this is a walk on the driver.
    """
    domains, overrides = domains or {}, overrides or {}
    steps: dict[str, list[tuple[str, float, float, float]]] = {s: [] for s in sources}
    for (a, b), m in models.items():
        if m.get("reason") is None and m.get("offset_us") is not None:
            steps[a].append((b, m["offset_us"], m["drift"], m["uncertainty_us"]))
            steps[b].append((a, -m["offset_us"], -m["drift"], m["uncertainty_us"]))
    for a in sources:
        steps[a] += [(b, 0.0, 0.0, 0.0) for b in sources if b != a and domains.get(a) and domains.get(a) == domains.get(b)]
    found = {sources[0]: {"offset_us": 0.0, "drift": 0.0, "uncertainty_us": 0.0, "reason": None}} if sources else {}
    for s, offset in overrides.items():
        found[s] = {"offset_us": float(offset), "drift": 0.0, "uncertainty_us": 0.0, "reason": None}
    queue = deque(found)
    while queue:
        a = queue.popleft()
        for b, offset, drift, uncertainty in steps[a]:
            total = found[a]["uncertainty_us"] + uncertainty
            if b not in overrides and (b not in found or total < found[b]["uncertainty_us"]):
                found[b] = {"offset_us": found[a]["offset_us"] + offset, "drift": found[a]["drift"] + drift, "uncertainty_us": total, "reason": None}
                queue.append(b)
    return {s: found.get(s, {"offset_us": None, "drift": None, "uncertainty_us": None, "reason": "no calibrated path to the reference"}) for s in sources}


def onset_groups(onsets: list[dict]) -> list[dict]:
    """Onsets in order of time, numbered by groups that the uncertainty cannot part; the first group has the prime suspects."""
    out, group, reach = [], 0, None
    for o in sorted((o for o in onsets if o["onset"] is not None), key=lambda o: (o["onset"], o["scope"])):
        low, high = o["onset"] - o["uncertainty"], o["onset"] + o["uncertainty"]
        if reach is None or low > reach:
            group, reach = group + 1, high
        reach = max(reach, high)
        out.append(o | {"group": group, "prime": group == 1})
    return out


def label_retries(retries: DataFrame, losses: DataFrame, flow: str, on: str, window: int) -> DataFrame:
    """symptom if a loss of the flow lies within ``window`` before the retry, else suspect."""
    near = retries.select("row_id", flow, F.col(on).alias("_t")).join(losses.select(flow, F.col(on).alias("_l")), flow)
    near = near.filter((F.col("_l") <= F.col("_t")) & (F.col("_l") >= F.col("_t") - window)).select("row_id").distinct()
    return retries.join(near.withColumn("_s", F.lit(True)), "row_id", "left").withColumn("label", F.when(F.col("_s"), "symptom").otherwise("suspect")).drop("_s")


def connection_failures(rows: DataFrame, by: str, on: str, failed: str, width: int) -> DataFrame:
    """Failures per bucket where all tries of one blocked connection count once, at the first."""
    first = rows.filter(failed).groupBy(by).agg(F.min(on).alias("_first"))
    return first.groupBy(F.floor(F.col("_first") / width).alias("bucket")).agg(F.count(F.lit(1)).alias("failed_connections"))


def chart(rows: DataFrame, on: str, value: str, start: int, end: int, cells: int) -> DataFrame:
    """A series in at most ``cells`` buckets over [start, end), from all rows: count, least, largest and mean of each."""
    width = max(1, -(-(end - start) // cells))
    inside = rows.filter((F.col(on) >= start) & (F.col(on) < end))
    return inside.groupBy(F.floor((F.col(on) - start) / width).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("largest"), F.round(F.avg(value), 6).alias("mean"))


def headline(segment: dict) -> str:
    """One sentence on a segment: what is known, or why nothing is."""
    name = f"{segment['direction']} hop {segment['hop']}"
    if segment.get("reason"):
        return f"{name}: unknown ({segment['reason']})"
    lost = segment["recovered"] + segment["impactful"] + segment["unrecovered"]
    if not lost:
        return f"{name}: no loss among {segment['matched']} records"
    return f"{name}: {segment['loss_percent']:.2f} % lost ({lost}), {segment['impactful']} at a cost and {segment['unrecovered']} for good"


def severity(rows: DataFrame) -> DataFrame:
    """Findings from the gravest on: primary, then those that cost, then by size; ties by first time."""
    rank = F.when(F.col("kind") == "impactful", 0).when(F.col("kind") == "unrecovered", 1).when(F.col("kind") == "recovered", 2).otherwise(3)
    return rows.withColumn("severity", rank).orderBy("severity", F.desc_nulls_last("n"), "first_us")
