"""Requests and responses, their ambiguity, and comparison across a hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import unique_owner


def transactions(requests: DataFrame, responses: DataFrame, by: list[str], on: str, row: str, deadline: int, covered_to: Column) -> DataFrame:
    """Each request with its outcome: answered by a response that could be no other's, ambiguous, unanswered or unknown.

    A request is unanswered only if the recording, up to ``covered_to`` of its row, goes on for the whole deadline after it.
    """
    q = requests.select(*by, F.col(row).alias("request"), F.col(on).alias("asked_us"), covered_to.alias("_cover"))
    r = responses.select(*by, F.col(row).alias("response"), F.col(on).alias("_t"))
    near = q.join(r, by).filter((F.col("_t") > F.col("asked_us")) & (F.col("_t") <= F.col("asked_us") + deadline)).withColumn("wait_us", F.col("_t") - F.col("asked_us"))
    owned = unique_owner(near, "request", "response").select("request", "response", "wait_us")
    some = near.select("request").distinct().withColumn("_some", F.lit(True))
    rows = q.join(owned, "request", "left").join(some, "request", "left")
    outcome = F.when(F.col("response").isNotNull(), "answered").when(F.col("_some"), "ambiguous").when(F.col("_cover") < F.col("asked_us") + deadline, "unknown").otherwise("unanswered")
    return rows.select("request", *by, "asked_us", "response", "wait_us", outcome.alias("outcome"))


def by_ordinal(requests: DataFrame, responses: DataFrame, by: list[str], on: str, row: str) -> DataFrame:
    """The n-th response of a connection answers its n-th request."""

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(*by).orderBy(on, row))
        return rows.select(*by, n.cast("long").alias("ordinal"), F.col(row).alias(name), F.col(on).alias(f"{name}_us"))

    pairs = numbered(requests, "request").join(numbered(responses, "response"), [*by, "ordinal"], "left")
    return pairs.withColumn("reason", F.when(F.col("response").isNull(), "no response").when(F.col("response_us") < F.col("request_us"), "out of order"))


def request_candidates(upstream: DataFrame, downstream: DataFrame, on: str, window: int) -> DataFrame:
    """Pairs of requests on both sides of a proxy that share an identity, a forwarded address or a server name.

    Each kind of evidence is an equality join of its own, so that none is a product; rank says the best evidence.
    ``upstream`` has id, identity, origin, sni and ``on``; ``downstream`` id, identity, xff (array), sni and ``on``.
    """
    a = upstream.select(F.col("id").alias("up"), F.col("identity").alias("ai"), F.col("origin").alias("ao"), F.col("sni").alias("asn"), F.col(on).alias("ta"))
    b = downstream.select(F.col("id").alias("down"), F.col("identity").alias("bi"), "xff", F.col("sni").alias("bsn"), F.col(on).alias("tb"))
    out = ["up", "down", "rank", "gap"]
    gap = F.col("tb") - F.col("ta")
    parts = [a.join(b, a["ai"] == b["bi"]).withColumn("rank", F.lit(0))]
    listed = b.withColumn("_o", F.explode("xff"))
    parts.append(a.join(listed, a["ao"] == listed["_o"]).withColumn("rank", F.lit(1)))
    parts.append(a.join(b, a["asn"] == b["bsn"]).withColumn("rank", F.lit(2)))
    rows = [p.withColumn("gap", gap).filter(F.col("gap").between(0, window)).select(*out) for p in parts]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.groupBy("up", "down").agg(F.min("rank").alias("rank"), F.min("gap").alias("gap"))


def dwell(up: Column, down: Column, uncertainty: Column) -> tuple[Column, Column]:
    """(time inside, why it is unknown): null without both ends or if negative beyond the clocks' uncertainty; noise counts as 0."""
    took = down - up
    reason = F.when(up.isNull() | down.isNull(), "one side is missing").when(took < -uncertainty, "negative beyond the clocks' uncertainty")
    return F.when(reason.isNull(), F.greatest(took, F.lit(0))), reason


def chain_comparison(near: DataFrame, far: DataFrame, by: list[str], chain: str) -> DataFrame:
    """Certificate chains on both sides of a hop: same, replaced, or unknown if a side is absent or ambiguous."""

    def one(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy(*by).agg(F.collect_set(chain).alias(name))

    both = one(near, "_a").join(one(far, "_b"), by, "full")
    state = F.when((F.coalesce(F.size("_a"), F.lit(0)) != 1) | (F.coalesce(F.size("_b"), F.lit(0)) != 1), "unknown").when(F.col("_a") == F.col("_b"), "same").otherwise("replaced")
    return both.select(*by, state.alias("state"))


def translation_candidates(before: DataFrame, after: DataFrame, invariant: list[str], pair: list[str], on: str, least: int = 3, spread: int = 1000) -> DataFrame:
    """Pairs of address keys that records with one invariant link ``least`` times with a steady delay."""
    a = before.select(*invariant, F.col(pair[0]).alias("a"), F.col(on).alias("ta"))
    b = after.select(*invariant, F.col(pair[1]).alias("b"), F.col(on).alias("tb"))
    gap = F.col("tb") - F.col("ta")
    found = a.join(b, invariant).groupBy("a", "b").agg(F.count(F.lit(1)).alias("samples"), (F.max(gap) - F.min(gap)).alias("spread_us"))
    return found.filter((F.col("samples") >= least) & (F.col("spread_us") <= spread))
