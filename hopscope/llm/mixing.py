"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pack, unit_hash, unpack

#: Documents of one source that a single task ranks.
CHUNK_ROWS = 20_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Per source: its size and its target.

    ``sizes`` has source and source_size, one row per source. Sources take the weights in turn, by
    code point, null last, and share ``share`` of all sizes by weight; a target stops at ``cap``
    times its source's size and the excess is shared among the others by weight. In order of
    cap / weight the stopped sources come first, so prefix sums find them without iteration.
    """
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    with_weight = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everyone) * F.lit(float(share))
    level = (total - before) / rest
    stopped = with_weight.withColumn("total", total).withColumn("stopped", F.col("limit") <= F.col("weight") * level)
    taken = F.coalesce(F.sum(F.when(F.col("stopped"), F.col("limit"))).over(everyone), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(everyone)
    target = F.when(F.col("stopped"), F.col("limit")).otherwise(F.col("weight") * ((F.col("total") - taken) / open_weight))
    return stopped.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    size: Column,
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """All columns of ``docs`` and the mix's: mix_size, source_size, target, copies.

    Every document of a source is expected target / source_size times. The expected copies are
    summed along an order of the source's documents, one random offset a source is added, and a
    document is emitted once for each integer that its span crosses. The order goes by chunks of a
    hash of doc_id and size, inside a chunk by size: no task ranks much over CHUNK_ROWS documents, however
    many a source has, and neighbours have like sizes, so the taken words come near the target.

    Null sources are one source, the last. Null sizes and texts count zero. Rows with equal doc_id
    are separate documents. An empty table gives an empty mix. The result is the same in every run.
    """
    chunks = max(1, -(-docs.count() // CHUNK_ROWS))
    names = [c for c in docs.columns if c not in ("mix_size", "source_size", "target", "copies")]
    held = pack(docs.withColumn("mix_size", F.coalesce(size, F.lit(0)).cast("long")), "doc_id", "source", "mix_size", leave=("mix_size", "source_size", "target", "copies"))
    rows = held.withColumn("h", unit_hash(F.col("doc_id"), F.col("mix_size"))).withColumn("chunk", F.pmod("h", F.lit(chunks)))
    part = Window.partitionBy("source", "chunk")
    ranked = (
        rows.withColumn("rank", F.row_number().over(part.orderBy("mix_size", "h", F.col("doc_id").asc_nulls_last())).cast("long"))
        .withColumn("rows", F.count(F.lit(1)).over(part))
        .withColumn("words", F.sum("mix_size").over(part))
    )
    # The last row of each chunk has the chunk's totals; the exchange of the ranking is reused.
    totals = ranked.filter(F.col("rank") == F.col("rows")).select("source", "chunk", "rows", "words")
    sizes = totals.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, share, cap)
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("ahead", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    t, o, r = targets.alias("t"), offsets.alias("o"), ranked.alias("r")
    plan = o.join(t, F.col("o.source").eqNullSafe(F.col("t.source"))).select("o.source", "o.chunk", "ahead", "source_size", "target")
    joined = r.join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.chunk") == F.col("p.chunk")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # A multiple of 2^-16, so that whole expected copies stay whole in floating point.
    start = F.floor(unit_hash(F.lit(seed), F.col("r.source")) / F.lit(65536)) / F.lit(65536.0)
    place = F.col("ahead") + F.col("rank")
    crossed = F.floor(start + each * place) - F.floor(start + each * (place - 1))
    copies = F.least(crossed, F.ceil(each)).cast("long")
    return unpack(joined, names, "mix_size", "source_size", "target", copies.alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row ``copies`` times."""
    return mixed.filter(F.col("copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
