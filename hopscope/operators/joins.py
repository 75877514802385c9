"""Joins that SQL has no word for, as plans that partition by the equality keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(by: list[str], *order: Column) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def asof(left: DataFrame, right: DataFrame, by: list[str], on: str, take: list[str], forward: bool = False, prefix: str = "r_") -> DataFrame:
    """``left`` with ``take`` of the nearest ``right`` row of its keys at or before ``on`` (or after, ``forward``).

    Both sides go through one shuffle on ``by`` and one sort; nothing is paired. Rows without a
    neighbour keep nulls. Of right rows at one instant the last by ``take`` counts; null keys meet each other.
    """
    kept = F.struct(F.col(on).alias("_on"), *[F.col(c) for c in take])
    a = left.select(F.struct(*[F.col(c) for c in left.columns]).alias("_left"), *by, F.col(on).alias("_t"), F.lit(None).cast(right.select(kept.alias("x")).schema[0].dataType).alias("_r"))
    b = right.filter(F.col(on).isNotNull()).select(F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), *by, F.col(on).alias("_t"), kept.alias("_r"))
    instant = F.col("_t").desc_nulls_last() if forward else F.col("_t").asc_nulls_last()
    # At one instant the right rows stand first, so that equality matches.
    window = _order(by, instant, F.col("_left").isNotNull(), *[F.col(f"_r.{c}") for c in take]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = a.unionByName(b).withColumn("_near", F.last("_r", ignorenulls=True).over(window)).filter("_left IS NOT NULL")
    return near.select("_left.*", *[F.col(f"_near.{c}").alias(prefix + c) for c in take], F.col("_near._on").alias(f"{prefix}{on}"))


def nearest(left: DataFrame, right: DataFrame, by: list[str], on: str, right_id: str, window: int) -> DataFrame:
    """``left`` with right_id and right ``on`` of the nearest ``right`` row of its keys within ``window``; ties go to the earlier."""
    back = asof(left, right, by, on, [right_id], prefix="b_")
    both = asof(back, right, by, on, [right_id], forward=True, prefix="f_")
    gap_b, gap_f = F.col(on) - F.col(f"b_{on}"), F.col(f"f_{on}") - F.col(on)
    use_b = gap_b.isNotNull() & (gap_f.isNull() | (gap_b <= gap_f))
    gap = F.when(use_b, gap_b).otherwise(gap_f)
    chosen = both.withColumns({"gap": gap, f"near_{right_id}": F.when(use_b, F.col(f"b_{right_id}")).otherwise(F.col(f"f_{right_id}"))})
    fits = F.col("gap") <= window
    return chosen.select(*left.columns, F.when(fits, F.col(f"near_{right_id}")).alias(f"near_{right_id}"), F.when(fits, F.col("gap")).alias("gap"))


def one_to_one(pairs: DataFrame, left: str, right: str, *order: str) -> DataFrame:
    """Pairs that are the best by ``order`` of both their ends."""
    rank = [F.col(c) for c in order]
    ranked = pairs.withColumns({"_l": F.row_number().over(_order([left], *rank, F.col(right))), "_r": F.row_number().over(_order([right], *rank, F.col(left)))})
    return ranked.filter("_l = 1 AND _r = 1").drop("_l", "_r")


def balanced(left: DataFrame, right: DataFrame, key: list[str], on: str, row: str, window: int) -> DataFrame:
    """The order-preserving pairing of keys that have as many rows on both sides, all pairs within ``window``."""

    def numbered(side: DataFrame, name: str) -> DataFrame:
        part = Window.partitionBy(*key)
        return side.select(*key, F.col(on).alias(f"{name}_{on}"), F.col(row).alias(f"{name}_{row}"), F.row_number().over(part.orderBy(on, row)).alias("_n"), F.count(F.lit(1)).over(part).alias(f"_{name}"))

    pairs = numbered(left, "a").join(numbered(right, "b"), [*key, "_n"]).filter("_a = _b")
    within = F.abs(F.col(f"a_{on}") - F.col(f"b_{on}")) <= window
    return pairs.withColumn("_all", F.bool_and(within).over(Window.partitionBy(*key))).filter("_all").drop("_all", "_a", "_b", "_n")


def unique_owner(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose two ends have no other partner."""
    counted = pairs.withColumns({"_l": F.count(F.lit(1)).over(Window.partitionBy(left)), "_r": F.count(F.lit(1)).over(Window.partitionBy(right))})
    return counted.filter("_l = 1 AND _r = 1").drop("_l", "_r")


def interval_join(points: DataFrame, ranges: DataFrame, by: list[str], lo: str, hi: str, width: int, at_lo: str, at_hi: str) -> DataFrame:
    """Rows of ``points`` [at_lo, at_hi) with the ``ranges`` [lo, hi) of their keys that contain them.

    Ranges are listed in each bin of ``width`` that they touch and a point in the bin it starts in, so the
    join is on equality and a key with many rows is spread over its bins.
    """
    listed = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.greatest(F.col(hi), F.col(lo) + 1) - 1) / width))))
    placed = points.withColumn("_bin", F.floor(F.col(at_lo) / width))
    return placed.join(listed, [*by, "_bin"]).filter((F.col(at_lo) >= F.col(lo)) & (F.col(at_hi) <= F.col(hi))).drop("_bin")


def rolling_distinct(rows: DataFrame, by: str, on: str, target: str, width: int) -> DataFrame:
    """``rows`` with targets: the distinct targets of the key in the last ``width``, this row's included.

    A target counts at most once in a window that slides, so it is enough to know when each was
    seen last: the frame is one range window, and its set is bounded by the targets within ``width``.
    """
    frame = Window.partitionBy(by).orderBy(on).rangeBetween(-width, 0)
    return rows.withColumn("targets", F.size(F.collect_set(target).over(frame)).cast("long"))


def mutual_best(pairs: DataFrame, left: str, right: str, *order: str) -> DataFrame:
    """One-to-one pairs by rounds of mutual best; ends with two equally good partners stay unresolved.

    Each round keeps pairs that are the strictly best of both ends and drops all others of these ends, until a round finds none.
    """
    rank = F.struct(*[F.col(c) for c in order])
    open_, done = pairs.withColumn("_rank", rank).checkpoint(), []
    while True:

        def best(end: str, name: str, rows: DataFrame) -> DataFrame:
            part = Window.partitionBy(end)
            low = F.min("_rank").over(part)
            is_low = F.col("_rank") == F.col(f"_low{name}")
            return rows.withColumn(f"_low{name}", low).withColumn(name, is_low & (F.count_if(is_low).over(part) == 1))

        found = best(right, "_b", best(left, "_a", open_)).filter("_a AND _b").select(*pairs.columns).checkpoint()
        if found.isEmpty():
            break
        done.append(found)
        open_ = open_.join(found.select(left), left, "left_anti").join(found.select(right), right, "left_anti").checkpoint()
    out = pairs.limit(0)
    for part in done:
        out = out.unionByName(part)
    return out
