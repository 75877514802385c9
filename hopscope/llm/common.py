"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words, as a regular expression class and its complement.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The filter that spares rows a shuffle has at most so many bits (4 MB), whatever the input.
FILTER_BITS = 1 << 25
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave all other letters alone."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """The first 32 bits of an MD5 as a long; the same in any engine."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 8), 16, 10).cast("long")


def pack(rows: DataFrame, *names: str, leave: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``names`` and, as the struct row, all columns but those in ``leave``: the caller's names clash with none of ours."""
    held = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c not in leave])
    return rows.select(*[F.col(f"`{n}`") for n in names], held.alias("row"))


def unpack(rows: DataFrame, columns: list[str], *more: Column) -> DataFrame:
    """The caller's ``columns`` out of the struct row, then ``more``."""
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], *more)


def hot_join(left: DataFrame, right: DataFrame, key: str | list[str], count: str, rows: int, how: str = "left") -> DataFrame:
    """Join ``right``, one row per key, where ``count`` is the number of left rows of the key.

    Keys that hold over a thousandth of the ``rows`` left rows are broadcast: there are under a
    thousand of them by construction. All others are joined by a shuffle without skew.
    """
    keys = [key] if isinstance(key, str) else key
    limit = max(1000, rows // 1000)
    heavy = F.broadcast(right.filter(F.col(count) > limit))
    light = right.filter(F.col(count) <= limit)
    hot = left.join(heavy, key, "inner")
    cold = left.join(F.broadcast(right.filter(F.col(count) > limit).select(*keys)), key, "left_anti").join(light, key, how)
    return hot.select(*cold.columns).unionByName(cold)


def give_back() -> None:
    """Return freed memory to the system: a Python worker waits idle between tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(docs: DataFrame, rows: int = 2000) -> DataFrame:
    """``docs``; from now on its session hands at most ``rows`` rows at once to Python, as texts can be long."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return docs


def by_bytes(batches: Iterator[pa.RecordBatch], column: str | int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes in ``column``, at least one row each: what is unpacked at once."""
    for batch in batches:
        first, size = 0, 0
        for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if size and size + (n or 0) > limit:
                yield batch.slice(first, k - first)
                first, size = k, 0
            size += n or 0
        yield batch.slice(first)


def bit_filter(keys: DataFrame, key: str, rows: int) -> tuple[int, np.ndarray]:
    """A bit for each of the ``rows`` hashes in ``keys``: rows without it can't match. Its size is bounded by FILTER_BITS."""
    bits = 1 << 16
    while bits < min(FILTER_BITS, 16 * rows):
        bits *= 2
    spot = F.pmod(F.col(key), F.lit(bits))
    words = keys.select(F.shiftright(spot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({key}, 64) AS INT))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    found = words.toArrow()  # 16 bytes a row at the driver; as Python's rows they would take hundreds
    table = np.zeros(bits // 64, np.int64)
    table[found["w"].to_numpy()] = found["b"].to_numpy()
    return bits, table


def with_bit(rows: DataFrame, key: str, bits: tuple[int, np.ndarray], want: bool = True) -> DataFrame:
    """The rows whose hash (not null) has, or lacks, its bit."""
    held, at = rows.sparkSession.sparkContext.broadcast(bits), rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, table = held.value
        for batch in batches:
            h = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            have = (table[(h & (size - 1)) >> 6] >> (h & 63)) & 1 == 1
            yield batch.filter(pa.array(have == want))

    return rows.mapInArrow(run, rows.schema)
