"""Removing byte strings that occur more than once, by external suffix sorting of shards.

Equal strings must meet in one shard. Each window of ``size`` bytes is anchored at the leftmost least
hash of the short strings inside it, which depends on nothing but the window's own bytes. Consecutive
windows with one anchor make a segment; each window is in exactly one. A window can only repeat if
its anchor's hash does, so segments of hashes that occur once are left out, equal segments are kept
once with their number, and the rest go to shards by hash. There the induced sorter finds every
window that starts elsewhere as well, in bounded memory whatever the shard's size. Segments of an anchor that holds
more than HOT_BYTES of different text are anchored anew by other hashes, so that they spread over shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise, new_path, remove
from .common import bit_filter, by_bytes, give_back, hot_join, small_batches, with_bit
from .induced_sort import repeated

#: Bytes of text whose windows are anchored at once; longer texts go in pieces.
PIECE = 1 << 20
#: Bytes of segments that a shard has on average, and of one anchor's that are anchored anew.
SHARD_BYTES, HOT_BYTES = 2 << 20, 16 << 20
#: How often hot segments are anchored anew, each time by shorter strings.
ROUNDS = 4
_BASE = 0x9E3779B97F4A7C15


def _hashes(data: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A mixed 64-bit hash of the ``width`` bytes (a power of two) from each position on."""
    h, power, step = data.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019 + seed), _BASE, 1
    while step < width:
        h = h[:-step] * np.uint64(power) + h[step:]
        power, step = power * power & (1 << 64) - 1, step * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of ``width`` keys from each position on."""
    step = 1
    while step * 2 <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    return np.minimum(keys[: len(keys) - (width - step)], keys[width - step :]) if width > step else keys


def segments(text: bytes, size: int, again: int = 0) -> Iterator[tuple[int, int, int]]:
    """(anchor hash, first window, number of windows) of consecutive windows with one anchor.

    ``again`` counts from 1 for other hashes, of strings half as long each time.
    """
    width = 1  # a long anchor string seldom repeats where its window doesn't
    while width * 6 <= size:
        width *= 2
    width = max(1, width >> again)
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(raw) - size + 1), PIECE):
        h = _hashes(raw[at : at + PIECE + size - 1], width, again * 0x2545F4914F6CDD1D & (1 << 60) - 1)
        keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        anchor = (_least(keys, size - width + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        heads = np.flatnonzero(np.diff(anchor, prepend=-1))
        counts = np.diff(heads, append=len(anchor))
        yield from zip(h[anchor[heads]].view(np.int64).tolist(), (heads + at).tolist(), counts.tolist())


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _segment_table(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, th, a, c, lo, n): segments with the hashes of text, anchor and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2):
            owner, rows = [], []
            for k, text in enumerate(batch.column(2)):
                raw = _raw(text.as_py())
                found = [(a, xxhash.xxh3_64_intdigest(raw[lo : lo + n + size - 1]) - (1 << 63), lo, n) for a, lo, n in segments(raw, size)]
                rows += found
                owner += [k] * len(found)
            picked = batch.select(["doc_id", "th"]).take(pa.array(owner, pa.int32()))
            columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, [pa.int64(), pa.int64(), pa.int64(), pa.int64()])]
            yield pa.RecordBatch.from_arrays([*picked.columns, *columns], ["doc_id", "th", "a", "c", "lo", "n"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th bigint, a bigint, c bigint, lo bigint, n bigint")


def _with_text(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``docs`` joined to ``found`` on doc_id and text hash, null ids included."""
    f = found.withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    return docs.join(f, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["th"] == F.col("_th")), how).drop("_id", "_th")


def _anchored_anew(bodies: DataFrame, size: int) -> DataFrame:
    """``bodies`` (shard, off, a, c, copies, body, hot) with hot ones in pieces: their windows, ROUNDS times by the anchors of other hashes.

    Each window is in one piece; off says where a piece begins. Equal windows get equal anchors, and so one shard. What is equal all
    around its anchors stays together, and the sorter bears that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "body"):
            out = []
            for key, off, a, c, n, body, hot in zip(*(x.to_pylist() for x in batch.columns)):
                pieces = [(key, off, body)]
                for again in range(1, ROUNDS + 1) if hot else ():
                    pieces = [((k * 31 + h) * 0x9E3779B97F4A7C15 & (1 << 63) - 1, o + lo, b[lo : lo + w + size - 1]) for k, o, b in pieces for h, lo, w in segments(b, size, again)]
                out += [(k, o, a, c, n, b) for k, o, b in pieces]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, batch.schema)], batch.schema.names[:6])

    return bodies.mapInArrow(run, "shard bigint, off bigint, a bigint, c bigint, copies bigint, body binary")


def repeated_spans(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the text hash th, and (doc_id, th, spans) of texts with repeated strings.

    spans has ends and begins in turn of byte ranges that strings of ``size`` bytes cover which also
    start elsewhere in the table; the ranges may overlap. Rows equal in doc_id and text are
    occurrences each, with the same spans.
    """
    spark = docs.sparkSession
    docs = small_batches(docs).withColumn("th", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    table = materialise(_segment_table(docs, size), "segments")
    anchors = table.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a").checkpoint()
    near = with_bit(table, "a", bit_filter(anchors, "a", anchors.count()))
    found = materialise(near.join(anchors, "a", "left_semi"), "repeated-segments")
    # Equal segments are one with a number; any one of them gives the text.
    place = F.struct("doc_id", "th", "lo", "n").alias("place")
    kinds = found.groupBy("a", "c").agg(F.count(F.lit(1)).alias("copies"), F.first(place).alias("place")).checkpoint()
    wanted = kinds.groupBy("place.doc_id", "place.th").agg(F.collect_list(F.struct("a", "c", "copies", "place.lo", "place.n")).alias("parts"))
    sums = kinds.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum(F.col("place.n") + size), F.lit(0)).alias("b")).first()
    asked = with_bit(docs.select("doc_id", "th", "text"), "th", bit_filter(kinds.select("place.th"), "th", sums["k"]))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 0):
            out = []
            for text, parts in zip(batch.column(0), batch.column(1)):
                raw = _raw(text.as_py())
                out += [(p["a"], p["c"], p["copies"], raw[p["lo"] : p["lo"] + p["n"] + size - 1]) for p in parts.as_py()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, [pa.int64(), pa.int64(), pa.int64(), pa.binary()])], ["a", "c", "copies", "body"])

    bodies = _with_text(asked, wanted, "inner").select("text", "parts").mapInArrow(texts, "a bigint, c bigint, copies bigint, body binary")
    bodies = bodies.select(F.col("a").alias("shard"), F.lit(0).cast("long").alias("off"), "a", "c", "copies", "body")
    hot = kinds.groupBy("a").agg(F.sum(F.col("place.n") + size - 1).alias("b")).filter(F.col("b") > HOT_BYTES).select("a", F.lit(True).alias("hot")).checkpoint()
    if not hot.isEmpty():
        bodies = _anchored_anew(bodies.join(hot, "a", "left").select(*bodies.columns, "hot"), size)
    folder = new_path(spark, "queues")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Text goes through the sorter; of each segment its key and length are held.
        seen, held = set(), []

        def texts_in() -> Iterator[bytes]:
            for batch in batches:
                for off, a, c, n, body in zip(*(x.to_pylist() for x in batch.columns[1:])):
                    if (off, a, c) not in seen:
                        seen.add((off, a, c))
                        held.append((off, a, c, n, len(body)))
                        yield body

        def told(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 4, [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())])], ["a", "c", "copies", "spans"])

        out = []
        for k, at in repeated(texts_in(), size, folder):
            off, a, c, n, _ = held[k]
            if n > 1:
                continue
            far = np.flatnonzero(np.diff(at) > size) + 1
            spans = np.stack([at[np.append(0, far)], at[np.append(far - 1, len(at) - 1)] + size], 1).ravel() + off
            out.append((a, c, n, spans.tolist()))
            if len(out) >= 10_000:
                yield told(out)
                out = []
        # Segments that occur several times are repeated as a whole.
        for off, a, c, n, length in held:
            if n > 1:
                out.append((a, c, n, [off, off + length]))
            if len(out) >= 10_000:
                yield told(out)
                out = []
        yield told(out)
        give_back()

    shards = max(1, -(-int(sums["b"]) // SHARD_BYTES))
    spans = materialise(bodies.repartition(shards, "shard").mapInArrow(shard, "a bigint, c bigint, copies bigint, spans array<bigint>"), "segment-spans")
    remove(spark, folder)
    # A segment has at most 2 * size bytes, so its spans are few.
    marked = hot_join(found, spans, ["a", "c"], "copies", found.count(), "inner")
    moved = marked.select("doc_id", "th", F.transform("spans", lambda x: x + F.col("lo")).alias("spans"))
    return docs, moved.groupBy("doc_id", "th").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _kept(raw: bytes, spans: list[int] | None) -> tuple[bytes, int]:
    """What is left of ``raw`` and the number of maximal removed runs."""
    if not spans:
        return raw, 0
    pairs = sorted(zip(spans[::2], spans[1::2]))
    out, at, runs, end = [], 0, 0, -1
    for lo, hi in pairs:
        if lo > end:
            runs += 1
            out.append(raw[at:lo])
        end = at = max(end, hi)
    return b"".join([*out, raw[at:]]), runs


def _apply(docs: DataFrame, size: int, make: Callable[[pa.RecordBatch, list], list[pa.Array]], keep: list[str], extra: str) -> DataFrame:
    """Rows of ``docs`` with columns that ``make`` gets from the batch and its spans, in the place of text and th."""
    docs, spans = repeated_spans(docs, size)
    spans = materialise(spans, "document-spans")
    bits = bit_filter(spans, "th", spans.count())
    names = [*keep, "text"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            made = make(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.select(keep).columns, *[a for _, a in made]], [*keep, *[n for n, _ in made]])
        give_back()

    # Only texts that may have spans are shuffled.
    hit = _with_text(with_bit(docs, "th", bits), spans, "left").select(*names, "spans")
    rest = with_bit(docs, "th", bits, False).select(*names, F.lit(None).cast("array<bigint>").alias("spans"))
    return hit.mapInArrow(run, schema).unionByName(rest.mapInArrow(run, schema))


def repeat_digest(docs: DataFrame, size: int = 400) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs`` (doc_id, text).

    A byte is removed if a string of ``size`` bytes that covers it also starts anywhere else in the
    table, same text included; strings never cross texts. Null texts are empty; texts shorter than
    ``size`` lose nothing; rows with equal ids are judged each.
    """

    def make(texts: list, spans: list) -> list:
        rows = []
        for text, s in zip(texts, spans):
            raw = _raw(text)
            left, runs = _kept(raw, s)
            rows.append((len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest()))
        columns = list(zip(*rows)) if rows else [[]] * 4
        return [(n, pa.array(c, t)) for n, c, t in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]

    return _apply(docs.select("doc_id", "text"), size, make, ["doc_id"], "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, size: int = 400) -> DataFrame:
    """``docs`` with repeated strings cut out of text; characters cut in half go too. Other columns and all rows stay.

    ``docs`` may have a column named th or spans: they are set aside meanwhile.
    """
    others = [c for c in docs.columns if c != "text"]
    plain = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("others"))

    def make(texts: list, spans: list) -> list:
        new = [t if not s else _kept(_raw(t), s)[0].decode("utf-8", "ignore") for t, s in zip(texts, spans)]
        return [("text", pa.array(new, pa.string()))]

    cut = _apply(plain, size, make, ["doc_id", "others"], "text string")
    return cut.select(*[F.col("text") if c == "text" else F.col(f"others.`{c}`").alias(c) for c in docs.columns])
