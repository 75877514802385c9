"""SimHash fingerprints, linked through an inverted index of byte positions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import materialise
from .common import LOWER, UPPER, bit_filter, by_bytes, give_back, hot_join, small_batches, with_bit
from .ppm import word_keys

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16
#: Posting lists up to this length give pairs; longer ones are split by further positions.
PAIR_LIST = 64
#: Positions of the first posting lists: each fingerprint is in 56, short by chance up to some hundred million fingerprints.
START = 3


def ascii_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of ``text`` in order, repeats included."""
    words = ascii_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(joined, 42)], np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[: len(ends) - shingle]]]
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :])), np.uint64, len(starts))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text``, 0 for texts without words.

    A-Z are lower-cased; words are runs of bytes other than white space; fewer words than ``shingle``
    are one shingle; repeated shingles count each. A bit is 1 if set in over half the XXH64 values.
    """
    hashes = _hashes(text, shingle)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each row of ``docs``, null texts 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])
        give_back()

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint"
    return small_batches(docs).select("doc_id", "text").mapInArrow(run, schema)


def _masked(fp: Column, positions: Column, masks: dict[int, int]) -> Column:
    """The bytes of ``fp`` at ``positions`` (a bit each), the others zero."""
    table = F.array(*[F.lit(masks[p]) for p in range(256)])
    return fp.bitwiseAND(F.element_at(table, positions.cast("int") + 1))


def links(fps: DataFrame, bits: int = 2, pair_list: int = PAIR_LIST) -> DataFrame:
    """(src, dst): edges whose components are those of all pairs of ``fps`` that differ in ``bits`` bits or fewer.

    ``fps`` has distinct fp. Differing in ``bits`` bits, two fingerprints share at least need = 8 - bits bytes
    at their positions. The inverted index has a posting list for each choice of positions and the bytes there:
    at first of START positions. Lists longer than ``pair_list`` are split by each further position. Short ones give pairs with their positions; per pair the positions are tallied over all
    lists, and pairs that reach ``need`` of them are verified. No pair is lost: of the positions that it shares,
    each is in some list that the pair is in, and a list is only split, never left out.

    Lists of ``need`` positions are split no more. Their members have only 8 * bits free bits (65,536 members
    for 2 bits), and those of long ones are linked through the points at half the distance: two share one exactly if
    they differ in ``bits`` bits or fewer, at most 17 (for 2 bits) share one, and all are linked to the smallest.
    """
    if bits not in (2, 4):
        raise ValueError("bits is 2 or 4")
    need = 8 - bits
    signed = lambda m: m - (m >> 63 << 64)
    masks = {p: signed(sum(255 << 8 * k for k in range(8) if p >> k & 1)) for p in range(256)}
    first = F.array(*[F.struct(F.lit(p).alias("positions"), F.col("fp").bitwiseAND(F.lit(masks[p])).alias("key")) for p in range(256) if p.bit_count() == START])
    lists = fps.select("fp", F.explode(first).alias("p")).select("fp", "p.positions", "p.key")
    met_pairs, stars = [], None
    for size in range(START, need + 1):
        sized = lists.groupBy("positions", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        met = lists.join(sized, ["positions", "key"]).checkpoint()
        short, long = met.filter(F.col("n") <= pair_list), met.filter(F.col("n") > pair_list)
        pairs = short.select("positions", "key", F.col("fp").alias("src")).join(short.select("positions", "key", F.col("fp").alias("dst")), ["positions", "key"])
        met_pairs.append(pairs.filter("src < dst").select("src", "dst", "positions"))
        if size == need:
            free = [F.when(F.col("positions").bitwiseAND(F.lit(1 << k // 8)) == 0, F.lit(signed(1 << k))) for k in range(64)]
            flips = F.array_compact(F.array(F.lit(0).cast("long"), *free))
            if bits == 4:
                flips = F.flatten(F.transform(flips, lambda x: F.transform(flips, lambda y: x.bitwiseXOR(y))))
            points = F.transform(F.array_distinct(flips), lambda f: F.col("fp").bitwiseXOR(f))
            meeting = long.select("fp", "positions", F.explode(points).alias("mid")).groupBy("positions", "mid").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
            stars = meeting.select(F.array_min("all").alias("src"), F.explode("all").alias("dst")).filter("src != dst")
        elif not long.isEmpty():
            # At most 70 choices of positions go on for a fingerprint, from at most 56.
            single = F.array(*[F.lit(1 << k) for k in range(8)])
            wider = F.transform("all", lambda p: F.transform(F.filter(single, lambda x: p.bitwiseAND(x) == 0), lambda x: p.bitwiseOR(x)))
            split = long.groupBy("fp").agg(F.collect_set("positions").alias("all")).select("fp", F.explode(F.array_distinct(F.flatten(wider))).alias("positions"))
            lists = split.select("fp", "positions", _masked(F.col("fp"), F.col("positions"), masks).alias("key"))
        else:
            break
    tallied = reduce(DataFrame.union, met_pairs).groupBy("src", "dst").agg(F.bit_or("positions").alias("shared")).filter(F.bit_count("shared") >= need)
    found = tallied.filter(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= bits).select("src", "dst")
    return (found.union(stars) if stars is not None else found).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``, which has doc_id and text.

    component_id is the smallest doc_id that links reach. Rows with equal fingerprints are one node,
    so copies are never expanded into pairs. Texts without words and null texts have fingerprint 0
    and are linked like any other. Null ids are kept but never the smallest. Empty tables give none.
    """
    held = fingerprints(docs, shingle).checkpoint()
    nodes = held.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).checkpoint()
    found = connected_components(links(nodes.select("fp"), bits)).withColumnRenamed("node", "fp")
    named = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    roots = named.join(least, "component").select("fp", "component_id", "copies").checkpoint()
    return hot_join(held, roots, "fp", "copies", held.count()).select("doc_id", "fp", "component_id")


#: Counters of shingles (4 MB) by which the prefix pass puts rare ones first, whatever the input.
COUNTERS = 1 << 20
#: Parts of the counters that are summed apart from each other.
COUNTER_BLOCKS = 64
#: Of the parts of a text's shingles at one level, those that are posted: which depends on hashes only.
PARTS = 24


def shingle_sets(texts: list[str | None], shingle: int) -> list[np.ndarray]:
    """Distinct 64-bit hashes of the word shingles of each text, in order; of fewer words than ``shingle`` all are one.

    Hashes of words are taken from sums over all texts at once and mixed to those of shingles.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER) for t in texts]
    words, counts = word_keys(raws, [(k, 0, len(r)) for k, r in enumerate(raws)])
    words, ends = words.view(np.uint64), np.cumsum(counts)
    h = np.full(max(0, len(words) - shingle + 1), 42, np.uint64)
    for j in range(shingle):
        h = _mixed(h, words[j : len(words) - shingle + 1 + j])
    out = []
    for first, end in zip((ends - counts).tolist(), ends.tolist()):
        if end - first >= shingle:
            out.append(np.unique(h[first : end - shingle + 1]))
        else:
            short = np.full(min(1, end - first), 41, np.uint64)
            for w in words[first:end]:
                short = _mixed(short, w[None])
            out.append(short)
    return out


def _mixed(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def part_fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number, fingerprint): SimHash fingerprints of parts of each set of shingle hashes: sets that share most share whole parts.

    At level e a shingle belongs to the part that e bits of its hash name. The levels are those with
    4 to 8 and with 2 to 4 shingles a part, so that two texts of like size have one at least in common. Parts
    are positions: a fingerprint is mixed with its level and part, so that only the same part of two texts meets.
    PARTS parts of each level are used, those of under two shingles only in texts of few; empty sets have fingerprint 0.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    hashes, owner = np.concatenate([np.zeros(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), sizes)
    mixed = (hashes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    base = np.maximum(0, np.floor(np.log2(np.maximum(sizes, 1) / 8)).astype(np.int64) + 1)
    numbers, out = [np.flatnonzero(sizes == 0)], [np.zeros(int((sizes == 0).sum()), np.int64)]
    for level in (base, base + 1):
        part = mixed & ((np.uint64(1) << level.astype(np.uint64)) - np.uint64(1))[owner]
        use = np.flatnonzero(part < PARTS)
        key = owner[use] * PARTS + part[use].astype(np.int64)
        order = np.argsort(key, kind="stable")
        use, key = use[order], key[order]
        if not len(use):
            continue
        heads = np.flatnonzero(np.diff(key, prepend=-1))
        bits = np.unpackbits(hashes[use].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        many, mine = np.diff(heads, append=len(use)), owner[use[heads]]
        fps = np.packbits(2 * counts > many[:, None], axis=1, bitorder="little").view("<u8").ravel()
        place = part[use[heads]] + (level[mine].astype(np.uint64) << np.uint64(32))
        keep = (many > 1) | (sizes[mine] < 4)
        numbers.append(mine[keep])
        out.append((fps ^ (place * np.uint64(0xD6E8FEB86659FD93)))[keep].view(np.int64))
    return np.concatenate(numbers), np.concatenate(out)


def fingerprint_pairs(texts: DataFrame, shingle: int = 5, bits: int = 2) -> DataFrame:
    """(a, b), a < b: pairs of ``texts`` (doc_id, text) whose components are those of all texts with fingerprints within ``bits`` bits.

    The fingerprints are of whole texts, linked through the inverted index (``links``); texts with one fingerprint are linked to the
    smallest of them.
    """
    held = materialise(fingerprints(texts, shingle).distinct(), "fingerprints")
    nodes = held.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).checkpoint()
    found = links(nodes.select("fp"), bits)
    ends = found.join(nodes.select(F.col("fp").alias("src"), F.col("first").alias("x")), "src").join(nodes.select(F.col("fp").alias("dst"), F.col("first").alias("y")), "dst")
    shared = nodes.filter("n > 1")
    same = hot_join(held, shared, "fp", "n", held.count(), "inner").filter("doc_id != first")
    return ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(same.select("first", "doc_id")).distinct()


def similar_texts(texts: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: int = 2) -> DataFrame:
    """(text_id, component) of the texts that a chain of similar ones joins to another; component is the smallest text_id reachable.

    ``texts`` has text_id and text, equal ids with equal texts. Two texts are linked if their sets of word shingles
    have a Jaccard similarity of ``similarity`` or more. Candidates come from SimHash fingerprints of whole texts first: those
    that the inverted index of their byte positions links at ``bits`` bits (``fingerprint_pairs``). Pairs just over 0.8 differ in
    more bits than byte positions guarantee, so a second index has parts of the shingles as positions (``part_fingerprints``),
    and texts that share one position's fingerprint meet. Those not joined yet are compared: all pairs of up to PAIR_LIST texts, and in
    longer meetings all that other links do not join (``_link_long``). Candidates are compared on whole sets. So each link is exact, and
    a pair at 0.8 is missed only if its fingerprints are over ``bits`` apart and it agrees in none of its parts, 24 or more in texts of
    over 100 words: under one in ten thousand. Texts without words are alike.
    """
    docs = small_batches(texts).select(F.col("text_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            number, fps = part_fingerprints(shingle_sets(batch.column(1).to_pylist(), shingle))
            order = np.argsort(number, kind="stable")
            starts = np.searchsorted(number[order], np.arange(len(batch) + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(fps[order]))], ["doc_id", "fps"])
        give_back()

    signed = docs.mapInArrow(parts, f"doc_id {kind}, fps array<bigint>").groupBy("doc_id").agg(F.first("fps").alias("fps"))
    shown = materialise(signed.select("doc_id", F.explode("fps").alias("at")), "parts")
    sized = shown.groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = materialise(hot_join(shown, sized.checkpoint(), "at", "n", shown.count(), "inner"), "meetings")
    near = fingerprint_pairs(docs, shingle, bits).checkpoint()
    ends = near.select(F.explode(F.array("a", "b")).alias("doc_id"))
    asked = met.select("doc_id").union(ends).distinct().withColumn("h", F.xxhash64("doc_id")).checkpoint()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            # 32 bits of each hash, sorted: one pair in thousands of millions agrees by chance.
            out = [np.unique(x >> np.uint64(32)).astype("<u4").tobytes() for x in shingle_sets(batch.column(1).to_pylist(), shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "shingles"])
        give_back()

    wanted = with_bit(docs.withColumn("h", F.xxhash64("doc_id")), "h", bit_filter(asked, "h", asked.count()))
    wanted = wanted.join(asked.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(sets, f"doc_id {kind}, shingles binary")
    wanted = materialise(wanted.dropDuplicates(["doc_id"]), "shingle-sets")
    sizes = wanted.select("doc_id", (F.length("shingles") / 4).cast("long").alias("size"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    def similar(pairs: DataFrame) -> DataFrame:
        """The (a, b) of ``pairs``, a < b and each once, whose whole sets are alike."""
        both = pairs.join(wanted.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").join(wanted.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
        return both.select("a", "b", "sa", "sb").mapInArrow(compare, f"a {kind}, b {kind}").checkpoint()

    edges = similar(near)
    joined = connected_components(edges, "a", "b").withColumnRenamed("node", "doc_id")
    few = met.filter(F.col("n") <= PAIR_LIST).join(sizes, "doc_id").join(joined, "doc_id", "left").select("at", "doc_id", "size", F.coalesce("component", "doc_id").alias("c"))
    pairs = few.withColumnsRenamed({"doc_id": "a", "size": "na", "c": "ca"}).join(few.withColumnsRenamed({"doc_id": "b", "size": "nb", "c": "cb"}), "at")
    pairs = pairs.filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _like_sizes("na", "nb", similarity)).select("a", "b")
    many = met.filter(F.col("n") > PAIR_LIST).checkpoint()
    if not many.isEmpty():
        ends = many.groupBy("at").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("n").alias("n"))
        pairs = pairs.union(_pivot_pairs(hot_join(many.select("at", "doc_id"), ends, "at", "n", many.count(), "inner"), F.array("low", "high")))
    edges = edges.union(similar(pairs.distinct())).distinct().checkpoint()
    if not many.isEmpty():
        edges = _link_long(many.select("at", "doc_id", "n").join(sizes, "doc_id").checkpoint(), edges, wanted, similar, similarity)
    return connected_components(edges, "a", "b").withColumnRenamed("node", "text_id")


def _like_sizes(a: str, b: str, similarity: float) -> Column:
    """Sets of other sizes can't reach the similarity."""
    return F.least(a, b) >= similarity * F.greatest(a, b) - 1e-6


def _pivot_pairs(members: DataFrame, pivots: Column) -> DataFrame:
    """(a, b): each member with each of its row's pivots."""
    pairs = members.select("doc_id", F.explode(pivots).alias("other")).filter("doc_id != other")
    return pairs.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b"))


def _link_long(members: DataFrame, linked: DataFrame, wanted: DataFrame, similar: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """(a, b): links that join what any two similar members of a meeting join. ``members`` has at, doc_id, n and size.

    Members already joined need no comparison. So each round compares, per meeting, the member with the most
    links so far (an original among its edited copies) and the one with the most outside the meeting's
    first component with all members that are not joined to them. When rounds no longer join a tenth of what is
    apart, all pairs that are still apart are compared whose sets can be alike: those that share one
    of their rarest shingles, at places that leave enough to share (``_prefix_pairs``, which loses no pair).
    """
    done, last = linked, None
    pivots = None
    while True:
        found = connected_components(done, "a", "b").withColumnRenamed("node", "doc_id")
        named = members.join(found, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")).checkpoint()
        groups = named.groupBy("at").agg(F.min("component").alias("least"), F.max("component").alias("_most")).filter("least != _most").drop("_most")
        apart = hot_join(named, groups.join(members.groupBy("at").agg(F.first("n").alias("_n")), "at"), "at", "_n", members.count(), "inner").drop("_n").checkpoint()
        left = apart.select("at", "component").distinct().count()
        if not left:
            return done
        if last is not None and left > 0.9 * last:
            break
        last = left
        ends = done.select(F.col("a").alias("doc_id")).union(done.select("b")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_links"))
        ranked = apart.join(ends, "doc_id", "left").withColumn("_key", F.struct(F.coalesce("_links", F.lit(0)).alias("l"), "doc_id", "component"))
        if pivots is not None:
            ranked = ranked.join(pivots, ["at", "doc_id"], "left_anti")
        best = ranked.groupBy("at").agg(F.array_compact(F.array_distinct(F.array(F.max("_key"), F.max(F.when(F.col("component") != F.col("least"), F.col("_key")))))).alias("_best"), F.first("n").alias("_n")).checkpoint()
        used = best.select("at", F.explode("_best.doc_id").alias("doc_id"))
        pivots = used if pivots is None else pivots.union(used)
        tried = hot_join(apart, best, "at", "_n", apart.count(), "inner").withColumn("_best", F.filter("_best", lambda x: x["component"] != F.col("component")))
        done = done.union(similar(_pivot_pairs(tried, F.col("_best.doc_id")).distinct())).distinct().checkpoint()
    return done.union(similar(_prefix_pairs(apart.select("doc_id", "component", "size").distinct(), wanted, similarity)))


def _shingle_counts(sets: DataFrame) -> np.ndarray:
    """How often the shingles of ``sets`` (one column of packed sets) fall in each of COUNTERS buckets, by their low bits.

    A task sums all its sets and gives its buckets packed, in COUNTER_BLOCKS rows at most; the rows of a block are summed in one
    task. The driver gets packed buckets as well, of those that hold more than one shingle; the others count as 1.
    """

    def packed(total: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(total >= least)
        ends = np.searchsorted(at, np.arange(1, COUNTER_BLOCKS + 1) * (COUNTERS // COUNTER_BLOCKS))
        for k, own in enumerate(np.split(at, ends[:-1])):
            if len(own):
                columns = [pa.array([k], pa.int32()), pa.array([own.astype("<u4").tobytes()]), pa.array([total[own].astype("<i8").tobytes()])]
                yield pa.RecordBatch.from_arrays(columns, ["block", "buckets", "ns"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in by_bytes(batches, 0):
            np.add.at(total, np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4") & np.uint32(COUNTERS - 1), 1)
        yield from packed(total, 1)
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for buckets, ns in zip(batch.column(1), batch.column(2)):
                total[np.frombuffer(buckets.as_py(), "<u4")] += np.frombuffer(ns.as_py(), "<i8")
        yield from packed(total, 2)
        give_back()

    schema = "block int, buckets binary, ns binary"
    found = sets.mapInArrow(count, schema).repartition("block").mapInArrow(add, schema).toArrow()
    out = np.ones(COUNTERS, np.int32)
    for buckets, ns in zip(found["buckets"], found["ns"]):
        out[np.frombuffer(buckets.as_py(), "<u4")] = np.minimum(np.frombuffer(ns.as_py(), "<i8"), (1 << 31) - 1)
    return out


def _prefix_pairs(members: DataFrame, wanted: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all pairs of ``members`` (doc_id, component, size), one row per doc_id, in two components that a prefix and positions can't tell apart.

    All sets are put in one order, rare shingles first: by a counter that a shingle may share with others, then by itself.
    Sets of which ``similarity`` of the larger is common share one at least of the first that exceed the rest
    of each; and no more is common than what follows the first common one in either. So no pair is lost, and
    texts with many shingles of their own meet none that can't be alike. Members of a component with one size and place
    of a shingle are one row until pairs are known. Sets without shingles share the shingle -1.
    """
    sets = wanted.join(members, "doc_id").select("doc_id", "component", "size", "shingles")
    kinds = [sets.schema[c].dataType.simpleString() for c in ("doc_id", "component")]
    counts = members.sparkSession.sparkContext.broadcast(_shingle_counts(sets.select("shingles")))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 3):
            owner, tokens, places = [], [], []
            for k, x in enumerate(batch.column(3)):
                x = np.frombuffer(x.as_py(), "<u4")
                n = counts.value[x & np.uint32(COUNTERS - 1)]
                first = np.lexsort((x, n))[: len(x) - int(np.ceil(similarity * len(x) - 1e-6)) + 1]
                at = np.flatnonzero(n[first] > 1)
                x, at = (x[first[at]].astype(np.int64), at) if len(x) else (np.array([-1]), np.array([0]))
                owner.append(np.full(len(x), k))
                tokens.append(x)
                places.append(at)
            picked = batch.select([0, 1, 2]).take(pa.array(np.concatenate([np.zeros(0, np.int64), *owner])))
            more = [pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64()) for c in (tokens, places)]
            yield pa.RecordBatch.from_arrays([*picked.columns, *more], ["doc_id", "component", "size", "token", "at"])
        give_back()

    rows = sets.mapInArrow(prefixes, f"doc_id {kinds[0]}, component {kinds[1]}, size long, token long, at long")
    rows = materialise(rows, "rare-shingles")
    named = lambda df, x: df.withColumnsRenamed({c: f"{c}_{x}" for c in df.columns if c != "token"})

    def fits(x: str, y: str) -> Column:
        both = F.least(F.col(f"size_{x}") - F.col(f"at_{x}"), F.col(f"size_{y}") - F.col(f"at_{y}"))
        needed = (F.col(f"size_{x}") + F.col(f"size_{y}")) * (similarity / (1 + similarity)) - 1e-6
        return _like_sizes(f"size_{x}", f"size_{y}", similarity) & (both >= needed)

    # Sizes and places of a shingle, few whatever the members: those that fit none of another component go first.
    places = rows.groupBy("token", "size", "at").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).checkpoint()
    p, q = named(places, "p"), named(places, "q").withColumnRenamed("token", "token_q")
    others = (F.col("lo_p") != F.col("hi_p")) | (F.col("lo_q") != F.col("hi_q")) | (F.col("lo_p") != F.col("lo_q"))
    able = p.join(q, (F.col("token") == F.col("token_q")) & fits("p", "q") & others, "left_semi")
    able = able.select("token", F.col("size_p").alias("size"), F.col("at_p").alias("at"))
    key = ["token", "component", "size", "at"]
    rows = rows.join(able, ["token", "size", "at"], "left_semi").checkpoint()
    groups = rows.select(*key).distinct().checkpoint()
    met = named(groups, "x").join(named(groups, "y"), "token").filter((F.col("component_x") < F.col("component_y")) & fits("x", "y"))
    for x in "xy":
        met = met.join(named(rows, x), ["token", *[f"{c}_{x}" for c in key[1:]]])
    pairs = met.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b"))
    return pairs.distinct()


def _classes(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``docs`` with the id of each row's text, and a row per text: its component, its best row and how many rows it has.

    The best row has the smallest doc_id, null after all others, and of rows with one id the least hash of the other columns.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text") and "map<" not in docs.schema[c].dataType.simpleString()]
    place = F.xxhash64(F.lit(0), *[F.col(f"`{c}`") for c in others])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5(F.coalesce("text", F.lit(""))).alias("text_id"), place.alias("place"))
    keys = rows.groupBy("text_id", "row.doc_id", "place").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "place", "n")).alias("best")
    texts = keys.groupBy("text_id").agg(best, F.sum("n").alias("copies")).checkpoint()
    found = similar_texts(rows.select("text_id", F.col("row.text").alias("text")), shingle, similarity)
    return rows, texts.join(found, "text_id", "left").withColumn("component", F.coalesce("component", "text_id")).checkpoint()


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs``: component_id is the smallest doc_id that similar texts reach.

    Rows with equal texts are one node, whatever their ids; rows with one id and different texts are separate. Null texts are
    empty; texts without words are alike; component_id is null if all ids of a class are. Empty tables give no rows.
    """
    rows, texts = _classes(docs, shingle, similarity)
    least = texts.groupBy("component").agg(F.min("best.doc_id").alias("component_id"))
    named = texts.join(least, "component").select("text_id", "component_id", "copies").checkpoint()
    return hot_join(rows.select("text_id", "row.doc_id"), named, "text_id", "copies", rows.count()).select("doc_id", "component_id")


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each class of similar texts, with all its columns.

    The row with the smallest doc_id stays, null after all others; of several such rows one. Rows are judged by their text:
    one id may stand for several texts, and copies with null ids go as well. Links are those of ``similar_texts``.
    """
    rows, texts = _classes(docs, shingle, similarity)
    first = texts.groupBy("component").agg(F.min(F.struct("best.void", "best.doc_id", "text_id")).alias("first")).select("first.text_id")
    alone = texts.join(first, "text_id", "left_semi").select(F.col("text_id").alias("id"), F.col("best.doc_id").alias("best_id"), F.col("best.place").alias("best_place"), F.col("best.n").alias("n"), "copies").checkpoint()
    gone = texts.select("text_id").join(first, "text_id", "left_anti").union(alone.filter("copies > 1").select("id")).withColumn("h", F.xxhash64("text_id")).checkpoint()
    bits = bit_filter(gone, "h", gone.count())
    hashed = rows.withColumn("h", F.xxhash64("text_id"))
    # Only rows that may go are shuffled; of those, equal rows are told apart by nothing and one is taken.
    maybe = with_bit(hashed, "h", bits)
    kept = hot_join(maybe.withColumn("id", F.col("text_id")), alone, "id", "copies", rows.count(), "inner")
    kept = kept.filter(F.col("row.doc_id").eqNullSafe(F.col("best_id")) & (F.col("place") == F.col("best_place")))
    once, more = kept.filter("n = 1").select("row"), kept.filter("n > 1").groupBy("text_id").agg(F.first("row").alias("row")).select("row")
    return with_bit(hashed, "h", bits, False).select("row.*").unionByName(once.select("row.*")).unionByName(more.select("row.*"))
