"""Benchmark decontamination by an FM-index over each shard of the training text.

A shard's text is its words that can be part of a test phrase, as numbers; whatever can't is one
separator. The index has a wavelet matrix of the Burrows-Wheeler transform, backward search runs for
all phrases at once, occurrences are located by sampled suffix positions, and the spans merge.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import new_path
from .common import LOWER, UPPER, by_bytes, give_back, small_batches

#: Bytes of words: digits, lower-case letters and all of 0x80 and above; A-Z are lowered, the rest separates.
_WORDS = bytes(
    ord(chr(b).lower()) if chr(b) in UPPER else b if chr(b) in LOWER or 48 <= b <= 57 or b >= 128 else 32 for b in range(256)
)
#: Bytes of text that one index covers; a longer document is a shard of its own.
SHARD_BYTES = 12 << 20
#: Words of test phrases that are sent to the executors as one block.
BLOCK_WORDS = 2_000_000
#: Every so many positions of the text one is kept in the suffix sample.
SAMPLE = 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector a level; each takes 1.5 bits a symbol and level."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        for shift in range(bits - 1, -1, -1):
            ones = (sequence >> shift) & 1 == 1
            packed = np.packbits(np.concatenate([ones, np.zeros(64 + -len(ones) % 64, bool)]), bitorder="little").view("<u8")
            counts = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32)
            zeros = len(ones) - int(counts[-1])
            self.levels.append((shift, packed, counts, zeros))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])

    def _ones(self, level: tuple, at: np.ndarray) -> np.ndarray:
        _, packed, counts, _ = level
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[word] + np.bitwise_count(packed[word] & mask).astype(np.int64)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start = np.zeros_like(at)
        for level in self.levels:
            shift, _, _, zeros = level
            one = (symbols >> shift) & 1 == 1
            low, high = self._ones(level, start), self._ones(level, at)
            start, at = np.where(one, zeros + low, start - low), np.where(one, zeros + high, at - high)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each position."""
        out = np.zeros_like(at)
        for level in self.levels:
            _, packed, _, zeros = level
            one = (packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            ones = self._ones(level, at)
            out, at = out * 2 + one, np.where(one, zeros + ones, at - ones)
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of symbols where each 0 is a symbol of its own, smaller than all others, by position.

    Prefix doubling over the suffixes that still tie; ties end at the next 0.
    """
    n = len(text)
    zeros = text == 0
    key = np.where(zeros, np.cumsum(zeros) - 1, text.astype(np.int64) + n)
    order = np.argsort(key, kind="stable")
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while True:
        alone = head & np.concatenate([head[1:], [True]])
        if alone.all():
            return order
        slots = np.flatnonzero(~alone)
        tied = order[slots]
        group, second = rank[tied], rank[np.minimum(tied + step, n)]
        by = np.lexsort((second, group))
        tied, group, second = tied[by], group[by], second[by]
        order[slots] = tied
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])])
        head[slots] = new
        rank[tied] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        step *= 2


class FMIndex:
    """Finds phrases in a text of symbols from 1 on, with 0 as separator at its end at least."""

    def __init__(self, text: np.ndarray, symbols: int):
        order = suffix_order(text)
        before = np.where(order > 0, text[order - 1], 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.matrix = WaveletMatrix(before, max(1, int(symbols).bit_length()))
        # Positions after a separator are all kept, so that no walk crosses one.
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.sample = order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the phrases, which are rows of symbols, filled up at the right."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.first[-1])
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > back) & (low < high))
            symbol = phrases[live, lengths[live] - 1 - back].astype(np.int64)
            low[live] = self.first[symbol] + self.matrix.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.matrix.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back in the text until a row is in the sample."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        while len(open_ := np.flatnonzero(out < 0)):
            at = rows[open_]
            have = self.kept[at + 1] > self.kept[at]
            out[open_[have]] = self.sample[self.kept[at[have]]] + steps[open_[have]]
            at, open_ = at[~have], open_[~have]
            symbol = self.matrix.access(at)
            rows[open_] = self.first[symbol] + self.matrix.rank(symbol, at)
            steps[open_] += 1
        return out


class Phrases:
    """Test phrases: windows of consecutive words of items, with what is needed to search them."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        owners: dict[tuple[bytes, ...], set[str | None]] = defaultdict(set)
        for item, words in items:
            for at in range(max(1, len(words) - window + 1)) if words else ():
                owners[tuple(words[at : at + window])].add(item)
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for p in owners for w in p}), 1)}
        self.owners = [list(x) for x in owners.values()]
        self.lengths = np.array([len(p) for p in owners], np.int64)
        self.symbols = np.zeros((len(owners), window), np.int32)
        for k, p in enumerate(owners):
            self.symbols[k, : len(p)] = [self.vocabulary[w] for w in p]
        width = len(self.vocabulary) + 1
        inside = np.arange(1, window) < self.lengths[:, None]
        self.pairs = np.unique((self.symbols[:, :-1].astype(np.int64) * width + self.symbols[:, 1:])[inside])
        self.width, self.shortest = width, int(self.lengths.min(initial=window))

    def occurrences(self, ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, word position) of all occurrences in the words ``ids`` (0: unknown) of documents ``doc``."""
        none = np.zeros(0, np.int64)
        if not len(ids) or not self.owners:
            return none, none
        # Words stay together where they are a pair of some phrase; too short runs hold no phrase.
        code = ids[:-1].astype(np.int64) * self.width + ids[1:]
        known = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0) & (doc[:-1] == doc[1:]))
        at = np.searchsorted(self.pairs, code[known])
        bound = np.ones(len(ids), bool)
        if len(self.pairs):
            bound[known[self.pairs[np.minimum(at, len(self.pairs) - 1)] == code[known]] + 1] = False
        heads = np.flatnonzero(bound)
        sizes = np.diff(np.append(heads, len(ids)))
        use = (sizes >= self.shortest) & (ids[heads] > 0)
        heads, sizes = heads[use], sizes[use]
        if not len(heads):
            return none, none
        places = np.cumsum(sizes + 1) - sizes - 1
        source = np.arange(int((sizes + 1).sum())) + np.repeat(heads - places, sizes + 1)
        text = ids[np.minimum(source, len(ids) - 1)].copy()
        text[places + sizes] = 0
        index = FMIndex(text, self.width - 1)
        low, high = index.search(self.symbols, self.lengths)
        found = np.repeat(np.arange(len(low)), high - low)
        rows = np.arange(len(found)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
        return found, source[index.locate(rows)]


def phrase_blocks(benchmark: DataFrame, window: int) -> list[str]:
    """Files in the shared folder with the test phrases of about BLOCK_WORDS words each; an item is in one block.

    Executors build them. Each attempt writes files of its own, and only those that finished attempts report are
    listed: a path for some ten megabytes of test text. Null and empty texts have no phrases. Items with null ids are one item.
    """
    spark = benchmark.sparkSession
    folder = new_path(spark, "phrases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        held, size, done = [], 0, []

        def close() -> None:
            nonlocal held, size
            name = f"{root}/{uuid.uuid4().hex}"
            with fs.open_output_stream(name) as out:
                out.write(pickle.dumps(Phrases(held, window)))
            done.append(name.rsplit("/", 1)[1])
            held, size = [], 0

        for batch in by_bytes(batches, 1):
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                if held and size + len(words) > BLOCK_WORDS:
                    close()
                if words:
                    held.append((item, words))
                    size += len(words)
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["name"])

    items = small_batches(benchmark).selectExpr("cast(item_id AS string) AS item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # Few partitions, so that small test sets are one block.
    written = items.coalesce(max(1, -(-size // (6 * BLOCK_WORDS)))).mapInArrow(run, "name string")
    return sorted(f"{folder}/{r.name}" for r in written.collect())


class Blocks:
    """The phrase blocks, of which a task holds one at a time."""

    def __init__(self, paths: list[str]):
        self.paths, self.last = paths, None

    def __iter__(self) -> Iterator[Phrases]:
        for path in self.paths:
            if self.last is None or self.last[0] != path:
                fs, where = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(where) as f:
                    self.last = (path, pickle.loads(f.read()))
            yield self.last[1]


def search_shard(texts: list[str | None], blocks: Iterable[Phrases]) -> list[tuple[int, np.ndarray, list[str | None]]]:
    """Per text: its number of words, a mask of its hit words, and the items that occur."""
    split = [words_of(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    total = int(sizes.sum())
    change, items = np.zeros(total + 1, np.int64), defaultdict(set)
    for phrases in blocks:
        get = phrases.vocabulary.get
        ids = np.fromiter((i for words in split for i in map(get, words, repeat(0))), np.int32, total)
        found, at = phrases.occurrences(ids, doc)
        np.add.at(change, at, 1)
        np.add.at(change, at + phrases.lengths[found], -1)
        for d, p in set(zip(doc[at].tolist(), found.tolist())):
            items[d].update(phrases.owners[p])
    hit = np.cumsum(change[:-1]) > 0
    return [(int(n), hit[s : s + n], sorted(items.get(d, ()), key=lambda i: (i or "", i is not None))) for d, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist()))]


def cut(text: str, hit: np.ndarray) -> str:
    """``text`` without the merged spans of hit words; a span goes from its first to its last word's last character."""
    raw = text.encode("utf-8", "surrogatepass")
    plain = np.frombuffer(raw.translate(_WORDS), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], plain, [False]])))
    begins, ends = edges[::2], edges[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    out, at = [], 0
    for first, last in zip(runs[::2], runs[1::2]):
        out.append(raw[at : begins[first]])
        at = int(ends[last - 1])
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def clean(text: str, blocks: Iterable[Phrases]) -> str:
    """``text`` without any occurrence; cutting can bring a new one together, so until none is left."""
    while (found := search_shard([text], blocks)[0])[1].any():
        text = cut(text, found[1])
    return text


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256) for every row of ``docs`` (doc_id, text).

    n_hit counts words inside occurrences of windows of ``window`` words of an item (items of fewer
    words are one window); n_items the items with occurring windows; items_sha256 their ids as strings,
    sorted and joined by commas. No row is shuffled. Null texts have no words; rows with equal ids are
    judged each; items with null ids are one item, whose id is an empty text; empty benchmarks hit nothing.
    """
    paths = phrase_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(paths)
        for shard in by_bytes(batches, 1, SHARD_BYTES):
            found = search_shard(shard.column(1).to_pylist(), blocks)
            columns = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([int(h.sum()) for _, h, _ in found], pa.int64())]
            columns += [pa.array([len(i) for _, _, i in found], pa.int64()), pa.array([hashlib.sha256(",".join(x or "" for x in i).encode()).hexdigest() for _, _, i in found])]
            yield pa.RecordBatch.from_arrays([shard.column(0), *columns], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` with the merged spans of all occurrences cut out of its text; other columns and rows stay."""
    paths = phrase_blocks(benchmark, window)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(paths)
        for shard in by_bytes(batches, at, SHARD_BYTES):
            texts = shard.column(at).to_pylist()
            found = search_shard(texts, blocks)
            new = [clean(t, blocks) if h.any() else t for t, (_, h, _) in zip(texts, found)]
            yield pa.RecordBatch.from_arrays([pa.array(new, shard.schema.field(at).type) if k == at else c for k, c in enumerate(shard.columns)], schema=shard.schema)
            del texts, found, new
            give_back()

    return docs.mapInArrow(run, docs.schema)
