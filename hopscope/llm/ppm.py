"""Prediction by partial matching over bytes, adaptive per document or trained on a corpus.

A context is the last k bytes, k up to ``order``. A symbol counted n times after a context with N counts of
q different symbols has probability (n - d) / N there; the escape to the next shorter context has d q / N,
d being DISCOUNT. The longest contexts count every time; a shorter one counts a symbol once for each longer
context that has met it (update exclusion). Symbols that a longer context knows are excluded from the
counts of shorter ones; below the empty context the rest of the alphabet is equally likely. A text is
its UTF-8 bytes with A-Z lower-cased and one end symbol. 0xFF is the end and 0xFE fills the context
before the text; neither byte occurs in UTF-8.

The trained trie is a table of contexts and symbols, never a broadcast: blocks of texts, each a file in
the shared folder, ask for the nodes that they need, the table answers, and each block is scored by the answers.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.ipc  # noqa: F401  (as pa.ipc)
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import materialise, new_path, release, remove
from .common import LOWER, UPPER, by_bytes, give_back, small_batches

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
PAD, END = 0xFE, 0xFF
#: All symbols but the filler.
ALPHABET = 255
#: What each symbol's count gives to the escape; one half is the estimate known as D.
DISCOUNT = 0.3
#: Bytes of text in a block, on average, and of text whose contexts are built at once.
BLOCK_BYTES, PIECE = 64 << 20, 1 << 20
#: Rows of one context that a task sorts; contexts with more are summed by parts.
HOT_ROWS = 1 << 22


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").translate(_LOWER)


class Trie:
    """Counts of the symbols after each context, and the probabilities they give."""

    def __init__(self, order: int):
        self.order, self.nodes = order, defaultdict(dict)

    def add(self, context: bytes, symbol: int) -> None:
        for k in range(self.order, -1, -1):
            node = self.nodes[context[len(context) - k :]]
            node[symbol] = node.get(symbol, 0) + 1
            if node[symbol] > 1:
                return

    def log10(self, context: bytes, symbol: int) -> float:
        total, out = 0.0, set()
        for k in range(self.order, -1, -1):
            node = self.nodes.get(context[len(context) - k :], {})
            n = sum(c for s, c in node.items() if s not in out)
            if symbol in node:
                return total + math.log10((node[symbol] - DISCOUNT) / n)
            if n:
                total += math.log10(DISCOUNT * sum(s not in out for s in node) / n)
            out |= node.keys()
        return total - math.log10(ALPHABET - len(out))

    def score(self, text: str | None, learn: bool) -> float:
        context, total = bytes([PAD]) * self.order, 0.0
        for symbol in _raw(text) + bytes([END]):
            total += self.log10(context, symbol)
            if learn:
                self.add(context, symbol)
            context = (context + bytes([symbol]))[1:]
        return total

    def learn(self, text: str | None) -> None:
        context = bytes([PAD]) * self.order
        for symbol in _raw(text) + bytes([END]):
            self.add(context, symbol)
            context = (context + bytes([symbol]))[1:]


def score_adaptive(docs: DataFrame, order: int = 5) -> DataFrame:
    """``docs`` with score: each text's log10 probability by a model that learns from that text only, as it goes.

    Null texts are empty. A column named score is replaced.
    """
    docs = docs.drop("score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, at):
            scores = [Trie(order).score(t.as_py(), True) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


Span = tuple[int, int, int]  # text, first byte, end


def _spans(raws: list[bytes], words: bool = False) -> Iterator[list[Span]]:
    """Spans of texts, in lists of about PIECE bytes; a longer text is cut, for ``words`` at white space."""
    held, size = [], 0
    for k, raw in enumerate(raws):
        at = 0
        while True:
            end = min(len(raw), at + PIECE)
            if words and end < len(raw):
                gap = _SPACE.search(raw, end)
                end = gap.start() if gap else len(raw)
            held.append((k, at, end))
            size += end - at
            at = end
            if size >= PIECE:
                yield held
                held, size = [], 0
            if end == len(raw):
                break
    if held:
        yield held


def _context_keys(raws: list[bytes], spans: list[Span], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of each place as one number, and how many places each span has: its bytes, and the end."""
    parts, sizes = [], []
    for k, at, end in spans:
        last = end == len(raws[k])
        parts += [(bytes([PAD]) * order + raws[k][max(0, at - order) : at])[-order:], raws[k][at:end], bytes([END]) if last else b""]
        sizes.append(end - at + last)
    data = np.frombuffer(b"".join(parts), np.uint8)
    keys = np.zeros(max(0, len(data) - order), np.int64)
    for j in range(order + 1):
        keys <<= 8
        keys |= data[j : len(data) - order + j]
    sizes = np.array(sizes, np.int64)
    lead = np.repeat(np.tile([False, True], len(sizes)), np.stack([np.full(len(sizes), order), sizes], 1).ravel())
    return keys[lead[order:]], sizes


_POWERS: list[np.ndarray] = []
_BASE = 0x9E3779B97F4A7C17


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, PIECE) - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


#: A random 64-bit number for each byte.
_DIGITS = np.random.default_rng(42).integers(1, 1 << 64, 256, np.uint64)
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_keys(raws: list[bytes], spans: list[Span]) -> tuple[np.ndarray, np.ndarray]:
    """A negative key for each word (keys of contexts are not negative), and how many words each span has.

    The key is a hash of the word's bytes as digits, from sums over the piece.
    """
    data = np.frombuffer(b" ".join([b"", *[raws[k][at:end] for k, at, end in spans], b""]), np.uint8)
    space = _IS_SPACE[data]
    first, last = np.flatnonzero(space[:-1] & ~space[1:]) + 1, np.flatnonzero(~space[:-1] & space[1:])
    up, down = _powers(len(data))
    sums = np.cumsum(_DIGITS[data] * up)
    h = (sums[last] - sums[first - 1]) * down[first]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(29)
    edges = np.cumsum([1] + [end - at + 1 for _, at, end in spans])
    counts = np.diff(np.searchsorted(first, edges))
    return (h | np.uint64(1 << 63)).view(np.int64), counts


def _merged(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their numbers."""
    parts = list(parts)
    keys = np.concatenate([np.zeros(0, np.int64), *[k for k, _ in parts]])
    counts = np.concatenate([np.zeros(0, np.int64), *[n for _, n in parts]])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def requests(raws: list[bytes], train: list[bool], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys that the texts need, with how often the training ones among the texts have them."""
    parts, learn = [], np.array(train, bool)

    def add(keys: np.ndarray, sizes: np.ndarray, spans: list[Span]) -> None:
        use = np.repeat(learn[[k for k, _, _ in spans]], sizes)
        for mask, weight in ((use, 1), (~use, 0)):
            k, n = np.unique(keys[mask], return_counts=True)
            parts.append((k, n * weight))
        if len(parts) > 8:
            parts[:] = [_merged(parts)]

    for spans in _spans(raws, words=True):
        add(*word_keys(raws, spans), spans)
    for spans in _spans(raws):
        add(*_context_keys(raws, spans, order), spans)
    return _merged(parts)


def _sums(values: np.ndarray, sizes: np.ndarray, spans: list[Span], texts: int) -> np.ndarray:
    """The sum of each text's values, spans of a text together."""
    total = np.concatenate([[0.0], np.cumsum(values)])
    ends = np.cumsum(sizes)
    return np.bincount([k for k, _, _ in spans], total[ends] - total[ends - sizes], texts)


class Answers:
    """A hash table of values by key, for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]
            won = self.keys[slot] == keys[left]
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all in the table."""
        slot = self._slots(keys)
        wrong = np.flatnonzero(self.keys[slot] != keys)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            wrong = wrong[self.keys[slot[wrong]] != keys[wrong]]
        return self.values[slot]


def _write_blocks(rows: DataFrame, folder: str, order: int) -> DataFrame:
    """(block, key, n): what each block of ``rows`` (doc_id, text, train) asks for; its texts are a file in ``folder``.

    A block is up to about BLOCK_BYTES of a partition's texts. Its number has that of the task's attempt, so an
    attempt that is lost or repeated leaves files that no row of the table names; and it is small, as it goes with each key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = count(TaskContext.get().taskAttemptId() << 12)
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)

        def told(block: int, parts: list) -> Iterator[pa.RecordBatch]:
            keys, counts = _merged(parts)
            for at in range(0, len(keys), 1 << 18):
                k, n = keys[at : at + (1 << 18)], counts[at : at + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), block)), pa.array(k), pa.array(n, pa.int32())], ["block", "key", "n"])

        out = writer = block = None
        size, parts = 0, []
        for batch in by_bytes(batches, 1, 2 * PIECE):
            if not len(batch):
                continue
            if writer is None:
                block, size, parts = next(numbers), 0, []
                out = fs.open_output_stream(f"{root}/{block}")
                writer = pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            writer.write_batch(batch)
            size += batch.column(1).nbytes
            parts.append(requests([_raw(t.as_py()) for t in batch.column(1)], batch.column(2).to_pylist(), order))
            parts = [_merged(parts)] if len(parts) > 3 else parts
            if size >= BLOCK_BYTES:
                writer.close()
                out.close()
                yield from told(block, parts)
                writer = None
        if writer is not None:
            writer.close()
            out.close()
            yield from told(block, parts)
        parts.clear()
        give_back()

    return rows.mapInArrow(run, "block bigint, key bigint, n int")


def _lower_orders(known: DataFrame, open_: DataFrame, order: int) -> DataFrame:
    """(key, v): log10 probability of keys that no training text has, through ever shorter contexts.

    ``known`` has key and n of the longest contexts; ``open_`` key, N and q of its context, 0 if that is new.
    A shorter context counts the longer ones that know the symbol, so what a context knows, its suffixes know:
    the excluded symbols are those of the next longer known context. Each step keeps what is open.
    """
    open_ = open_.select("key", F.when(F.col("q") > 0, F.log10(DISCOUNT * F.col("q") / F.col("N"))).otherwise(F.lit(0.0)).alias("v"), F.when(F.col("q") > 0, F.shiftright("key", 8)).alias("above"))
    open_, done = open_.withColumn("symbols", F.lit(0).cast("long")).checkpoint(), []
    for k in range(order - 1, -1, -1):
        low_mask, context_mask = F.lit((1 << 8 * (k + 1)) - 1), F.lit((1 << 8 * k) - 1)
        low = known.groupBy(F.col("key").bitwiseAND(low_mask).alias("key")).agg(F.count(F.lit(1)).alias("n")).checkpoint()
        node = low.groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("q"))
        contexts = open_.filter("above IS NOT NULL").select("above").distinct()
        shut = known.select(F.shiftright("key", 8).alias("above"), F.col("key").bitwiseAND(low_mask).alias("low")).join(contexts, "above", "left_semi")
        shut = shut.join(low.select(F.col("key").alias("low"), "n"), "low").groupBy("above").agg(F.sum("n").alias("shut_n"), F.count(F.lit(1)).alias("shut_q"))
        rows = open_.withColumns({"low": F.col("key").bitwiseAND(low_mask), "context": F.shiftright("key", 8).bitwiseAND(context_mask)})
        rows = rows.join(node, "context", "left").join(shut, "above", "left").join(low.select(F.col("key").alias("low"), F.col("n").alias("low_n")), "low", "left")
        left_n, left_q = F.col("N") - F.coalesce("shut_n", F.lit(0)), F.col("q") - F.coalesce("shut_q", F.lit(0))
        step = F.when(F.col("low_n").isNotNull(), F.log10((F.col("low_n") - DISCOUNT) / left_n)).when(left_n > 0, F.log10(DISCOUNT * left_q / left_n)).otherwise(F.lit(0.0))
        above = F.when(F.col("N").isNotNull(), F.col("context")).otherwise(F.col("above"))
        rows = rows.select("key", (F.col("v") + step).alias("v"), above.alias("above"), F.col("low_n").isNotNull().alias("found"), F.col("q").alias("symbols")).checkpoint()
        done.append(rows.filter("found").select("key", "v"))
        open_, known = rows.filter("NOT found"), low
    # Of the last table's contexts only the empty one is left; without any training it has no symbols.
    done.append(open_.select("key", (F.col("v") - F.log10(F.lit(ALPHABET) - F.coalesce("symbols", F.lit(0)))).alias("v")))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _sums_by_context(asked: DataFrame) -> DataFrame:
    """``asked`` (block, key, n) with first (one row of each key that training texts have), c (the key's count), N and q of its context.

    The rows of a context meet in one task, which sums them up, unless there can be more than HOT_ROWS of them: a block has
    256 at most. Such contexts are summed by key and context with partial sums, and go back to their rows by a join.
    """
    context = F.when(F.col("key") >= 0, F.shiftright("key", 8)).otherwise(F.col("key"))
    rows, columns = asked.withColumn("context", context), ("block", "key", "n", "c", "first", "N", "q")

    def windowed(part: DataFrame) -> DataFrame:
        same_key, same_context = Window.partitionBy("context", "key"), Window.partitionBy("context")
        summed = part.withColumn("c", F.sum("n").over(same_key))
        summed = summed.withColumn("first", (F.row_number().over(same_key.orderBy("block")) == 1) & (F.col("c") > 0))
        return summed.withColumns({"N": F.sum("n").over(same_context), "q": F.count_if("first").over(same_context)}).select(*columns)

    if 256 * asked.select("block").distinct().count() <= HOT_ROWS:
        return windowed(rows)
    hot = rows.groupBy("context").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > HOT_ROWS).select("context").checkpoint()
    inside = rows.join(hot, "context", "left_semi")
    keys = inside.groupBy("context", "key").agg(F.sum("n").alias("c"), F.min("block").alias("least")).checkpoint()
    whole = keys.groupBy("context").agg(F.sum("c").alias("N"), F.count_if(F.col("c") > 0).alias("q"))
    told = inside.drop("context").join(keys.join(whole, "context").drop("context"), "key")
    told = told.withColumn("first", (F.col("block") == F.col("least")) & (F.col("c") > 0)).select(*columns)
    return windowed(rows.join(hot, "context", "left_anti")).unionByName(told)


def score_corpus(docs: DataFrame, train: Column, order: int = 5) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs`` (doc_id, text).

    score is the text's log10 probability by the model of the rows where ``train`` holds. Beside it,
    base_score is that of the words and one end by the words' smoothed counts there. Words are told
    apart by 63-bit hashes. Null texts are empty, a null ``train`` is false, rows with equal ids are
    scored each, and an empty table gives none.

    A block sends each key that it needs once, with its training count. The keys of a context are
    summed up (``_sums_by_context``) to what the answers need; those that no
    training text has go on to shorter contexts. Both ways the rows are in proportion to the text, and
    the texts themselves stay in their blocks' files.
    """
    if not 1 <= order <= 6:
        raise ValueError("order is 1 to 6")
    spark = docs.sparkSession
    rows = small_batches(docs).select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    folder = new_path(spark, "blocks")
    # Small partitions are put together, or each would ask for the frequent keys anew.
    path = new_path(spark, "asked")
    _write_blocks(rows.coalesce(max(1, -(-size // BLOCK_BYTES))), folder, order).write.option("compression", "zstd").parquet(path)
    asked = spark.read.schema("block bigint, key bigint, n int").parquet(path)
    summed = _sums_by_context(asked)
    value = F.when(F.col("key") < 0, F.col("c").cast("double")).when(F.col("c") > 0, F.log10((F.col("c") - DISCOUNT) / F.col("N")))
    answers = materialise(summed.select("key", "block", "first", F.when(F.col("first"), F.col("c")).alias("c"), value.alias("v"), F.when(value.isNull(), F.col("N")).alias("N"), F.when(value.isNull(), F.col("q")).alias("q")), "answers", "zstd")
    remove(spark, path)
    release(spark)
    words = answers.filter("first AND key < 0").agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    ends = rows.filter("train").count()
    total, distinct = words["n"] + ends, words["v"] + (ends > 0)
    divisor = total + 0.1 * (distinct + 1)
    known = answers.filter("first AND key >= 0").select("key", F.col("c").alias("n"))
    open_ = answers.filter("v IS NULL").groupBy("key").agg(F.first("N").alias("N"), F.first("q").alias("q"))
    late = _lower_orders(known, open_, order)
    late = answers.filter("v IS NULL").select("key", "block").join(late, "key").select("block", "key", "v")
    told = answers.filter("v IS NOT NULL").select("block", "key", "v").unionByName(late)

    def answer(right: pa.Table) -> pa.Table:
        fs, root = pafs.FileSystem.from_uri(folder)
        name = f"{root}/{right['block'][0].as_py()}"
        keys, values = right["key"].to_numpy(), right["v"].to_numpy()
        is_word = keys < 0
        words, contexts = Answers(keys[is_word], values[is_word]), Answers(keys[~is_word], values[~is_word])
        del keys, values, is_word
        parts, ids = [], []
        with fs.open_input_file(name) as f:
            for batch in pa.ipc.open_stream(f):
                raws = [_raw(t.as_py()) for t in batch.column(1)]
                n = len(raws)
                base, score, n_tokens, n_known = np.full(n, math.log10((ends + 0.1) / divisor)), np.zeros(n), np.ones(n), np.full(n, float(ends > 0))
                for spans in _spans(raws, words=True):
                    found, sizes = word_keys(raws, spans)
                    counts = words.get(found)
                    base += _sums(np.log10((counts + 0.1) / divisor), sizes, spans, n)
                    n_known += _sums(counts > 0, sizes, spans, n)
                    n_tokens += _sums(np.ones(len(counts)), sizes, spans, n)
                for spans in _spans(raws):
                    found, sizes = _context_keys(raws, spans, order)
                    score += _sums(contexts.get(found), sizes, spans, n)
                parts.append((n_tokens.astype(np.int64), n_known.astype(np.int64), base, score))
                ids.append(batch.select(["doc_id", "train"]))
        left = pa.Table.from_batches(ids)
        n_tokens, n_known, base, score = (np.concatenate(c) for c in zip(*parts))
        del words, contexts
        give_back()
        out = {"doc_id": left["doc_id"], "train": left["train"], "n_tokens": n_tokens, "n_known": n_known}
        return pa.table(out | {"train_tokens": np.full(len(base), total, np.int64), "base_score": base, "score": score})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return told.groupBy("block").applyInArrow(answer, schema)
