"""Ordinal quality classifier: one weight per hashed feature, ordered thresholds between grades.

P(grade <= k) = 1 / (1 + exp(score - threshold_k)): all thresholds share the text's score, so a feature
moves a text up or down the whole scale.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from .common import LOWER, UPPER, by_bytes

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Shapes: capitals, small letters and digits stand for their kind, bytes of 0x80 on are small letters.
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
BITS = 18
#: Labelled rows that the model is fitted on at most, the least by a hash of doc_id: the documented bound.
FIT_ROWS = 16_384
#: Bytes of the starts of words that are features beside the whole words.
STARTS = (5, 7)
#: Word forms whose features a task remembers.
CACHE = 500_000


def _squeeze(shape: bytes) -> bytes:
    out = bytearray()
    for b in shape:
        if out[-2:] != bytes([b, b]):
            out.append(b)
    return bytes(out[:12])


class Features:
    """Hashed features of a text: which words and starts of words it has, bare and lower-cased, and which word shapes make up much of it."""

    def __init__(self) -> None:
        self.held: dict[bytes, tuple[tuple[int, ...], int]] = {}

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        shapes: dict[int, int] = {}
        found, held = set(), self.held
        for w in words:
            pair = held.get(w)
            if pair is None:
                if len(held) >= CACHE:
                    held.clear()
                bare = w.translate(_LOWER).strip(_MARKS)
                shape = _squeeze(w.translate(_SHAPE))
                starts = [xxhash.xxh32_intdigest(bare[:k], k) >> 32 - BITS for k in STARTS if len(bare) > k]
                pair = held[w] = ((xxhash.xxh32_intdigest(bare, 1) >> 32 - BITS, *starts), xxhash.xxh32_intdigest(shape, 2))
            found.update(pair[0])
            shapes[pair[1]] = shapes.get(pair[1], 0) + 1
        for shape, n in shapes.items():
            # The share of the words that have the shape, in powers of two.
            level = max(0, 8 - (len(words) // n).bit_length())
            found.update(xxhash.xxh32_intdigest(b"%d %d" % (shape, k), 3) >> 32 - BITS for k in range(level))
        return np.fromiter(found, np.int32, len(found))


@dataclass
class Model:
    """Weights by feature and thresholds between the grades 0, 1, ... ``len(thresholds)``."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, a column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit(rows: list[np.ndarray], grades: np.ndarray, top: int, steps: int = 150, rate: float = 0.05, ridge: float = 1e-3, min_rows: int = 3) -> Model:
    """Maximum likelihood with a ridge, by Adam on all rows; features in under ``min_rows`` rows have no weight.

    Thresholds start at the shares of the grades and are kept in order by positive gaps.
    """
    size = 1 << BITS
    index = np.concatenate([np.zeros(0, np.int32), *rows])
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used = np.flatnonzero(np.bincount(index, minlength=size) >= min_rows)
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    keep = place[index] >= 0
    index, owner = place[index[keep]], owner[keep]
    share = np.cumsum(np.bincount(grades, minlength=top + 1)[:top] + 1.0) / (len(grades) + top + 1)
    start = np.log(share / (1 - share))
    values = np.concatenate([np.zeros(len(used)), [start[0]], np.log(np.maximum(np.diff(start), 1e-3))])
    n, m = len(used), len(grades)
    first, second = np.zeros(len(values)), np.zeros(len(values))
    low, high = np.maximum(grades - 1, 0), np.minimum(grades, top - 1)
    for step in range(1, steps + 1 if m else 1):
        w, gaps = values[:n], np.exp(np.clip(values[n + 1 :], -10, 10))
        cuts = values[n] + np.append(0, np.cumsum(gaps))
        score = np.bincount(owner, w[index], m)
        up = np.where(grades < top, 1 / (1 + np.exp(np.clip(score - cuts[high], -500, 500))), 1.0)  # P(<= grade)
        down = np.where(grades > 0, 1 / (1 + np.exp(np.clip(score - cuts[low], -500, 500))), 0.0)  # P(< grade)
        chance = np.maximum(up - down, 1e-12)
        slope_up, slope_down = up * (1 - up) / chance, down * (1 - down) / chance
        by_score = (slope_up - slope_down) / m
        by_cut = np.bincount(high, np.where(grades < top, -slope_up, 0) / m, top) + np.bincount(low, np.where(grades > 0, slope_down, 0) / m, top)
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate([np.bincount(index, by_score[owner], n) + ridge * w, [tail[0]], tail[1:] * gaps])
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        values -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size)
    weights[used] = values[:n]
    return Model(weights, values[n] + np.append(0, np.cumsum(np.exp(np.clip(values[n + 1 :], -10, 10)))))


def train(docs: DataFrame, ratings: DataFrame, top: int, max_rows: int = FIT_ROWS) -> Model | None:
    """Fit on at most ``max_rows`` rated documents, taken by a hash of doc_id; None without any.

    ``ratings`` has doc_id and grade (0 to ``top``). Null ids and grades are left out; of several ratings
    of one id the lowest counts.
    """
    rated = ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    picked = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in by_bytes(batches, 1):
            out = pa.array([features.of(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), out], ["grade", "features"])

    got = rows.mapInArrow(run, "grade int, features array<int>").toArrow()
    if not len(got):
        return None
    grades, features = got["grade"].to_numpy(), [np.asarray(f.values, np.int32) for f in got["features"]]
    # The order of rows must not depend on the tasks.
    order = sorted(range(len(grades)), key=lambda k: (grades[k], len(features[k]), features[k].tobytes()))
    return fit([np.sort(features[k]) for k in order], grades[order].astype(np.int64), top)


def score(docs: DataFrame, model: Model | None, cutoff: float = 0.5) -> DataFrame:
    """``docs`` with expected_grade, tail (the probability of the top grade) and kept (tail >= cutoff).

    Null and empty texts have no features and get the thresholds' own probabilities. Without a model
    the probabilities are null and all is kept. Columns of these names are replaced.
    """
    docs = docs.drop("expected_grade", "tail", "kept")
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(None).cast("double"), "tail": F.lit(None).cast("double"), "kept": F.lit(True)})
    held = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float64), model.thresholds))  # 2 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, fitted = Features(), Model(*held.value)
        for batch in by_bytes(batches, "text"):
            values = np.array([fitted.weights[np.sort(features.of(t.as_py()))].sum() for t in batch.column("text")])
            tails = fitted.tails(values)
            made = [pa.array(tails.sum(1)), pa.array(tails[:, -1]), pa.array(tails[:, -1] >= cutoff)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "expected_grade", "tail", "kept"])

    made = [StructField("expected_grade", DoubleType()), StructField("tail", DoubleType()), StructField("kept", BooleanType())]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *made]))
