import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hopscope.llm import induced_sort
from hopscope.llm.induced_sort import Disk, Queue, Sorter, repeated


def brute(segments, size):
    seen = Counter(s[k : k + size] for s in segments for k in range(len(s) - size + 1))
    found = {n: [k for k in range(len(s) - size + 1) if seen[s[k : k + size]] > 1] for n, s in enumerate(segments)}
    return {n: at for n, at in found.items() if at}


def starts(segments, size, *where):
    return {n: at.tolist() for n, at in repeated(iter(segments), size, *where)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 97, 98, 255]), max_size=30).map(bytes), max_size=6), st.integers(1, 6))
def test_small_alphabets(segments, size):
    assert starts(segments, size) == brute(segments, size)


@pytest.mark.parametrize("letters, size", [(b"ab", 20), (b"abcdefghijklmno ", 40), (bytes(range(256)), 7), (b"a", 300)])
def test_text_several_times_the_limit(tmp_path, monkeypatch, letters, size):
    """Queues, sorts, the text and the strings of names are on disk, and names are sorted by the same steps."""
    levels, files = [], []
    inner, write = induced_sort.suffixes, Disk.write
    monkeypatch.setattr(induced_sort, "suffixes", lambda *a: levels.append(a[0].n) or inner(*a))
    monkeypatch.setattr(Disk, "write", lambda self, columns: files.append(len(columns[0])) or write(self, columns))
    monkeypatch.setattr(induced_sort, "TAKE", 1 << 10)
    rng = random.Random(2)
    base = bytes(rng.choice(letters) for _ in range(16_000))
    segments = [base[rng.randrange(14_000) :][: rng.randrange(4000)] for _ in range(8)] + [b"a" * 500, b"", b"ba" * 100, b"a" * 300 + b"c"]
    want = brute(segments, size)
    assert starts(segments, size) == want and not levels and not files
    assert starts(segments, size, f"file://{tmp_path}", 6 << 10) == want
    assert len(files) > 10 and (len(set(letters)) == 1 or (len(levels) > 1 and levels == sorted(levels, reverse=True)))


def test_queue_keeps_order_on_disk(tmp_path):
    disk = Disk(f"file://{tmp_path}")
    queue = Queue(disk, np.array([0, 1, 4, 6, 7, 8]), 2000, True)
    for k in range(300):
        queue.put([np.array([5 + k % 3]), np.array([k])])
    assert disk.written and all(r.columns is None or r.n for rs in queue.runs for r in rs)
    for band, symbol in ((2, 5), (3, 6), (4, 7)):
        got = [(int(s), int(a)) for symbols, at in queue.take(band) for s, a in zip(symbols, at)]
        assert got == [(symbol, k) for k in range(300) if 5 + k % 3 == symbol]
    for k in range(300):
        queue.put_band(1, [np.array([2]), np.array([k])])
    assert [int(a) for _, at in queue.take(1, back=True) for a in at] == list(range(299, -1, -1))
    assert not list(tmp_path.iterdir())


def test_sorts_merge_runs(tmp_path):
    rng = np.random.default_rng(1)
    sorter, keys = Sorter(Disk(f"file://{tmp_path}"), 50_000), rng.permutation(100_000)
    for part in np.split(keys, 40):
        sorter.add(part, part * 2)
    blocks = list(sorter.blocks())
    assert len(blocks) > 3 and (np.concatenate([b[0] for b in blocks]) == np.arange(100_000)).all() and all((b[1] == 2 * b[0]).all() for b in blocks)
