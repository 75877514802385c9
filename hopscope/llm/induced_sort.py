"""External induced sorting of suffixes with common-prefix values, in bulk.

The text is a list of segments of bytes, each ended by a separator. Codes are 0 (separator: smaller than
all bytes, each a symbol of its own by position) and 1 + byte. A suffix is L if the next one is
smaller, else S; an LMS suffix is an S after an L.

1. The LMS substrings are sorted by inducing from the LMS places in any order, and named by rank.
2. If names repeat, the string of names, under half as long, is sorted by the same steps, and so on; a string that fits
   the memory limit is sorted there.
3. From the sorted LMS suffixes all L and then all S suffixes are induced through priority queues:
   taking suffixes in order puts each one's predecessor behind those already queued under the predecessor's
   symbol. At the first level each tuple carries the length that it shares with the one queued before it: one more than
   the least value between their successors. Values stop at the size that is looked for.

Nothing but a few arrays of ``limit`` bytes together is in memory: the text, the names, the queues and the sorts by position
go to disk beyond it, in a folder of any file system that pyarrow opens. A tuple brings the codes before
its place along, so that no step looks into the text; after some codes (7 bytes, 2 names) more are fetched by a scan.
A queue is a list of bands of symbols, each a list of runs in the order of queuing. A band is one symbol, taken run by run, or holds
so few tuples that it is sorted in memory.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow.fs as pafs

#: Bytes that sorting one text keeps in memory, about.
LIMIT = 128 << 20
#: Least number of tuples that are taken at once, and of a band of several symbols at most.
TAKE = 1 << 18
#: Bytes a symbol that sorting a string in memory takes.
IN_MEMORY = 64
_LEVEL_0 = 9  # bits of a code
_NAMES = 31


@dataclass
class Run:
    """Columns of equal length, in memory or in a file."""

    n: int
    columns: list[np.ndarray] | None
    name: str = ""
    kinds: list[np.dtype] = field(default_factory=list)


class Disk:
    """Runs in files of a folder; each file is deleted when it has been read to its end."""

    def __init__(self, folder: str | None):
        self.fs, self.root = pafs.FileSystem.from_uri(folder) if folder else (None, None)
        self.written = 0
        if self.fs:
            self.fs.create_dir(self.root, recursive=True)

    def write(self, columns: list[np.ndarray]) -> Run:
        run = Run(len(columns[0]), None, f"{self.root}/{uuid.uuid4().hex}", [c.dtype for c in columns])
        with self.fs.open_output_stream(run.name) as out:
            for c in columns:
                out.write(np.ascontiguousarray(c).data)
        self.written += 1
        return run

    def read(self, run: Run, first: int = 0, end: int | None = None, keep: bool = False) -> list[np.ndarray]:
        end = run.n if end is None else min(end, run.n)
        if run.columns is not None:
            return [c[first:end] for c in run.columns]
        out, at = [], 0
        with self.fs.open_input_file(run.name) as f:
            for kind in run.kinds:
                f.seek(at + first * kind.itemsize)
                out.append(np.frombuffer(f.read((end - first) * kind.itemsize), kind))
                at += run.n * kind.itemsize
        if end == run.n and not keep:
            self.fs.delete_file(run.name)
        return out

    def drop(self, run: Run) -> None:
        if run.columns is None:
            self.fs.delete_file(run.name)


def _joined(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    return parts[0] if len(parts) == 1 else [np.concatenate(c) for c in zip(*parts)]


class Sorter:
    """Rows in the order of their first column: runs sorted in memory, merged in bulk."""

    def __init__(self, disk: Disk, limit: int):
        self.disk, self.limit, self.held, self.size, self.runs = disk, limit, [], 0, []

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.held.append(list(columns))
            self.size += sum(c.nbytes for c in columns)
            if self.size > self.limit and self.disk.fs:
                self.runs.append(self.disk.write(self._sorted()))

    def _sorted(self) -> list[np.ndarray]:
        columns = _joined(self.held)
        order = np.argsort(columns[0])
        self.held, self.size = [], 0
        return [c[order] for c in columns]

    def blocks(self) -> Iterator[list[np.ndarray]]:
        if not self.runs:
            if self.held:
                yield self._sorted()
            return
        if self.held:
            self.runs.append(self.disk.write(self._sorted()))
        row = sum(k.itemsize for k in self.runs[0].kinds)
        rows = max(1024, self.limit // (2 * row * len(self.runs)))
        at, open_ = [0] * len(self.runs), {}
        while True:
            for k, run in enumerate(self.runs):
                if k not in open_ and at[k] < run.n:
                    open_[k] = self.disk.read(run, at[k], at[k] + rows)
                    at[k] += rows
            if not open_:
                return
            more = [b[0][-1] for k, b in open_.items() if at[k] < self.runs[k].n]
            parts = []
            for k, b in list(open_.items()):
                cut = int(np.searchsorted(b[0], min(more), "right")) if more else len(b[0])
                parts.append([c[:cut] for c in b])
                if cut == len(b[0]):
                    del open_[k]
                else:
                    open_[k] = [c[cut:] for c in b]
            columns = _joined(parts)
            order = np.argsort(columns[0], kind="stable")
            yield [c[order] for c in columns]


class Tape:
    """A string of codes in pieces of equal length, ended by the code 0."""

    def __init__(self, disk: Disk, kind: type, limit: int, bits: int):
        self.disk, self.kind, self.bits, self.n = disk, kind, bits, 0
        self.piece = max(1 << 12, limit // (8 * np.dtype(kind).itemsize))
        self.pieces: list[Run] = []
        self.rest: list[np.ndarray] = []
        self.rest_n = 0

    def add(self, codes: np.ndarray) -> None:
        self.rest.append(codes.astype(self.kind))
        self.rest_n += len(codes)
        self.n += len(codes)
        if self.rest_n >= self.piece:
            whole = np.concatenate(self.rest)
            stop = len(whole) - len(whole) % self.piece
            for k in range(0, stop, self.piece):
                part = [whole[k : k + self.piece].copy()]
                # The first pieces stay in memory.
                self.pieces.append(self.disk.write(part) if self.disk.fs and len(self.pieces) >= 2 else Run(self.piece, part))
            self.rest, self.rest_n = [whole[stop:].copy()], len(whole) - stop

    def close(self) -> None:
        if self.rest_n:
            self.pieces.append(Run(self.rest_n, [np.concatenate(self.rest)]))
        self.rest = []

    def read(self, first: int, end: int) -> np.ndarray:
        """The codes from ``first`` to ``end``, 0 before the string."""
        parts = [np.zeros(max(0, -first), self.kind)]
        first = max(0, first)
        while first < min(end, self.n):
            k = first // self.piece
            stop = min(end, self.n, (k + 1) * self.piece)
            parts += self.disk.read(self.pieces[k], first - k * self.piece, stop - k * self.piece, keep=True)
            first = stop
        return np.concatenate(parts)

    def _before(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The codes before each place of ``codes``, the nearest one lowest; behind them all bits are set."""
        many = 63 // self.bits
        out = np.zeros(len(at), np.uint64)
        for j in range(many):
            out |= codes[at - 1 - j].astype(np.uint64) << np.uint64(self.bits * j)
        return out

    def contexts(self, places: np.ndarray) -> np.ndarray:
        """What ``_before`` says for places in any order, by a scan of the pieces that hold them."""
        order, many = np.argsort(places), 63 // self.bits
        out, sorted_places = np.empty(len(places), np.uint64), places[order]
        cuts = np.searchsorted(sorted_places, np.arange(0, self.n + self.piece, self.piece))
        for k in np.flatnonzero(np.diff(cuts)):
            mine = sorted_places[cuts[k] : cuts[k + 1]]
            low = int(mine[0]) - many
            out[order[cuts[k] : cuts[k + 1]]] = self._before(self.read(low, int(mine[-1]) + 1), (mine - low).astype(np.int64))
        return out

    def lms(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(place, code, codes before, codes to the next separator) of the LMS suffixes, from the last to the first."""
        many = 63 // self.bits
        next_code, next_kind, next_zero = 0, True, self.n
        for k in range(len(self.pieces) - 1, -1, -1):
            first = k * self.piece
            codes = self.read(first - many, min(self.n, first + self.piece))
            own = codes[many:]
            after = np.append(own[1:], self.kind(next_code))
            kind, known = own < after, (own != after) | (own == 0)
            kind[own == 0] = True
            if not known[-1]:
                kind[-1], known[-1] = next_kind, True
            # Equal codes are of the next one's type.
            at = np.where(known, np.arange(len(own)), len(own))
            kind = kind[np.minimum.accumulate(at[::-1])[::-1]]
            zeros = np.where(own == 0, np.arange(len(own)), next_zero - first)
            zeros = np.minimum.accumulate(zeros[::-1])[::-1]
            # The one before is L if it is larger: an S is never before a smaller code or, being equal, of another type.
            found = np.flatnonzero(kind & (codes[many - 1 : -1] > own))
            if first == 0:
                found = found[found > 0]
            found = found[::-1]
            wide = np.int32 if self.n < 1 << 31 else np.int64
            yield (found + first).astype(wide), own[found].astype(np.int32), self._before(codes, found + many), zeros[found] - found
            next_code, next_kind, next_zero = int(own[0]), bool(kind[0]), int(zeros[0]) + first

    def drop(self) -> None:
        for run in self.pieces:
            self.disk.drop(run)


class Queue:
    """Runs of tuples by band of symbols, first in first out; over ``limit`` bytes those that are due last go to disk."""

    def __init__(self, disk: Disk, bounds: np.ndarray, limit: int, ascending: bool):
        self.disk, self.bounds, self.limit, self.ascending = disk, bounds, limit, ascending
        self.runs: list[list[Run]] = [[] for _ in range(len(bounds))]
        self.held = 0

    def put(self, columns: list[np.ndarray]) -> None:
        """Queue tuples; the first column is the symbol."""
        if not len(columns[0]):
            return
        band = np.searchsorted(self.bounds, columns[0], "right") - 1
        order = np.argsort(band.astype(np.int16 if len(self.bounds) < 1 << 15 else np.int64), kind="stable")
        cuts = np.flatnonzero(np.diff(band[order])) + 1
        for part in np.split(order, cuts):
            self.put_band(int(band[part[0]]), [c[part] for c in columns])

    def put_band(self, band: int, columns: list[np.ndarray]) -> None:
        if not len(columns[0]):
            return
        self.runs[band].append(Run(len(columns[0]), columns))
        self.held += sum(c.nbytes for c in columns)
        if self.held > self.limit and self.disk.fs:
            bands = range(len(self.runs))
            for b in reversed(bands) if self.ascending else bands:
                live = [r for r in self.runs[b] if r.columns is not None]
                if self.held <= self.limit // 2:
                    return
                if live:
                    whole = _joined([r.columns for r in live])
                    # Runs on disk stay before those that come later.
                    self.runs[b] = [r for r in self.runs[b] if r.columns is None] + [self.disk.write(whole)]
                    self.held -= sum(c.nbytes for c in whole)

    def _load(self, run: Run) -> list[np.ndarray]:
        if run.columns is not None:
            self.held -= sum(c.nbytes for c in run.columns)
        return self.disk.read(run)

    def take(self, band: int, back: bool = False) -> Iterator[list[np.ndarray]]:
        """The band's tuples in order, or from the last to the first; tuples put meanwhile are given as well."""
        while self.runs[band]:
            parts, size = [], 0
            while self.runs[band] and size < TAKE:
                columns = self._load(self.runs[band].pop(-1 if back else 0))
                parts.append([c[::-1] for c in columns] if back else columns)
                size += len(columns[0])
            yield _joined(parts)


_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (h ^ (code.astype(np.uint64) * _MIX[0])) * _MIX[1]
    return h ^ (h >> np.uint64(29))


class Inducer:
    """One pass: takes tuples (symbol, place, codes before, value) in order and queues their predecessors.

    The value is a hash of the codes from the place on (to name LMS substrings), the length shared with the
    tuple before (to the cap), or nothing.
    """

    def __init__(self, tape: Tape, queue: Queue, down: bool, hashed: bool, cap: int):
        self.tape, self.queue, self.down, self.hashed, self.cap = tape, queue, down, hashed, cap
        self.bits = np.uint64(tape.bits)
        self.mask = np.uint64((1 << tape.bits) - 1)
        self.fill = np.uint64(((1 << tape.bits) - 1) << tape.bits * (63 // tape.bits - 1))
        if cap:
            self.since = np.full(len(queue.bounds), -1)  # no entry yet: the first shares nothing

    def before(self, columns: list[np.ndarray]) -> np.ndarray:
        """The code before each place; codes that ran out are fetched."""
        code = (columns[2] & self.mask).astype(np.int32)
        out = np.flatnonzero(code == int(self.mask))
        if len(out):
            columns[2] = columns[2].copy()
            columns[2][out] = self.tape.contexts(columns[1][out])
            code[out] = (columns[2][out] & self.mask).astype(np.int32)
        return code

    def wanted(self, symbol: np.ndarray, code: np.ndarray, late: bool | np.ndarray) -> np.ndarray:
        """Which predecessors this pass queues; ``late``: seeds on the way up, L suffixes on the way down."""
        if self.down:
            return (code > 0) & (code <= symbol - late)
        return (code > 0) & (code >= symbol)

    def made(self, columns: list[np.ndarray], code: np.ndarray, use: np.ndarray) -> list[np.ndarray]:
        c = code[use]
        out = [c, columns[1][use] - 1, (columns[2][use] >> self.bits) | self.fill]
        return [*out, _mixed(columns[3][use], c)] if self.hashed else out

    def scan(self, columns: list[np.ndarray], late: bool) -> np.ndarray:
        """Go over tuples of one symbol in order, and say what is before them."""
        code = self.before(columns)
        use = np.flatnonzero(self.wanted(columns[0], code, late))
        made = self.made(columns, code, use)
        if not self.cap:
            self.queue.put(made)
            return code
        shared = columns[3]
        least = int(shared.min())
        after = np.minimum(self.since, least)
        order = np.argsort(made[0].astype(np.int16), kind="stable")
        cuts = np.flatnonzero(np.diff(made[0][order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            symbol, k = int(made[0][part[0]]), use[part]
            # From the last entry of the symbol to the first of these, then between entries.
            gap = np.empty(len(k), np.int64)
            gap[0] = min(int(self.since[symbol]), int(shared[: k[0] + 1].min()))
            if len(k) > 1:
                ends = np.stack([k[:-1] + 1, k[1:] + 1], 1).ravel()
                ends = ends[:-1] if ends[-1] >= len(shared) else ends
                gap[1:] = np.minimum.reduceat(shared, ends)[::2]
            self.queue.put_band(symbol, [*[c[part] for c in made], np.minimum(gap + 1, self.cap).astype(np.int16)])
            after[symbol] = int(shared[k[-1] + 1 :].min()) if k[-1] + 1 < len(shared) else self.cap
        self.since = after
        return code

    def merge(self, band: int, early: list[list[np.ndarray]], late: list[list[np.ndarray]]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        """Go over a band of several symbols in order: (tuples, what is before them, which are late).

        Tuples are taken many at once: as long as none comes after what the ones taken before it queue.
        """
        low, high = int(self.queue.bounds[band]), int(self.queue.bounds[band + 1]) if band + 1 < len(self.queue.bounds) else 1 << 62
        sign = -1 if self.down else 1
        parts = [[sign * 2 * c[0].astype(np.int64) + k, *c] for k, group in enumerate((early, late)) for c in group]
        if not parts:
            return
        main = _joined(parts)
        order = np.argsort(main[0], kind="stable")
        main = [c[order] for c in main]
        fresh, at, many = [c[:0] for c in main], 0, 1024
        while at < len(main[0]) or len(fresh[0]):
            stop = min(at + many, len(main[0]))
            own = stop - at
            cut = int(np.searchsorted(fresh[0], main[0][stop], "left")) if stop < len(main[0]) else len(fresh[0])
            both = [np.concatenate([m[at:stop], f[:cut]]) for m, f in zip(main, fresh)]
            order = np.argsort(both[0], kind="stable")
            both = [c[order] for c in both]
            columns = both[1:]
            code, is_late = self.before(columns), both[0] & 1 == 1
            use = self.wanted(columns[0], code, is_late)
            inside = use & (code >= low) & (code < high)
            bound = np.minimum.accumulate(np.where(inside, sign * 2 * code.astype(np.int64), 1 << 62))
            stops = np.flatnonzero(both[0][1:] > bound[:-1])
            n = int(stops[0]) + 1 if len(stops) else len(order)
            taken = [c[:n] for c in columns]
            yield taken, code[:n], is_late[:n]
            use, inside = np.flatnonzero(use[:n] & ~inside[:n]), np.flatnonzero(inside[:n])
            self.queue.put(self.made(taken, code[:n], use))
            new = self.made(taken, code[:n], inside)
            new = [sign * 2 * new[0].astype(np.int64), *new]
            from_main = int((order[:n] < own).sum())
            at += from_main
            fresh = [np.concatenate([f[n - from_main :], x]) for f, x in zip(fresh, new)]
            by = np.argsort(fresh[0], kind="stable")
            fresh = [c[by] for c in fresh]
            many = min(1 << 16, many * 2) if n == len(order) else max(256, 2 * n)
            if len(fresh[0]) > 16 * many:
                main = [np.concatenate([m[at:], f]) for m, f in zip(main, fresh)]
                by = np.argsort(main[0], kind="stable")
                main, fresh, at = [c[by] for c in main], [c[:0] for c in main], 0


def induce(tape: Tape, seeds: Queue, limit: int, hashed: bool, cap: int) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray | bool]]:
    """All suffixes but those at separators, from the largest to the smallest: (tuples, what is before them, whether they are L).

    ``seeds`` has the LMS suffixes, in order for the order of the suffixes; in any order (but for separators), the LMS
    substrings come out in order. The second column is the place. With a cap the fourth is the length shared with the tuple
    before, of the same symbol.
    """
    disk, bounds = tape.disk, seeds.bounds
    single = np.append(np.diff(bounds) == 1, False)
    queue, kept = Queue(disk, bounds, limit, True), Queue(disk, bounds, limit, False)
    up = Inducer(tape, queue, False, hashed, cap)
    for band in range(len(bounds)):
        if single[band]:
            last = -1
            for columns in queue.take(band):
                up.scan(columns, False)
                last = int(columns[1][-1])
                kept.put_band(band, columns)
            for columns in seeds.take(band):
                if cap:
                    if last >= 0:
                        columns[3] = columns[3].copy()
                        columns[3][0] = min(cap, _run(tape, last, cap), _run(tape, int(columns[1][0]), cap))
                    last = -1
                up.scan(columns, True)
        else:
            for columns, _, late in up.merge(band, list(queue.take(band)), list(seeds.take(band))):
                kept.put_band(band, [c[~late] for c in columns])
    queue = Queue(disk, bounds, limit, False)
    down = Inducer(tape, queue, True, hashed, cap)
    for band in range(len(bounds) - 1, -1, -1):
        if single[band]:
            smallest, carried = -1, None
            for columns in queue.take(band):
                yield columns, down.scan(columns, False), False
                smallest = int(columns[1][-1])
            for columns in kept.take(band, back=True):
                if cap:
                    # A value belongs to the one above: shift by one, the seam to the S suffixes first.
                    if carried is None:
                        carried = min(cap, _run(tape, smallest, cap), _run(tape, int(columns[1][0]), cap)) if smallest >= 0 else 0
                    moved = np.append(np.int16(carried), columns[3][:-1])
                    carried = columns[3][-1]
                    columns = [*columns[:3], moved]
                yield columns, down.scan(columns, True), True
        else:
            last = [[c[::-1] for c in _joined(list(kept.take(band)))]] if kept.runs[band] else []
            yield from down.merge(band, list(queue.take(band)), last)


def _run(tape: Tape, at: int, cap: int) -> int:
    """How often the code at a place repeats from there on, up to ``cap``."""
    codes = tape.read(at, at + cap)
    other = np.flatnonzero(codes != codes[0])
    return int(other[0]) if len(other) else len(codes)


def _named(tape: Tape, bounds: np.ndarray, limit: int) -> tuple[Sorter, int, int, np.ndarray]:
    """LMS places with their names, still numbered from the largest: (sorter, separators, names, bounds of bands)."""
    seeds, first = Queue(tape.disk, bounds, limit, True), Sorter(tape.disk, limit)
    names, zeros, m = Sorter(tape.disk, limit), 0, 0
    for place, code, before, _ in tape.lms():
        m += len(place)
        zero = code == 0
        at = place[zero]
        # Separators are names of their own, from the last to the first, and differ as ends of substrings.
        names.add(at, -1 - np.arange(zeros, zeros + len(at)))
        zeros += len(at)
        columns = [code, place, before, _mixed(np.ones(len(code), np.uint64), np.where(zero, place.astype(np.int64) + (1 << 40), code))]
        first.add(*[c[zero] for c in (place, *columns)])
        seeds.put([c[~zero] for c in columns])
    for _, *columns in first.blocks():
        seeds.put_band(0, columns)
    last, count, seen, marks = None, 0, 0, []
    for columns, code, large in induce(tape, seeds, limit, True, 0):
        use = np.flatnonzero((code > columns[0]) & ~np.asarray(large))
        if not len(use):
            continue
        h = columns[3][use]
        new = np.append(last is None or h[0] != last, h[1:] != h[:-1])
        number = count + np.cumsum(new) - 1
        names.add(columns[1][use], number)
        step = max(1, TAKE // 2)
        at = np.arange(-seen % step, len(use), step)
        marks.append(number[at])
        last, count, seen = h[-1], int(number[-1]) + 1, seen + len(use)
    high = np.unique(np.concatenate([np.zeros(0, np.int64), *marks]))
    # Names count from 1: separators by position, then the substrings from the smallest on.
    cuts = zeros + count - high
    step = np.arange(1, zeros + 1, max(1, TAKE // 2))
    return names, zeros, count, np.unique(np.concatenate([[0, 1], step, cuts, cuts + 1, [zeros + count + 1]]))


def _order_in_memory(text: np.ndarray) -> np.ndarray:
    """Suffix order of a string that ends with its only 0, by doubling over the suffixes that still tie."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    head = np.append(True, text[order][1:] != text[order][:-1])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    step = 1
    while len(slots := np.flatnonzero(~(head & np.append(head[1:], True)))):
        tied = order[slots]
        group, second = rank[tied], rank[np.minimum(tied + step, n)]
        by = np.argsort(group * np.int64(n + 1) + second) if n < 1 << 31 else np.lexsort((second, group))
        tied, group, second = tied[by], group[by], second[by]
        order[slots] = tied
        new = np.append(True, (group[1:] != group[:-1]) | (second[1:] != second[:-1]))
        head[slots] = new
        rank[tied] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        step *= 2
    return order


def _lms_ranks(tape: Tape, bounds: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Ranks of the LMS suffixes, from the last place to the first."""
    names, zeros, count, cuts = _named(tape, bounds, limit)
    string, total = Tape(tape.disk, np.int32, limit, _NAMES), 0
    for _, number in names.blocks():
        string.add(np.where(number < 0, zeros + 1 + number, zeros + count - number))
        total += len(number)
    unique = total == zeros + count
    string.add(np.zeros(1, np.int32))
    string.close()
    if unique:
        for k in range(len(string.pieces) - 1, -1, -1):
            part = string.read(k * string.piece, min(total, (k + 1) * string.piece))
            yield part[::-1].astype(np.int64) - 1
    elif (total + 1) * IN_MEMORY <= 3 * limit or not tape.disk.fs:
        order = _order_in_memory(string.read(0, total + 1))
        string.drop()
        rank = np.empty(total + 1, np.int64)
        rank[order] = np.arange(total + 1)
        del order
        yield rank[:total][::-1] - 1  # the end comes first
        return
    else:
        by_place, rank = Sorter(tape.disk, limit), total - 1
        for places in suffixes(string, cuts, limit):
            by_place.add(-places.astype(np.int64), rank - np.arange(len(places)))
            rank -= len(places)
        for _, ranks in by_place.blocks():
            yield ranks
    string.drop()


def _aligned(blocks: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """Takes what is sent as a number of values from ``blocks`` and yields so many."""
    held = np.zeros(0, np.int64)
    n = yield held
    while True:
        while len(held) < n:
            held = np.concatenate([held, next(blocks)])
        out, held = held[:n], held[n:]
        n = yield out


def _sorted_lms(tape: Tape, bounds: np.ndarray, limit: int) -> Iterator[list[np.ndarray]]:
    """[rank, place, code, codes before, codes to the next separator] of the LMS suffixes in order."""
    by_rank, ranks = Sorter(tape.disk, limit), _aligned(_lms_ranks(tape, bounds, limit))
    next(ranks)
    for place, code, before, room in tape.lms():
        by_rank.add(ranks.send(len(place)), place, code, before, room)
    return by_rank.blocks()


def suffixes(tape: Tape, bounds: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Places of the suffixes but the last code's, from the largest to the smallest."""
    seeds = Queue(tape.disk, bounds, limit, True)
    for _, place, code, before, _ in _sorted_lms(tape, bounds, limit):
        seeds.put([code, place, before])
    for columns, _, _ in induce(tape, seeds, limit, False, 0):
        yield columns[1]


def _shared(raw_a: np.ndarray, raw_b: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Bytes that ``raw_a`` from ``a`` on shares with ``raw_b`` from ``b`` on, up to ``room``.

    Eight bytes are compared at a time; only pairs that still agree go on.
    """
    views = [np.ndarray((len(r) - 7,), "<u8", r, 0, (1,)) for r in (raw_a, raw_b)]
    out, live, done = room.astype(np.int16), np.flatnonzero(room > 0), 0
    while len(live):
        differ = views[0][a[live] + done] ^ views[1][b[live] + done]
        stop = np.flatnonzero(differ)
        same = np.bitwise_count((differ[stop] & -differ[stop]) - np.uint64(1)).astype(np.int64) >> 3
        out[live[stop]] = np.minimum(done + same, room[live[stop]])
        done += 8
        live = live[(differ == 0) & (room[live] > done)]
    return out


def _lms_values(tape: Tape, bounds: np.ndarray, size: int, limit: int) -> Iterator[list[np.ndarray]]:
    """[code, place, codes before, shared] of the LMS suffixes in order: shared with the one before, up to ``size``.

    Neighbours are compared piece by piece of the text: pairs go by the pieces that they start in.
    """
    pieces, wide = len(tape.pieces), Sorter(tape.disk, limit)
    pairs, last = Sorter(tape.disk, limit), None
    for rank, place, code, before, room in _sorted_lms(tape, bounds, limit):
        room = np.minimum(room, size)
        wide.add(rank, place, code, before)
        ahead = [np.append(c[:0] if last is None else last[k], c[:-1]) for k, c in enumerate((place, room))]
        a, b, r, k = ahead[0], place[len(place) - len(ahead[0]) :], np.minimum(ahead[1], room[len(place) - len(ahead[0]) :]), rank[len(place) - len(ahead[0]) :]
        # Unique keys: the pair of pieces, then the rank.
        pairs.add((a // tape.piece).astype(np.int64) * (pieces * tape.n) + (b // tape.piece).astype(np.int64) * tape.n + k, a, b, r.astype(np.int16), k)
        last = (place[-1:], room[-1:])
    values = Sorter(tape.disk, limit)
    held: tuple[int, np.ndarray] | None = None
    raw = lambda k: np.append(tape.read(k * tape.piece, (k + 1) * tape.piece + size) - np.uint16(1), np.zeros(8, np.uint16)).astype(np.uint8)
    for _, a, b, r, k in pairs.blocks():
        which = (a // tape.piece).astype(np.int64) * pieces + b // tape.piece
        for part in np.split(np.arange(len(k)), np.flatnonzero(np.diff(which)) + 1):
            i, j = divmod(int(which[part[0]]), pieces)
            if held is None or held[0] != i:
                held = (i, raw(i))
            other = held[1] if i == j else raw(j)
            values.add(k[part], _shared(held[1], other, a[part] - i * tape.piece, b[part] - j * tape.piece, r[part].astype(np.int64)))
    found, done = values.blocks(), (np.zeros(0, np.int64), np.zeros(0, np.int16))
    for rank, place, code, before in wide.blocks():
        while not len(done[0]) or done[0][-1] < rank[-1]:
            more = next(found, None)
            if more is None:
                break
            done = tuple(np.concatenate(x) for x in zip(done, more))
        shared = np.zeros(len(rank), np.int16)  # the first of all shares nothing
        cut = int(np.searchsorted(done[0], rank[-1], "right"))
        shared[np.searchsorted(rank, done[0][:cut])] = done[1][:cut]
        done = tuple(x[cut:] for x in done)
        yield [code, place, before, shared]


def repeated(segments: Iterable[bytes], size: int, folder: str | None = None, limit: int = LIMIT) -> Iterator[tuple[int, np.ndarray]]:
    """(number, positions) of each segment in which strings of ``size`` bytes start that also start at another position of any segment.

    A position's longest match is with a neighbour in suffix order, so shared lengths of ``size`` on
    either side decide. Beyond ``limit`` bytes, text and tuples are in files in ``folder``; without one all is in memory.
    """
    disk, part = Disk(folder), limit // 6
    tape, sizes = Tape(disk, np.uint16, part, _LEVEL_0), []
    for s in segments:
        sizes.append(len(s))
        if s:
            tape.add(np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + np.uint16(1), np.uint16(0)))
    tape.close()
    if not tape.n:
        return
    bounds = np.arange(258)
    seeds, hits = Queue(disk, bounds, part, True), Sorter(disk, part)
    for columns in _lms_values(tape, bounds, size, part):
        seeds.put(columns)
    before: dict[int, int] = {}
    for columns, _, _ in induce(tape, seeds, part, False, size):
        symbol, place, shared = int(columns[0][0]), columns[1], columns[3]
        long = np.flatnonzero(shared >= size)
        hits.add(np.append(place[long], np.where(long > 0, place[long - 1], before.get(symbol, -1))))
        before = {symbol: int(place[-1])}
    tape.drop()
    sizes = np.array(sizes, np.int64)
    ends = np.cumsum(sizes + (sizes > 0))
    rest: tuple[int, list[np.ndarray]] | None = None
    for (keys,) in hits.blocks():
        at = np.unique(keys)
        number = np.searchsorted(ends, at, "right")
        for part_ in np.split(np.arange(len(at)), np.flatnonzero(np.diff(number)) + 1):
            k = int(number[part_[0]])
            here = at[part_] - (ends[k] - sizes[k] - 1)
            if rest and rest[0] == k:
                rest[1].append(here)
                continue
            if rest:
                yield rest[0], np.unique(np.concatenate(rest[1]))
            rest = (k, [here])
    if rest:
        yield rest[0], np.unique(np.concatenate(rest[1]))
