"""Suffix and common-prefix arrays by external induced sorting.

Suffixes that start a rising run after a falling one (stars) are sorted first: their
substrings by induction, then, where those repeat, the shorter string of their names by
recursion. All other suffixes follow from the stars by two sweeps over the symbols. Each
sweep keeps the suffixes it has found but not yet reached in a priority queue keyed by first
symbol, whose batches go to disk beyond a bound, and every queue entry carries the common
prefix with the entry before it.

Only batches of CHUNK entries, the queue's QUEUE_ROWS and a string of BASE_ROWS names are in
memory. Text, types, stars, names, falling suffixes and results lie in scratch files, which
are private to a task and go with it, like Spark's own spill files.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Common prefixes are counted up to this.
MOST = 100
#: Queue entries in memory; more go to disk.
QUEUE_ROWS = 1 << 16
#: Entries that are handled at a time.
CHUNK = 1 << 16
#: A string of names up to this long is ranked in memory; longer ones recurse.
BASE_ROWS = 1 << 16
#: Symbols that have a queue bucket each; with more, neighbours share one.
SINGLE = 1 << 10

Batch = tuple[np.ndarray, np.ndarray]


def scratch(n: int, dtype) -> np.ndarray:
    """n zeros in an unnamed file of this task."""
    if not n:
        return np.zeros(0, dtype)
    file = tempfile.TemporaryFile()
    file.truncate(n * np.dtype(dtype).itemsize)
    return np.memmap(file, dtype, "r+", shape=(n,)).view(np.ndarray)


class Tape:
    """Arrays written one after another to an unnamed file and read back in any order of batches."""

    def __init__(self, *dtypes):
        self.dtypes = [np.dtype(d) for d in dtypes]
        self.width = sum(d.itemsize for d in self.dtypes)
        self.file, self.at = None, 0

    def write(self, *columns: np.ndarray) -> tuple[int, int]:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(self.at)
        for c, d in zip(columns, self.dtypes, strict=True):
            self.file.write(np.ascontiguousarray(c, d).data)
        place = self.at, len(columns[0])
        self.at += self.width * place[1]
        return place

    def read(self, place: tuple[int, int]) -> Batch:
        at, n = place
        self.file.seek(at)
        data, out = self.file.read(self.width * n), []
        begin = 0
        for d in self.dtypes:
            out.append(np.frombuffer(data, d, n, begin))
            begin += d.itemsize * n
        return tuple(out)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class SymbolQueue:
    """Priority queue of (position, prefix) batches by bucket of symbols; a bucket's entries leave in the order they came.

    starts: the first symbol of each bucket. Beyond ``rows`` entries the batches in memory move
    to a scratch file, in order, so a bucket's batches on disk come before those in memory.
    """

    def __init__(self, starts: np.ndarray, rows: int = QUEUE_ROWS):
        self.starts, self.rows, self.held = starts, rows, 0
        self.plain = len(starts) == int(starts[-1]) + 1
        self.parts: dict[int, deque] = {}
        self.tape = Tape(np.int64, np.uint8)
        self.spilled = 0

    def push(self, symbols: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        """Add a batch; entries of one bucket keep their order."""
        if not len(symbols):
            return
        bucket = np.minimum(symbols, len(self.starts) - 1) if self.plain else np.searchsorted(self.starts, symbols, side="right") - 1
        order = np.argsort(bucket, kind="stable")
        b, p, c = bucket[order], positions[order], prefixes[order]
        cuts = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            self.parts.setdefault(int(b[x]), deque()).append((p[x:y], c[x:y]))
        self.held += len(b)
        if self.held > self.rows:
            for parts in self.parts.values():
                for i, part in enumerate(parts):
                    if isinstance(part[0], np.ndarray):
                        parts[i] = self.tape.write(*part)
            self.spilled += self.held
            self.held = 0

    def pop(self, bucket: int, most: int = CHUNK) -> Batch | None:
        """The next entries of a bucket, about ``most``; None once it has no more."""
        parts = self.parts.get(bucket)
        got, n = [], 0
        while parts and n < most:
            part = parts.popleft()
            if not isinstance(part[0], np.ndarray):
                part = self.tape.read(part)
            else:
                self.held -= len(part[0])
            if n + len(part[0]) > 2 * most:
                cut = max(1, most - n)
                parts.appendleft((part[0][cut:], part[1][cut:]))
                self.held += len(part[0]) - cut
                part = part[0][:cut], part[1][:cut]
            got.append(part)
            n += len(part[0])
        if not got:
            return None
        return got[0] if len(got) == 1 else (np.concatenate([p for p, _ in got]), np.concatenate([c for _, c in got]))

    def close(self) -> None:
        self.tape.close()


class _Minima:
    """Least common prefix between any two entries of a batch, in logarithmic tables."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        step = 1
        while 2 * step <= len(values):
            t = self.tables[-1]
            self.tables.append(np.minimum(t[:-step], t[step:]))
            step *= 2

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values[a:b], for a < b."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.tables[0].dtype)
        for k in np.flatnonzero(np.bincount(level)).tolist():
            i = np.flatnonzero(level == k)
            t = self.tables[k]
            out[i] = np.minimum(t[a[i]], t[b[i] - (1 << k)])
        return out


class _Induction:
    """Queue of one sweep, and the common prefix of each entry with the last of its symbol.

    Symbols are keys that the sweep meets in rising order. since[s]: the least prefix between
    neighbours scanned since key s was last given an entry; that, plus one, is the prefix of
    the next entry with the last.
    """

    def __init__(self, starts: np.ndarray, symbols: int, rows: int, prefixes: bool):
        self.queue, self.prefixes = SymbolQueue(starts, rows), prefixes
        if prefixes:
            self.since = np.full(symbols, MOST, np.uint8)
            self.fresh = np.ones(symbols, bool)

    def scan(self, near: np.ndarray, at: np.ndarray, target: np.ndarray, before: np.ndarray) -> None:
        """Read a batch (near: prefix of each suffix with the one read before); of those at ``at``, push the one before."""
        if not self.prefixes:
            self.queue.push(target, before, np.zeros(len(before), np.uint8))
            return
        low_all = near.min()
        if not len(at):
            np.minimum(self.since, low_all, out=self.since)
            return
        order = np.argsort(target, kind="stable")
        t, at = target[order], at[order]
        first = np.r_[True, t[1:] != t[:-1]]
        minima = _Minima(near)
        low = np.empty(len(t), np.uint8)
        again = np.flatnonzero(~first)
        if len(again):
            low[again] = minima.between(at[again - 1] + 1, at[again] + 1)
        start = np.flatnonzero(first)
        low[start] = np.minimum(self.since[t[start]], minima.between(np.zeros(len(start), np.int64), at[start] + 1))
        found = np.minimum(low.astype(np.int64) + 1, MOST).astype(np.uint8)
        found[start] = np.where(self.fresh[t[start]], 0, found[start])
        value = np.empty(len(t), np.uint8)
        value[order] = found
        last = np.r_[start[1:], len(t)] - 1
        np.minimum(self.since, low_all, out=self.since)
        after = at[last] + 1
        rest = np.full(len(last), MOST, np.uint8)
        inside = np.flatnonzero(after < len(near))
        if len(inside):
            rest[inside] = minima.between(after[inside], np.full(len(inside), len(near)))
        self.since[t[last]] = rest
        self.fresh[t[last]] = False
        self.queue.push(target, before, value)


class _String:
    """A string with what induction asks of it: types and buckets of its symbols."""

    def __init__(self, text: np.ndarray, chunk: int):
        self.text, self.chunk, n = text, chunk, len(text)
        self.rising = scratch(n, bool)
        self.top = 0
        later, symbol = False, None
        for b in range(n, 0, -chunk):
            a = max(0, b - chunk)
            t = np.asarray(text[a:b]).astype(np.int64)
            self.top = max(self.top, int(t.max()))
            nxt = np.r_[t[1:], t[-1] if symbol is None else symbol]
            differ = np.flatnonzero(t != nxt)
            rising = np.full(len(t), later)
            if len(differ):
                d = np.searchsorted(differ, np.arange(len(t)))
                known = d < len(differ)
                at = differ[d[known]]
                rising[known] = t[at] < nxt[at]
            self.rising[a:b] = rising
            later, symbol = bool(rising[0]), int(t[0])
        self.starts = self._buckets()

    def _buckets(self) -> np.ndarray:
        """First symbols of the buckets: one each for few symbols; else neighbours share one up to a chunk's entries."""
        if self.top < SINGLE:
            return np.arange(self.top + 1)
        counts = scratch(self.top + 1, np.int64)
        for a in range(0, len(self.text), self.chunk):
            s, k = np.unique(np.asarray(self.text[a : a + self.chunk]), return_counts=True)
            counts[s] += k
        out, held, limit = [], 0, max(256, min(self.chunk, len(self.text) // 64))
        for a in range(0, self.top + 1, self.chunk):
            part = np.asarray(counts[a : a + self.chunk])
            total = held + np.cumsum(part)
            # A bucket ends where its count passes another multiple of the limit, and around a symbol that has as many alone.
            new = np.r_[(total[0] // limit != held // limit) | (a == 0), total[1:] // limit != total[:-1] // limit]
            big = part > limit
            new |= big | np.r_[False, big[:-1]]
            out.append(a + np.flatnonzero(new))
            held = int(total[-1])
        return np.concatenate(out)

    def is_star(self, p: np.ndarray) -> np.ndarray:
        return (p > 0) & self.rising[p] & ~self.rising[p - 1]

    def run(self, p: int) -> int:
        """How often a suffix repeats its first symbol, up to MOST."""
        t = self.text[p : p + MOST]
        other = np.flatnonzero(t != t[0])
        return int(other[0]) if len(other) else len(t)


def _sweep(s: _String, up: bool, after, seed: int | None, rows: int, prefixes: bool, own) -> Iterator[Batch]:
    """Read all suffixes of one kind in order, bucket by bucket, and with them those of ``after``.

    up: symbols rise, and falling suffixes are found; else they fall, and rising ones are.
    after(bucket): batches that come behind the found ones of each symbol. seed: a first
    suffix that no other finds. own(bucket, positions, prefixes) gets the found ones; yielded
    is everything that is read, found ones first in each symbol.
    """
    text, top = s.text, s.top
    key = (lambda p: text[p].astype(np.int64)) if up else (lambda p: top - text[p].astype(np.int64))
    ends = np.r_[s.starts[1:], top + 1]
    starts = s.starts if up else (top + 1 - ends)[::-1]
    stops = np.r_[starts[1:], top + 1]
    work = _Induction(starts, top + 1, rows, prefixes)
    if seed is not None:
        first = np.array([seed])
        work.queue.push(key(first), first, np.zeros(1, np.uint8))
        if prefixes:
            work.fresh[key(first)] = False
            work.since[key(first)] = 0

    def read(p: np.ndarray, c: np.ndarray, mine: int, strict: bool) -> None:
        before = np.maximum(p - 1, 0)
        target = key(before)
        at = np.flatnonzero((p > 0) & (target >= mine + strict))
        work.scan(c, at, target[at], before[at])

    for b, (begin, end) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
        real = b if up else len(starts) - 1 - b
        if end - begin == 1:
            tail = None
            while (batch := work.queue.pop(b, s.chunk)) is not None:
                p, c = batch
                own(real, p, c)
                tail = int(p[-1])
                read(p, c, begin, False)
                yield p, c
            border = True
            for p, c in after(real):
                c = c.copy()
                if border:
                    c[0] = 0 if tail is None else min(s.run(tail), s.run(int(p[0])))
                    border = False
                read(p, c, begin, True)
                yield p, c
            continue
        # Several symbols: read as far as nothing that is found on the way comes in between.
        behind = [p for p, _ in after(real)]
        behind = np.concatenate(behind) if behind else np.zeros(0, np.int64)
        behind_key = key(behind)
        mine, mine_key = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            while (batch := work.queue.pop(b, s.chunk)) is not None:
                mine, mine_key = np.concatenate((mine, batch[0])), np.concatenate((mine_key, key(batch[0])))
            if not len(mine) and not len(behind):
                break
            p, k = np.concatenate((mine, behind)), np.concatenate((mine_key, behind_key))
            order = np.argsort(k, kind="stable")
            p, k, strict = p[order], k[order], order >= len(mine)
            before = np.maximum(p - 1, 0)
            target = key(before)
            take = (p > 0) & (target >= k + strict)
            stop = int(target[take].min(initial=end))
            if stop > k[0]:
                n = int(np.searchsorted(k, stop))
                rest_mine, rest_behind = mine_key >= stop, behind_key >= stop
            else:
                # The first symbol follows itself: its found ones alone, in rounds.
                n = int((mine_key == k[0]).sum())
                rest_mine, rest_behind = mine_key > k[0], np.ones(len(behind), bool)
            p, strict, take = p[:n], strict[:n], take[:n]
            zeros = np.zeros(n, np.uint8)
            own(real, p[~strict], zeros[~strict])
            work.queue.push(target[:n][take], before[:n][take], zeros[take])
            mine, mine_key, behind, behind_key = mine[rest_mine], mine_key[rest_mine], behind[rest_behind], behind_key[rest_behind]
            yield p, zeros
    work.queue.close()


def _induce(s: _String, stars: SymbolQueue, rows: int, prefixes: bool) -> Iterator[Batch]:
    """All suffixes from the last to the first, from stars in order (with their prefixes); each with its prefix with the one before it here."""
    falling, places = Tape(np.int64, np.uint8), {}

    def found(bucket: int, p: np.ndarray, c: np.ndarray) -> None:
        if len(p):
            places.setdefault(bucket, []).append(falling.write(p, c))

    def star_batches(bucket: int) -> Iterator[Batch]:
        while (batch := stars.pop(bucket, s.chunk)) is not None:
            yield batch

    for _ in _sweep(s, True, star_batches, len(s.text) - 1, rows, prefixes, found):
        pass

    def backwards(bucket: int) -> Iterator[Batch]:
        above = 0
        for place in reversed(places.pop(bucket, ())):
            p, c = falling.read(place)
            # Downwards, a suffix's prefix is with the one above it.
            yield p[::-1], np.r_[np.uint8(above), c[:0:-1]].astype(np.uint8)
            above = c[0]

    yield from _sweep(s, False, backwards, None, rows, prefixes, lambda *_: None)
    falling.close()


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that suffixes a[i] and b[i] share, up to MOST."""
    n = len(text)
    out = np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    for d in range(MOST):
        x, y = a[live] + d, b[live] + d
        same = (x < n) & (y < n)
        same[same] = text[x[same]] == text[y[same]]
        live = live[same]
        if not len(live):
            break
        out[live] = d + 1
    return out


def _ranked(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a short string, exact for at least MOST symbols, by doubling."""
    rank, step = np.asarray(names).astype(np.int64), 1
    while True:
        second = np.zeros(len(rank), np.int64)
        second[:-step] = rank[step:] + 1
        both = rank * (len(rank) + 1) + second if rank.max(initial=0) < 1 << 31 else None
        order = np.lexsort((second, rank)) if both is None else np.argsort(both, kind="stable")
        new = np.r_[False, (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])]
        rank = np.empty(len(names), np.int64)
        rank[order] = np.cumsum(new)
        step *= 2
        if step >= MOST or step >= len(names) or rank[order[-1]] == len(names) - 1:
            return order


def _forward(order: np.ndarray, chunk: int) -> Iterator[np.ndarray]:
    for a in range(0, len(order), chunk):
        yield np.asarray(order[a : a + chunk])


def _star_order(s: _String, stars: np.ndarray, rows: int, base_rows: int) -> np.ndarray:
    """Numbers of the stars (which stand in text order) in the order of their suffixes, in a scratch file."""
    text, m = s.text, len(stars)
    zeros = np.zeros(s.chunk, np.uint8)
    queue = SymbolQueue(s.starts, rows)
    for p in _forward(stars, s.chunk):
        queue.push(np.asarray(text[p]), p, zeros[: len(p)])
    order, left = scratch(m, np.int64), m
    for p, _ in _induce(s, queue, rows, False):
        p = p[s.is_star(p)]
        order[left - len(p) : left] = np.searchsorted(stars, p[::-1])
        left -= len(p)
    queue.close()
    # Equal substrings get one name. Each reaches to the next star; the last one's has no equal.
    names, name, before = scratch(m, np.int64), -1, None
    for at in _forward(order, s.chunk):
        pairs = at if before is None else np.r_[before, at]
        x, y = pairs[:-1], pairs[1:]
        size = np.asarray(stars[np.minimum(pairs + 1, m - 1)]) - stars[pairs] + 1
        same = (size[:-1] == size[1:]) & (x != m - 1) & (y != m - 1)
        a, b = np.asarray(stars[x]), np.asarray(stars[y])
        live, d = np.flatnonzero(same), 0
        while len(live):
            differ = text[a[live] + d] != text[b[live] + d]
            same[live[differ]] = False
            live = live[~differ]
            d += 1
            live = live[size[:-1][live] > d]
        step = ~same if before is not None else np.r_[True, ~same]
        value = name + np.cumsum(step)
        names[at] = value
        name, before = int(value[-1]), at[-1:]
    if name == m - 1:
        return order
    if m <= base_rows:
        return _ranked(names)
    left = m
    for p, _ in sorted_suffixes(names, rows, base_rows, False, s.chunk):
        order[left - len(p) : left] = p[::-1]
        left -= len(p)
    return order


def sorted_suffixes(text: np.ndarray, queue_rows: int = QUEUE_ROWS, base_rows: int = BASE_ROWS, prefixes: bool = True, chunk: int = CHUNK) -> Iterator[Batch]:
    """Batches (positions, prefixes): the suffixes of a string of small non-negative integers, the last one first.

    text may be a file mapped to memory. A prefix is what a suffix shares with the one that
    was given before it, up to MOST. Exact for the first MOST symbols: suffixes that share
    more may stand in any order.
    """
    n = len(text)
    if n == 0:
        return
    s = _String(text, chunk)
    marks = [a + np.flatnonzero(s.is_star(np.arange(a, min(n, a + chunk)))) for a in range(0, n, chunk)] if n <= chunk else None
    if marks is None:
        tape, places = Tape(np.int64), []
        for a in range(0, n, chunk):
            places.append(tape.write(a + np.flatnonzero(s.is_star(np.arange(a, min(n, a + chunk))))))
        stars, at = scratch(sum(k for _, k in places), np.int64), 0
        for place in places:
            stars[at : at + place[1]] = tape.read(place)[0]
            at += place[1]
        tape.close()
    else:
        stars = marks[0]
    order = _star_order(s, stars, queue_rows, base_rows) if len(stars) > 1 else np.arange(len(stars))
    queue, before = SymbolQueue(s.starts, queue_rows), None
    for at in _forward(order, chunk):
        p = np.asarray(stars[at])
        near = np.zeros(len(p), np.uint8)
        if prefixes:
            near[1:] = _common(text, p[:-1], p[1:])
            if before is not None:
                near[0] = _common(text, before, p[:1])[0]
        queue.push(np.asarray(text[p]).astype(np.int64), p, near)
        before = p[-1:]
    yield from _induce(s, queue, queue_rows, prefixes)
    queue.close()


def sort_suffixes(text: np.ndarray, queue_rows: int = QUEUE_ROWS, base_rows: int = BASE_ROWS, prefixes: bool = True, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(order, near): suffixes in order as arrays, and each one's common prefix with the one before."""
    parts = list(sorted_suffixes(np.asarray(text, np.int64), queue_rows, base_rows, prefixes, chunk))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    down, near = np.concatenate([p for p, _ in parts]), np.concatenate([c for _, c in parts])
    return down[::-1], np.r_[np.uint8(0), near[:0:-1]].astype(np.uint8)
