"""Suffix-array deduplication: bytes of long strings that also start earlier are removed.

A window of LENGTH bytes is dealt by its least gram (its anchor), so equal windows meet
wherever they are. Runs of windows with one anchor are segments. Hashes only tell which
segments may share a window with another; the bytes of those go to shards, where equal ones
are compared byte by byte and the others are sorted by their suffixes.

Hot anchors: a task sends at most FEW segments of an anchor; the rest, and those of all
anchors that any task has so marked or that have more than HOT, go on by the bytes they
share around the anchor (cores), counted by a grouped aggregation. Cores with more than HOT
segments are cut into single windows. Equal bytes are kept once by every task that sends them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import KEPT, by_bytes, forget, join_hot, keep, lean, release_shuffles, small_batches, utf8_buffer
from .suffix import Tape, scratch, sorted_suffixes

#: Bytes of a string whose repetition counts; common prefixes are counted up to this.
LENGTH = 100
#: Bytes of the grams that anchor windows.
GRAM = 32
#: Windows of an anchor that share a core, by how far they begin before it: the bytes all of them have.
STEP = 18
CORES = -(-(LENGTH - GRAM + 1) // STEP)
#: Different segments of an anchor that a slice sends by the anchor; more go by their cores.
FEW = 8
#: Segments of an anchor, or of a core, from which on they are split.
HOT = 1000
SLICE = 1 << 20
POSITION_BITS = 22
BUCKET_SEGMENTS = 100_000
SHARD_BYTES = 512 << 10
#: Bytes of pieces that a task compares before it sends them.
HELD = 8 << 20
NO_ID = -(2**63)

BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []
KEPT["repeats"] = _POWERS

ENTRY = np.dtype([("value", "<u8"), ("core", "<u4", (CORES,)), ("doc", "<i8"), ("text", "<i8"), ("start", "<u4"), ("reach", "u1"), ("windows", "u1")])
SPAN = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<u4"), ("length", "<u4")])
PIECE = np.dtype([("key", "<i8"), ("doc", "<i8"), ("text", "<i8"), ("start", "<u4"), ("length", "<u4")])
PLACE = ["doc", "text", "start"]
#: What a row of decisions says.
IS_SPAN, IS_PIECE, IS_CORE = 0, 1, 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(int(BASE), -1, 1 << 64)
        _POWERS[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (BASE, np.uint64(inverse))]
    return _POWERS[0], _POWERS[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xA0761D6478BD642F)
    return h ^ h >> np.uint64(32)


class Hashed:
    """Hashes of any range of a byte string from one prefix sum."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _powers(max(len(data) + 1, SLICE + (64 << 10)))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64))

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def segments(h: Hashed, begin: np.ndarray, end: np.ndarray) -> dict[str, np.ndarray]:
    """Maximal runs of windows of LENGTH bytes with the same anchor: their first least gram.

    The hashed data is cut into texts [begin, end); windows stay within one. A window's anchor
    is found by its bytes alone, so equal windows have equal anchors, at the same distance.
    Returned per segment: text, first window, number of windows, anchor hash and position.
    """
    n, width = len(h.sums) - 1, LENGTH - GRAM + 1
    empty = np.zeros(0, np.int64)
    if n < LENGTH:
        return {"text": empty, "start": empty, "windows": empty, "value": empty.astype(np.uint64), "anchor": empty}
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = h.grams(GRAM)
    least &= ~low
    least |= np.arange(n - GRAM + 1, dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    there = np.zeros(len(least) + 1, np.int32)
    long = end - begin >= LENGTH
    np.add.at(there, begin[long], 1)
    np.add.at(there, end[long] - LENGTH + 1, -1)
    there = np.cumsum(there[:-1]) > 0
    new = np.r_[True, least[1:] != least[:-1]] | np.r_[True, ~there[:-1]]
    start = np.flatnonzero(there & new)
    stop = np.flatnonzero(there & np.r_[new[1:] | ~there[1:], True]) + 1
    chosen = least[start]
    return {"text": np.searchsorted(begin, start, side="right") - 1, "start": start, "windows": stop - start, "value": chosen >> np.uint64(POSITION_BITS), "anchor": (chosen & low).astype(np.int64)}


def _core_windows(first: np.ndarray, reach: np.ndarray, windows: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a segment has windows of a core, the first of them, how many); reach: how far its first window begins before the anchor."""
    far = np.minimum(reach, min(STEP * core + STEP - 1, LENGTH - GRAM))
    near = np.maximum(reach - windows + 1, STEP * core)
    return far >= near, first + reach - far, far - near + 1


def _entries(data: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray, text: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ENTRY rows, first bytes, content hashes) of the segments of some texts; offset: where each begins in its document."""
    h = Hashed(data)
    s = segments(h, begin, end)
    first, windows, anchor = s["start"], s["windows"], s["anchor"]
    out = np.zeros(len(first), ENTRY)
    if not len(out):
        return out, first, s["value"]
    reach = anchor - first
    for core in range(CORES):
        has, _, _ = _core_windows(first, reach, windows, core)
        at = anchor[has] - STEP * core
        stop = anchor[has] - min(STEP * core + STEP - 1, LENGTH - GRAM) + LENGTH
        out["core"][has, core] = (h.of(at, stop) | np.uint64(1)).astype(np.uint32)
    of = s["text"]
    out["value"], out["doc"], out["text"] = s["value"], doc[of], text[of]
    out["start"], out["reach"], out["windows"] = first - begin[of] + offset[of], reach, windows
    return out, first, h.of(first, first + windows + LENGTH - 1)


def _flat(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Positions of all bytes of some ranges."""
    return np.arange(int(length.sum())) + np.repeat(begin - (np.cumsum(length) - length), length)


def _blocks(length: np.ndarray, most: int = 1 << 20):
    """Slices of rows with about ``most`` bytes in all."""
    ends = np.cumsum(length)
    at = 0
    while at < len(length):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield slice(at, stop)
        at = stop


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the bytes of two ranges are the same, pair by pair."""
    out = np.zeros(len(a), bool)
    for part in _blocks(length):
        n = length[part]
        same = data[_flat(a[part], n)] == data[_flat(b[part], n)]
        out[part] = np.logical_and.reduceat(same, np.cumsum(n) - n)
    return out


def _content(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of short ranges."""
    power, _ = _powers(SLICE + (64 << 10))
    out = np.zeros(len(begin), np.uint64)
    for part in _blocks(length):
        n = length[part]
        first = np.cumsum(n) - n
        out[part] = _mixed(np.add.reduceat((data[_flat(begin[part], n)].astype(np.uint64) + np.uint64(1)) * power[_flat(np.zeros(len(n), np.int64), n)], first) + n.astype(np.uint64))
    return out


def _collapsed(rows: np.ndarray, key: str, data: np.ndarray, begin: np.ndarray, length: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows that are the first with their bytes, in order of key; spans of those that repeat an earlier place).

    Equal hashes are not believed: the bytes are compared. Rows of one place are one.
    """
    order = np.lexsort((rows["start"], rows["text"], rows["doc"], length, content, rows[key]))
    k, c, n = rows[key][order], content[order], length[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (n[1:] != n[:-1])
    at = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    again = np.flatnonzero(~new)
    if len(again):
        same = _equal(data, begin[order[again]], begin[order[at[again]]], n[again])
        new[again[~same]] = True
        again = again[same]
    late, head = rows[order[again]], rows[order[at[again]]]
    later = np.any([late[c] != head[c] for c in PLACE], axis=0) if len(again) else np.zeros(0, bool)
    return order[new], _spans(late[later]["doc"], late[later]["text"], late[later]["start"], n[again][later])


def _spans(doc: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """SPAN rows; spans of a document that touch are one."""
    order = np.lexsort((start, text, doc))
    doc, text, start = doc[order], text[order], start[order].astype(np.int64)
    end = start + length[order]
    if not len(doc):
        return np.zeros(0, SPAN)
    other = np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]
    # The furthest end so far within the document: ends grow by an offset for each document.
    shift = (np.cumsum(other) - 1) * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + shift) - shift
    new = other | np.r_[True, start[1:] > far[:-1]]
    at = np.flatnonzero(new)
    out = np.zeros(len(at), SPAN)
    out["doc"], out["text"], out["start"] = doc[at], text[at], start[at]
    out["length"] = far[np.r_[at[1:], len(doc)] - 1] - start[at]
    return out


def _texts(batch: pa.RecordBatch, most: int):
    """Slices of at most ``most`` bytes of a batch of (doc, text hash, text); a longer text goes in pieces that share LENGTH - 1 bytes."""
    raw, ends = utf8_buffer(batch.column(2))
    doc, text = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    for i in range(batch.num_rows if batch.num_rows == 1 and len(raw) > most else 0):
        for at in range(0, len(raw), most):
            yield raw[at : at + most + LENGTH - 1], np.zeros(1, np.int64), np.array([min(len(raw) - at, most + LENGTH - 1)]), doc, text, np.array([at])
        return
    yield raw, ends[:-1], ends[1:], doc, text, np.zeros(len(doc), np.int64)


def _packed(bucket: np.ndarray, kind: int, rows: np.ndarray) -> pa.RecordBatch:
    """Blobs of rows by bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, rows = bucket[order], rows[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    data = [rows[a:b].tobytes() for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), pa.array(np.full(len(cuts), kind, np.int8)), pa.array(data, pa.binary())], names=["bucket", "kind", "blob"])


def _counts(key: np.ndarray) -> np.ndarray:
    """How many rows have each row's key; equal keys stand together."""
    new = np.r_[True, key[1:] != key[:-1]]
    at = np.flatnonzero(new)
    return np.diff(np.r_[at, len(key)])[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)


def _spread(rows: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed((rows["text"] ^ rows["doc"]).view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _deal(buckets: int, few: int, size: int):
    """Blobs of different segments by bucket of their anchor, of those of frequent anchors by nothing, and of spans already known."""

    def run(batches):
        for batch in by_bytes(batches, "text", size, 20_000):
            for part in _texts(batch, size):
                rows, first, content = _entries(*part)
                if not len(rows):
                    continue
                firsts, spans = _collapsed(rows, "value", part[0], first, rows["windows"].astype(np.int64) + LENGTH - 1, content)
                rows = rows[firsts]
                frequent = _counts(rows["value"]) > few
                sent = rows[~frequent]
                if frequent.any():
                    value = np.unique(rows["value"][frequent])
                    marks = np.zeros(len(value), ENTRY)
                    marks["value"] = value
                    sent = np.concatenate([sent, marks])
                    yield _packed(_spread(rows[frequent], buckets), IS_CORE, rows[frequent])
                yield _packed((sent["value"] % np.uint64(buckets)).astype(np.int64), IS_PIECE, sent)
                if len(spans):
                    yield _packed(_spread(spans, buckets), IS_SPAN, spans)

    return run


def _by_key(batches, key: str):
    """Tables of all rows of one key after another, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cuts = [*np.flatnonzero(k[1:] != k[:-1]).tolist(), len(k) - 1]
        at = 0
        for c in cuts:
            if held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() != int(k[at]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, c + 1 - at))
            at = c + 1
    if held:
        yield pa.Table.from_batches(held)


DECISIONS = "kind byte, key long, doc long, text long, start long, length long"


def _decided(kind: int, key: np.ndarray | None, doc, text, start, length) -> pa.RecordBatch:
    n = len(doc)
    keys = pa.nulls(n, pa.int64()) if key is None else pa.array(key.view(np.int64) if key.dtype == np.uint64 else key)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), keys, *(pa.array(x.astype(np.int64)) for x in (doc, text, start, length))], names=["kind", "key", "doc", "text", "start", "length"])


def _core_rows(e: np.ndarray):
    """Decisions still to be made: the windows of a segment that share a core, with the core's key."""
    reach, windows = e["reach"].astype(np.int64), e["windows"].astype(np.int64)
    for core in range(CORES):
        has, first, n = _core_windows(e["start"].astype(np.int64), reach, windows, core)
        part = e[has]
        if len(part):
            key = _mixed(part["value"] + _mixed(part["core"][:, core].astype(np.uint64) * np.uint64(CORES) + np.uint64(core)))
            yield _decided(IS_CORE, key, part["doc"], part["text"], first[has], n[has] + LENGTH - 1)


def _weigh(most: int):
    """Decisions of a bucket: which segments may share a window with another, as they agree on all that some window of theirs has around the anchor."""

    def run(batches):
        for table in _by_key(batches, "bucket"):
            kinds = table.column("kind").to_numpy()
            blobs = table.column("blob").to_pylist()
            data = {k: b"".join(b for b, kind in zip(blobs, kinds.tolist(), strict=True) if kind == k) for k in (IS_SPAN, IS_PIECE, IS_CORE)}
            del blobs, table
            s = np.frombuffer(data[IS_SPAN], SPAN)
            if len(s):
                yield _decided(IS_SPAN, None, s["doc"], s["text"], s["start"], s["length"])
            yield from _core_rows(np.frombuffer(data[IS_CORE], ENTRY))
            e = np.frombuffer(data[IS_PIECE], ENTRY)
            if not len(e):
                continue
            e = e[np.argsort(e["value"], kind="stable")]
            group = np.cumsum(np.r_[False, e["value"][1:] != e["value"][:-1]])
            hot = (np.bincount(group, e["windows"] == 0) > 0)[group] | (_counts(e["value"]) > most)
            yield from _core_rows(e[hot & (e["windows"] > 0)])
            e, group = e[~hot], group[~hot]
            shared = np.zeros(len(e), bool)
            for core in range(CORES):
                at = np.flatnonzero(e["core"][:, core])
                both = group[at].astype(np.uint64) << np.uint64(32) | e["core"][at, core]
                order = np.argsort(both, kind="stable")
                same = both[order][1:] == both[order][:-1]
                shared[at[order[1:][same]]] = True
                shared[at[order[:-1][same]]] = True
            e = e[shared]
            if len(e):
                yield _decided(IS_PIECE, e["value"], e["doc"], e["text"], e["start"], e["windows"].astype(np.int64) + LENGTH - 1)

    return run


def _parcels(shards: int, rows: np.ndarray, data: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
    """Blobs by shard of the key: how many pieces, their rows, and their bytes one after another, compressed."""
    shard = (_mixed(rows["key"].view(np.uint64)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    shard, rows, begin = shard[order], rows[order], begin[order]
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]).tolist()
    length = rows["length"].astype(np.int64)
    flat = data[_flat(begin, length)]
    at = np.r_[0, np.cumsum(length)]
    pack = zstandard.ZstdCompressor(level=1).compress
    blobs = [np.array([b - a], "<u4").tobytes() + rows[a:b].tobytes() + pack(flat[at[a] : at[b]].data) for a, b in zip(cuts, [*cuts[1:], len(shard)], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(shard[cuts].astype(np.int32)), pa.array(np.full(len(cuts), IS_PIECE, np.int8)), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"])


def _cut(shards: int):
    """Bytes of the segments that must be compared, by shard; those of very common cores window by window. Equal ones go once."""

    def send(rows: list[np.ndarray], data: list[np.ndarray]):
        rows_all, data_all = np.concatenate(rows), np.concatenate(data)
        length = rows_all["length"].astype(np.int64)
        begin = np.cumsum(length) - length
        firsts, spans = _collapsed(rows_all, "key", data_all, begin, length, _content(data_all, begin, length))
        yield _parcels(shards, rows_all[firsts], data_all, begin[firsts])
        if len(spans):
            yield _packed(_spread(spans, shards), IS_SPAN, spans)

    def run(batches):
        held_rows, held_data, size = [], [], 0
        for batch in by_bytes(batches, "bytes", 1 << 20):
            raw, ends = utf8_buffer(batch.column(2))
            lists = batch.column(3).combine_chunks() if isinstance(batch.column(3), pa.ChunkedArray) else batch.column(3)
            wanted = lists.flatten()
            key, start, length, split = (wanted.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            many = np.where(split, length - LENGTH + 1, 1)
            pick = np.repeat(np.arange(len(key)), many)
            turn = np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many)
            rows = np.zeros(len(pick), PIECE)
            rows["start"] = start[pick] + turn
            rows["length"] = np.where(split[pick], LENGTH, length[pick])
            rows["doc"], rows["text"] = (batch.column(c).to_numpy()[of[pick]] for c in (0, 1))
            begin = ends[of[pick]] + rows["start"]
            rows["key"] = key[pick]
            cut = np.flatnonzero(split[pick])
            if len(cut):
                rows["key"][cut] = _content(raw, begin[cut], np.full(len(cut), LENGTH)).view(np.int64)
            for part in _blocks(rows["length"].astype(np.int64), HELD):
                held_rows.append(rows[part])
                held_data.append(raw[_flat(begin[part], rows["length"][part].astype(np.int64))])
                size += len(held_data[-1])
                if size >= HELD:
                    yield from send(held_rows, held_data)
                    held_rows, held_data, size = [], [], 0
        if size:
            yield from send(held_rows, held_data)

    return run


def late_windows(text: np.ndarray, chunk: int | None = None) -> np.ndarray:
    """For each position of a text (its symbols over 0, pieces parted by 0): whether the window there is not the first of its kind.

    Suffixes are read in order; neighbours with a common prefix of a whole window form a
    group, of which all but the first place are late. The result lies in a scratch file.
    """
    late, first = scratch(len(text), bool), -1
    for p, near in sorted_suffixes(text, **({"chunk": chunk} if chunk else {})):
        heads = np.flatnonzero(near < LENGTH)
        begin = int(heads[0]) if len(heads) else len(p)
        if begin:
            least = min(first, int(p[:begin].min()))
            late[p[:begin]] = late[first] = True
            late[least] = False
            first = least
        if len(heads):
            least = np.minimum.reduceat(p, heads)
            late[p[begin:]] = True
            late[least] = False
            first = int(least[-1])
    return late


class Shard:
    """Pieces of one shard: their bytes go to a scratch file as they come, their rows stay."""

    def __init__(self):
        self.rows: list[np.ndarray] = []
        self.tape, self.size = Tape(np.uint8), 0

    def add(self, blob: bytes) -> None:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        self.rows.append(np.frombuffer(blob, PIECE, n, 4))
        data = zstandard.ZstdDecompressor().decompress(memoryview(blob)[4 + n * PIECE.itemsize :])
        self.size += self.tape.write(np.frombuffer(data, np.uint8))[1]

    def spans(self):
        """Spans of all windows that come before, in SPAN batches."""
        if not self.rows:
            return
        rows = np.concatenate(self.rows)
        self.tape.file.flush()
        data = np.memmap(self.tape.file, np.uint8, "r", shape=(self.size,)).view(np.ndarray)
        length = rows["length"].astype(np.int64)
        begin = np.cumsum(length) - length
        firsts, spans = _collapsed(rows, "key", data, begin, length, _content(data, begin, length))
        if len(spans):
            yield spans
        # Windows of one piece differ, and a key's only piece shares none.
        firsts = firsts[_counts(rows["key"][firsts]) > 1]
        if len(firsts):
            yield from self._sorted(rows[firsts], data, begin[firsts])
        self.tape.close()

    @staticmethod
    def _sorted(rows: np.ndarray, data: np.ndarray, begin: np.ndarray):
        order = np.lexsort([rows[c] for c in reversed(PLACE)])
        rows, begin = rows[order], begin[order]
        length = rows["length"].astype(np.int64)
        first = np.cumsum(length + 1) - length - 1
        text = scratch(int(length.sum()) + len(rows), np.uint16)
        for part in _blocks(length):
            text[_flat(first[part], length[part])] = data[_flat(begin[part], length[part])].astype(np.uint16) + 1
        late = late_windows(text)
        for part in _blocks(length):
            n = length[part] - LENGTH + 1
            is_late = late[_flat(first[part], n)]
            cuts = np.cumsum(n) - n
            edge = np.r_[False, is_late[:-1]]
            edge[cuts] = False
            at = np.flatnonzero(is_late & ~edge)
            stop = np.r_[is_late[1:], False]
            stop[cuts + n - 1] = False
            end = np.flatnonzero(is_late & ~stop) + 1
            owner = np.searchsorted(cuts, at, side="right") - 1
            r = rows[part][owner]
            yield _spans(r["doc"], r["text"], r["start"] + at - cuts[owner], end - at + LENGTH - 1)


def _sorted_shards(batches):
    """Spans of late windows: equal pieces by their bytes, others from the suffix array of their shard."""
    shard, number = Shard(), None

    def told(s: np.ndarray) -> pa.RecordBatch:
        return _decided(IS_SPAN, None, s["doc"], s["text"], s["start"], s["length"])

    for batch in batches:
        for bucket, kind, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if kind == IS_SPAN:
                yield told(np.frombuffer(blob, SPAN))
                continue
            if bucket != number:
                for s in shard.spans():
                    yield told(s)
                shard, number = Shard(), bucket
            shard.add(blob)
    for s in shard.spans():
        yield told(s)


def _finish(keep_text: bool):
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for batch in by_bytes(batches, "text", 2 << 20):
            raw, ends = utf8_buffer(batch.column(batch.schema.get_field_index("text")))
            lists = batch.column(batch.schema.get_field_index("spans"))
            flat, cuts = lists.flatten(), lists.offsets.to_numpy()
            begins = flat.field(0).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
            lengths = flat.field(1).to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
            valid = np.asarray(lists.is_valid())
            rows, kept = [], []
            at = 0
            for i in range(batch.num_rows):
                text = raw[ends[i] : ends[i + 1]]
                size = int(cuts[i + 1] - cuts[i]) if valid[i] else 0
                removed = spans = 0
                if size:
                    b, n = begins[at : at + size], lengths[at : at + size]
                    at += size
                    level = np.zeros(len(text) + 1, np.int32)
                    np.add.at(level, b, 1)
                    np.add.at(level, b + n, -1)
                    gone = np.cumsum(level[:-1]) > 0
                    removed, spans = int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    text = text[~gone]
                body = text.tobytes()
                rows.append((int(ends[i + 1] - ends[i]), removed, spans, hashlib.sha256(body).hexdigest()))
                if keep_text:
                    kept.append(body.decode("utf-8", "ignore"))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            out, fields = [batch.column(batch.schema.get_field_index("row")), *columns], ["row", *names]
            if keep_text:
                out, fields = [*out, pa.array(kept, pa.string())], [*fields, "kept"]
            yield pa.RecordBatch.from_arrays(out, names=fields)

    return run


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, text, start, length) of all spans to remove, overlaps included, in a written table; docs has doc, text (a hash) and bytes."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    buckets = max(partitions, -(-total // (36 * BUCKET_SEGMENTS)))
    blobs = docs.where(F.octet_length("bytes") >= LENGTH).select("doc", F.col("text").alias("hash"), F.col("bytes").alias("text")).mapInArrow(lean(_deal(buckets, FEW, SLICE), "repeats"), "bucket int, kind byte, blob binary")
    decided = keep(blobs.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_weigh(HOT), "repeats"), DECISIONS))
    fields = ["doc", "text", "start", "length"]
    spans = decided.where(F.col("kind") == IS_SPAN).select(*fields)
    cores = decided.where(F.col("kind") == IS_CORE).select("key", *fields)
    shared = keep(cores.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("n")).where("n > 1"))
    wanted = decided.where(F.col("kind") == IS_PIECE).select("key", *fields, F.lit(False).alias("split"))
    wanted = wanted.unionByName(join_hot(cores, shared, "key", "_key").select("key", *fields, (F.col("n") > HOT).alias("split")))
    size = decided.where(F.col("kind") != IS_SPAN).agg(F.sum("length")).first()[0] or 0
    if not size:
        return spans
    release_shuffles(spark)
    shards = max(partitions, -(-size // SHARD_BYTES))
    lists = wanted.groupBy("doc", "text").agg(F.collect_list(F.struct("key", "start", "length", "split")).alias("wanted"))
    pieces = docs.join(lists, ["doc", "text"]).select("doc", "text", "bytes", "wanted").mapInArrow(lean(_cut(shards), "repeats"), "bucket int, kind byte, blob binary")
    found = pieces.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_sorted_shards, "repeats"), DECISIONS).select(*fields)
    out = keep(spans.unionByName(found))
    forget(decided, shared)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """All rows of docs as ``row`` with n_bytes, n_removed, n_spans and kept_sha256 (and the kept text, if asked for).

    A byte goes if a string of LENGTH bytes around it also starts earlier: in a document
    with a smaller id, or sooner in the same one. Texts move between executors twice, by id.

    Defined cases: null texts are empty, texts under LENGTH bytes lose nothing; a null id
    comes before all others; rows that share an id come in the order of their text's XXH64,
    rows equal in both are one document; an empty table gives no rows. A kept text drops
    the ends of characters that a removed span has cut.
    """
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * keep_text
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(row.alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), text.alias("bytes")).withColumn("text", F.xxhash64("bytes"))
    spans = repeated_spans(small_batches(rows).select("doc", "text", "bytes"))
    lists = spans.groupBy("doc", "text").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.join(lists, ["doc", "text"], "left").select("row", F.col("bytes").alias("text"), "spans").mapInArrow(lean(_finish(keep_text), "repeats"), f"row {kind}, {fields}")


def repeats_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    out = remove_repeats(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their repeated bytes removed, all columns kept; a null text stays null."""
    out = remove_repeats(docs, id_col, text_col, keep_text=True)
    columns = [F.col("kept").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*columns)
