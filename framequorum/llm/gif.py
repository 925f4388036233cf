"""GIF media: LZW streams, palettes, disposal and transparency, timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, small_batches, utf8_buffer

WIDTH = 192
FRAME_ROWS = 256
DELAY_CS = 4
MAX_CODES = 4096
GREY = bytes(v for v in range(256) for _ in range(3))


def _widths(least: int, n: int) -> np.ndarray:
    """Bits of the j-th code after a clear code: the table has 2**least + 2 + max(0, j - 1) entries then."""
    size = (1 << least) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.floor(np.log2(size)).astype(np.int64) + 1, least + 1, 12)


_SCHEDULES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _schedule(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths after a clear code, and the bits before each code."""
    if least not in _SCHEDULES:
        w = _widths(least, 2 * MAX_CODES)
        _SCHEDULES[least] = w, np.r_[0, np.cumsum(w)]
    return _SCHEDULES[least]


def lzw_encode(data: bytes, least: int = 8) -> bytes:
    """Variable-width LZW codes of data (samples below 2**least), first a clear code, last the end code."""
    clear, end = 1 << least, (1 << least) + 1
    codes: list[int] = []
    resets = [0]
    emit = codes.append
    table: dict[int, int] = {}
    get, fresh = table.get, end + 1
    emit(clear)
    if data:
        prefix = data[0]
        for sample in data[1:]:
            key = prefix << 8 | sample
            code = get(key)
            if code is not None:
                prefix = code
                continue
            emit(prefix)
            prefix = sample
            if fresh < MAX_CODES:
                table[key] = fresh
                fresh += 1
            if fresh == MAX_CODES:
                resets.append(len(codes))
                emit(clear)
                table = {}
                get, fresh = table.get, end + 1
        emit(prefix)
    emit(end)
    value = np.array(codes, dtype=np.int64)
    # A clear code has the width that the run it ends has reached; the first one has the least.
    starts = np.array(resets, dtype=np.int64) + 1
    place = np.arange(len(value))
    since = place - starts[np.searchsorted(starts, place, side="right") - 1]
    since[0] = 0
    width = _schedule(least)[0][since]
    at = np.r_[0, np.cumsum(width)]
    value <<= at[:-1] & 7
    byte, n = at[:-1] >> 3, (int(at[-1]) + 7) // 8
    out = sum(np.bincount(byte + k, (value >> 8 * k) & 255, n + 3) for k in range(3))
    return out[:n].astype(np.uint8).tobytes()


def _expand(codes: np.ndarray, least: int) -> np.ndarray:
    """Samples of the codes between two clear codes.

    The entry made after code k is k's string and the first sample of the next, that is a
    slice of the output itself. So each output position points to an earlier one, and
    pointer doubling ends at literal codes.
    """
    first = (1 << least) + 2
    index = np.arange(len(codes))
    literal = codes < first
    parent = np.where(literal, index, codes - first)
    if (parent[~literal] >= index[~literal]).any():
        raise ValueError("a code names an entry that does not exist yet")
    length, up = (~literal).astype(np.int64), parent
    while True:
        if (up == up[up]).all():
            length += np.where(up != index, length[up], 0)
            break
        length, up = length + np.where(up != index, length[up], 0), up[up]
    length += 1
    begin = np.cumsum(length) - length
    source = np.arange(int(length.sum()), dtype=np.int32) - np.repeat(begin - begin[parent], length).astype(np.int32)
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    return np.repeat(codes, length).astype(np.uint8)[source]


def lzw_decode(stream: bytes, least: int, pixels: int) -> np.ndarray:
    """Up to ``pixels`` samples from a code stream; a stream that ends early is padded with zeros."""
    clear, end = 1 << least, (1 << least) + 1
    raw = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8)
    bits, at, parts, have = 8 * len(stream), 0, [], 0
    widths, before = _schedule(least)
    while at < bits and have < pixels:
        n, chunk = 0, []
        stop = None
        while stop is None:
            span = slice(n, n + 2 * MAX_CODES) if n == 0 else None
            width = widths if span else np.full(MAX_CODES, 12)
            start = at + (before[:-1] if span else 12 * np.arange(MAX_CODES))
            start = start[start + width <= bits]
            if not len(start):
                at, stop = bits, end
                break
            width = width[: len(start)]
            byte = start >> 3
            word = raw[byte].astype(np.int64) | raw[byte + 1].astype(np.int64) << 8 | raw[byte + 2].astype(np.int64) << 16
            code = word >> (start & 7) & ((1 << width) - 1)
            marks = np.flatnonzero((code == clear) | (code == end))
            take = int(marks[0]) if len(marks) else len(code)
            chunk.append(code[:take])
            n += take
            if len(marks):
                stop = int(code[take])
                at = int(start[take] + width[take])
            else:
                at = int(start[-1] + width[-1])
        codes = np.concatenate(chunk) if chunk else np.zeros(0, np.int64)
        if len(codes):
            parts.append(_expand(codes, least))
            have += len(parts[-1])
        if stop == end:
            break
    out = np.concatenate(parts)[:pixels] if parts else np.zeros(0, np.uint8)
    return np.r_[out, np.zeros(pixels - len(out), np.uint8)] if len(out) < pixels else out


@dataclass
class Frame:
    """One timed picture: the whole canvas after this frame was drawn, and what was drawn."""

    canvas: np.ndarray
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int

    def drawn(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]

    def histogram(self) -> np.ndarray:
        """Pixels by red, green and blue level, 8 bins each."""
        return np.stack([np.bincount(self.canvas[..., c].ravel() >> 5, minlength=8) for c in range(3)])


def encode_gif(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """An animated GIF whose samples are the payload: rows of ``width`` under a grey palette."""
    rows = len(payload) // width
    if rows == 0 or rows * width != len(payload):
        raise ValueError("the payload must be a positive multiple of the width")
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0), GREY, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for top in range(0, rows, frame_rows):
        n = min(frame_rows, rows - top)
        stream = lzw_encode(payload[top * width : (top + n) * width])
        out += [struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay_cs, 0, 0), struct.pack("<BHHHHB", 0x2C, 0, 0, width, n, 0), b"\x08"]
        out += [bytes([len(part)]) + part for part in (stream[i : i + 255] for i in range(0, len(stream), 255))]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, packed: int) -> tuple[np.ndarray | None, int]:
    if not packed & 0x80:
        return None, at
    n = 3 << (packed & 7) + 1
    table = np.zeros((256, 3), np.uint8)
    table[: n // 3] = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
    return table, at + n


def decode_gif(data: bytes):
    """Yield the frames of a GIF in order, composed by its disposal and transparency rules.

    Disposal 0 and 1 leave the drawing, 2 clears its area to transparent black, 3 restores
    what was there before; samples of the transparent index leave the canvas as it is;
    interlaced rows are put in order. Raises ValueError for data that is no GIF.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, packed = struct.unpack_from("<HHB", data, 6)
    shared, at = _palette(data, 13, packed)
    canvas = np.zeros((height, width, 3), np.uint8)
    delay = disposal = 0
    clear: int | None = None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            block, at = _blocks(data, at + 2)
            if label == 0xF9 and len(block) >= 4:
                disposal, delay = block[0] >> 2 & 7, block[1] | block[2] << 8
                clear = block[3] if block[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, packed)
        least = data[at]
        stream, at = _blocks(data, at + 1)
        samples = lzw_decode(stream, least, w * h).reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            samples = samples[np.argsort(order)]
        colours = own if own is not None else shared if shared is not None else np.zeros((256, 3), np.uint8)
        before = canvas.copy() if disposal == 3 else None
        area = canvas[top : top + h, left : left + w]
        samples = samples[: area.shape[0], : area.shape[1]]
        drawn = colours[samples]
        area[...] = drawn if clear is None else np.where((samples == clear)[..., None], area, drawn)
        yield Frame(canvas.copy(), left, top, area.shape[1], area.shape[0], delay, disposal)
        if disposal == 2:
            area[...] = 0
        elif before is not None:
            canvas = before
        delay = disposal = 0
        clear = None


def padded(text: bytes, multiple: int = WIDTH) -> bytes:
    return text + b" " * (multiple - len(text) % multiple if len(text) % multiple or not text else 0)


def _archive(keep_media: bool):
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"]

    def row(text: bytes) -> tuple:
        media = encode_gif(padded(text))
        back, frames, total = [], [], np.zeros((3, 8), np.int64)
        for frame in decode_gif(media):
            back.append(frame.drawn()[..., 0].tobytes())
            total += (h := frame.histogram())
            frames.append({"delay_ms": 10 * frame.delay_cs, "width": frame.width, "height": frame.height, "histogram": h.ravel().tolist()})
        payload = b"".join(back)
        feature = f"frames={len(frames)};ms={sum(f['delay_ms'] for f in frames)};rows={sum(f['height'] for f in frames)};" + "|".join(",".join(map(str, c)) for c in total.tolist())
        return (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, frames, media)

    def run(batches):
        for batch in by_bytes(batches, "text"):
            raw, offsets = utf8_buffer(batch.column(1))
            raw = raw.tobytes()
            columns = list(zip(*(row(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), strict=True))
            long, text = pa.int64(), pa.string()
            kinds = [long, long, text, long, long, text, text, pa.list_(pa.struct([("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))]))]
            out = [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))]
            fields = ["doc_id", *names]
            if keep_media:
                out, fields = [*out, pa.array(columns[-1], pa.binary())], [*fields, "media"]
            yield pa.RecordBatch.from_arrays(out, names=fields)

    return run


def archive_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Store every text as an animated GIF, read it back, and describe its frames.

    The text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are the
    samples. All figures of the payload come from the decoded frames. ``frames`` has delay,
    size and colour histogram of each; ``media`` holds the stored bytes.

    Defined cases: a null text is empty; an empty one is one row of spaces; long texts have
    several frames of 256 rows; equal texts give equal values; an empty table gives no rows.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<delay_ms: int, width: int, height: int, histogram: array<long>>>" + ", media binary" * keep_media
    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_archive(keep_media), schema)
