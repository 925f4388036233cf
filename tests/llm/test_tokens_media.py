import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
import sentencepiece

from framequorum.llm import gif, pieces as P

from .conftest import prose

MODEL = open(P.MODEL_PATH, "rb").read()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@pytest.fixture(scope="module")
def mine():
    return P.Pieces(MODEL)


def texts():
    rng = random.Random(8)
    pools = ["ab ", "the  an in", "aeiou stn ", "日本a ", "▁ a", "\n\tx ", "abcdefghijklmnopqrstuvwxyz ", "()<>=_-", " ", "😀é "]
    out = ["", " ", "<s>", "<0x41>", "a" * 500, " " * 50, "antidisestablishment" * 200, prose(4, 300)]
    return out + ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.choice([1, 5, 30, 200]))) for _ in range(400)] + ["".join(rng.choice(p) for _ in range(60)) for p in pools for _ in range(20)]


def test_ids_are_the_librarys(library, mine):
    ts = texts()
    assert mine.encode_all(ts) == [library.encode(t) for t in ts]
    assert all(mine.encode(t) == library.encode(t) for t in ts[:60])


def test_streaming_gives_the_same_through_a_small_window(library, mine):
    for t in texts()[:200]:
        if t:
            assert list(mine._ids(mine.stream(iter(P.SPACE + t.replace(" ", P.SPACE)), hold=1))) == library.encode(t)


def test_stream_commits_early(mine):
    def endless():
        while True:
            yield from "stream of words without an end "

    s = mine.stream(endless())
    assert len([next(s) for _ in range(1000)]) == 1000


def test_prose_is_committed_at_converging_paths(library):
    """Ordinary text goes through the search: a boundary is committed at every border of words, and what is remembered is what was committed."""
    text = prose(11, 400)
    fresh = P.Pieces(MODEL)
    spaced = fresh._spaced(text)
    assert list(fresh._ids(fresh.stream(spaced))) == library.encode(text) and fresh.commits == len(text.split())
    fresh.commits = 0
    read, plain = [], fresh._read
    fresh._read = lambda text, i, *window: (read.append(text[:i] if isinstance(text, str) else "".join(text[:i])), plain(text, i, *window))[1]
    assert fresh.encode(text) == library.encode(text)
    words = set(fresh.unit.findall(spaced))
    assert fresh.commits == len(words) == len(fresh.young) and {w[:i] for w in words for i in range(1, len(w) + 1)} == set(read)
    assert fresh.encode(text) == library.encode(text) and fresh.commits == len(words)


def test_unigram_models_take_the_best_path():
    tag = dict(P._fields(MODEL))[2]
    kind = MODEL.replace(tag, tag.replace(b"\x18\x02", b"\x18\x01", 1), 1)
    if dict(P._fields(dict(P._fields(kind))[2])).get(3) != P.UNIGRAM:
        pytest.skip("the model file has its type elsewhere")
    mine = P.Pieces(kind)
    best = {"": 0.0}
    word = "▁therein"
    for i in range(1, len(word) + 1):
        best[word[:i]] = max(best[word[:j]] + mine.scores[mine.vocab[word[j:i]]] for j in range(i) if word[j:i] in mine.vocab and word[:j] in best)
    assert sum(mine.scores[k] for k in mine.stream(word)) == pytest.approx(best[word])


def test_decoding(library, mine):
    for t in texts()[:200]:
        ids = mine.encode(t)
        assert mine.decode(ids) == library.decode(ids) == t.replace(P.SPACE, " ")


def test_encoded_documents(odd, none, library):
    rows = P.encode_texts(odd)
    want = sorted((str(r.doc_id), library.encode(r.text or "")) for r in odd.collect())
    got = rows.collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want and all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    back = P.decode_ids(rows).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r.doc_id), r.text or "") for r in odd.collect())
    assert P.encode_texts(none).count() == 0


# GIF


def test_lzw_round_trip():
    rng = random.Random(2)
    for _ in range(150):
        d = bytes(rng.choices(range(rng.choice([1, 2, 200, 256])), k=rng.choice([0, 1, 2, 300, 9000])))
        assert gif.lzw_decode(gif.lzw_encode(d), 8, len(d)).tobytes() == d


def plain_lzw(stream, least, pixels):
    """A decoder code by code."""
    clear, end, at, bits = 1 << least, (1 << least) + 1, 0, int.from_bytes(stream, "little")
    out, table, width, last = [], None, least + 1, None
    while at + width <= 8 * len(stream) and len(out) < pixels:
        code = bits >> at & (1 << width) - 1
        at += width
        if code == end:
            break
        if code == clear:
            table, width, last = [[i] for i in range(clear)] + [None, None], least + 1, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        last = entry
    return bytes(out)


def test_stream_is_what_a_plain_decoder_reads():
    for seed in range(4):
        d = prose(seed, 4000).encode()
        assert plain_lzw(gif.lzw_encode(d), 8, len(d)) == d


def test_a_full_table_without_a_clear_code():
    d = np.random.default_rng(1).integers(0, 4, 60_000).astype(np.uint8)
    codes, table, prefix = [4], {}, int(d[0])
    for v in d[1:].tolist():
        if (prefix, v) in table:
            prefix = table[prefix, v]
            continue
        codes.append(prefix)
        if len(table) + 6 < 4096:
            table[prefix, v] = len(table) + 6
        prefix = v
    codes += [prefix, 5]
    bits = at = 0
    for k, c in enumerate(codes):
        width = 3 if k == 0 else min(12, (6 + max(0, k - 2)).bit_length())
        bits |= c << at
        at += width
    assert gif.lzw_decode(bits.to_bytes((at + 7) // 8, "little"), 2, len(d)).tobytes() == d.tobytes()


def picture(frames, palette=((0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255))):
    out = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x81, 0, 0) + bytes(v for c in palette for v in c)
    for (x, y, w, h), samples, disposal, clear, interlaced in frames:
        stream = gif.lzw_encode(bytes(samples), 2)
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 7, clear or 0, 0) + struct.pack("<BHHHHB", 0x2C, x, y, w, h, 0x40 if interlaced else 0) + b"\2"
        out += bytes([len(stream)]) + stream + b"\0"
    return out + b"\x3b"


def test_transparency_and_disposal():
    whole = ((0, 0, 4, 4), [1] * 16, 1, None, False)
    corner = lambda d, c: ((0, 0, 2, 2), [2, 3, 3, 2], d, c, False)
    last = ((3, 3, 1, 1), [3], 1, None, False)
    red, green = [255, 0, 0], [0, 255, 0]
    frames = list(gif.decode_gif(picture([whole, corner(2, 3), last])))
    assert frames[1].canvas[0, 0].tolist() == green and frames[1].canvas[0, 1].tolist() == red
    assert frames[2].canvas[0, 0].tolist() == [0, 0, 0] and frames[2].canvas[0, 2].tolist() == red
    frames = list(gif.decode_gif(picture([whole, corner(3, None), last])))
    assert frames[2].canvas[0, 0].tolist() == red and frames[2].delay_cs == 7 and frames[0].histogram()[0].tolist() == [0] * 7 + [16]


def test_interlaced_rows():
    rows = [0, 2, 1, 3]
    frame = next(gif.decode_gif(picture([((0, 0, 4, 4), [r for r in rows for _ in range(4)], 1, None, True)])))
    assert [frame.canvas[y, 0].tolist() for y in range(4)] == [[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]]


def test_archive(odd, none):
    rows = gif.archive_texts(odd).collect()
    for r, text in zip(sorted(rows, key=lambda r: str(r)), [None] * len(rows), strict=True):
        payload = b"".join(f.drawn()[..., 0].tobytes() for f in gif.decode_gif(bytes(r.media)))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])) and len(payload) % 192 == 0
    want = sorted(hashlib.sha256(gif.padded((r.text or "").encode())).hexdigest() for r in odd.collect())
    assert sorted(r.payload_sha256 for r in rows) == want
    assert gif.archive_texts(none).count() == 0
