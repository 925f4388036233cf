import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from framequorum.llm import repeats as R, suffix as S

from .conftest import SCHEMA, prose


def brute_suffixes(t):
    order = sorted(range(len(t)), key=lambda i: t[i:])

    def common(a, b):
        k = 0
        while a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        return min(k, S.MOST)

    return order, [0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)]


@pytest.mark.parametrize("how", [{}, {"queue_rows": 3}, {"base_rows": 2}, {"base_rows": 1, "queue_rows": 5}, {"base_rows": 1, "queue_rows": 5, "chunk": 3}])
def test_suffixes_and_prefixes(how):
    rng = random.Random(str(how))
    for _ in range(150):
        t = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 20, 80]))] * rng.choice([1, 1, 2])
        order, near = S.sort_suffixes(np.array(t), **how)
        assert (list(order), list(near)) == brute_suffixes(t)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_symbols_that_share_a_bucket(monkeypatch, chunk):
    """Strings of names have large alphabets, whose symbols share buckets; no prefixes are carried there."""
    monkeypatch.setattr(S, "SINGLE", 0)
    rng = random.Random(chunk)
    for _ in range(150):
        t = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 2, 5, 20, 80]))] * rng.choice([1, 1, 2])
        order, _ = S.sort_suffixes(np.array(t), 9, 1, False, chunk)
        assert list(order) == brute_suffixes(t)[0]


def test_queue_keeps_order_on_disk_and_in_memory():
    q = S.SymbolQueue(np.arange(3), rows=4)
    for k in range(5):
        q.push(np.array([1, 2, 1]), np.array([10 * k, 7, 10 * k + 1]), np.array([k, 9, k], np.uint8))
    assert q.spilled > 0
    parts = list(iter(lambda: q.pop(1, 3), None))
    assert [v for p, _ in parts for v in p.tolist()] == [v for k in range(5) for v in (10 * k, 10 * k + 1)]
    assert [v for _, c in parts for v in c.tolist()] == [k for k in range(5) for _ in range(2)]
    assert q.pop(1) is None
    q.close()


def test_memory_stays_below_the_string():
    """Text, stars, names, falling suffixes and results are on disk: the peak is a fraction of what an array of places takes, and does not follow the length."""
    import tracemalloc

    peaks = []
    for size in (400_000, 1_600_000):
        half = " ".join(prose(seed, 2000) for seed in range(size // 20_000)).encode()[: size // 2]
        text = S.scratch(2 * len(half), np.uint16)
        text[:] = np.frombuffer(half * 2, np.uint8).astype(np.uint16) + 1
        del half
        tracemalloc.start()
        n = sum(len(p) for p, _ in S.sorted_suffixes(text, 4096, 4096, True, 4096))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert n == len(text)
    assert peaks[1] < 2 * 1_600_000 and peaks[1] < 2 * peaks[0]


def text_hash(t):
    h = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return h - (h >> 63 << 64)


def brute(rows):
    """(n_bytes, n_removed, n_spans, sha) per row, by looking at every string of 100 bytes."""
    docs = sorted({(R.NO_ID if i is None else i, text_hash(t), (t or "").encode()) for i, t in rows}, key=lambda d: d[:2])
    seen, out = set(), {}
    for key, crc, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(b[p : p + 100])
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[key, crc] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return Counter((i, *out[R.NO_ID if i is None else i, text_hash(t)]) for i, t in rows)


def got(df):
    return Counter(tuple(r) for r in R.repeats_digest(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def made():
    shared, line = prose(90, 60), "A common line that many of the texts here share, word for word, but nothing around it."
    rows = [(i, prose(100 + i, 40) + (" " + shared if i % 3 == 0 else "") + " " + line + " " + prose(300 + i, 20)) for i in range(40)]
    return [*rows, (50, "ab" * 400), (51, "for " * 200), (52, rows[3][1]), (53, rows[4][1][:150] + "#" + rows[4][1][150:])]


def test_against_every_string(spark):
    rows = made()
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


@pytest.mark.parametrize(("few", "hot"), [(1, 1), (1, 3), (8, 3), (2, 1000)])
def test_common_anchors_are_split(spark, monkeypatch, few, hot):
    monkeypatch.setattr(R, "FEW", few)
    monkeypatch.setattr(R, "HOT", hot)
    rows = made()
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def near_copies(n):
    """One text n times with a word changed in each, and a line of 90 bytes that all texts share."""
    rng = random.Random(7)
    base, line = prose(77, 60).split(), "x" * 20 + " this line of ninety bytes stands in each and every one of all the texts."[:70]
    out = []
    for i in range(n):
        words = list(base)
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append((i, " ".join(words) + f" {rng.random()} " + line + f" {rng.random()}"))
    return out


def test_large_group_of_near_copies(spark):
    """2,000 near copies and a line common to all: equal to brute force, and no more rows than segments."""
    rows = near_copies(2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert got(df) == brute(rows)
    spans = R.repeated_spans(df.selectExpr("doc_id AS doc", "xxhash64(text) AS text", "text AS bytes")).count()
    assert spans < 2000 * 20


def test_hash_is_not_believed():
    """Segments with one hash and different bytes stay apart."""
    data = np.frombuffer(b"a" * 100 + b"b" * 100 + b"a" * 100, np.uint8)
    rows = np.zeros(3, R.PIECE)
    rows["doc"], rows["length"] = [1, 2, 3], 100
    firsts, spans = R._collapsed(rows, "key", data, np.array([0, 100, 200]), np.full(3, 100), np.zeros(3, np.uint64))
    assert 1 in firsts.tolist() and 0 in firsts.tolist() and {int(d) for d in spans["doc"]} <= {3}


def test_long_text_goes_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "SLICE", 1500)
    rows = [(1, prose(1, 900)), (2, prose(1, 900)[700:2600]), (3, prose(5, 20))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)) == brute(rows)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd) == brute(rows)
    assert got(none) == Counter()
    kept = R.without_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_kept_text_is_whole_characters(spark):
    text = "é" * 200
    out = R.without_repeats(spark.createDataFrame([(1, text), (2, text + "z")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert set(out[0].text) == {"é"} and out[1].text.endswith("z") and len(out[1].text) < 200


def test_schema_matches():
    assert "doc_id long" in SCHEMA
