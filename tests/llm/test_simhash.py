import random
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from framequorum.llm import graph, simhash as S

from .conftest import prose


def brute_print(text, n=3):
    words = [w for w in text.encode().lower().replace(b"\x0b", b" ").split()]
    if not words:
        return 0
    runs = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    texts = ["", " \t", "One", "a B", "a b c", "A  b\nc d", prose(1, 700), "É é a" * 9, "x " * 600]
    assert [int(x) for x in S.fingerprints([t.encode() for t in texts])[:, 0]] == [brute_print(t) for t in texts]


def test_hash_is_the_one_spark_has(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize(("lanes", "radius", "n"), [(1, 3, 900), (2, 9, 500)])
def test_index_finds_every_link(lanes, radius, n):
    rng = np.random.default_rng(lanes)
    x = rng.integers(0, 2**63, (25, lanes)).astype(np.uint64)[rng.integers(0, 25, n)]
    for i in range(n):
        for _ in range(rng.integers(0, 6)):
            x[i, rng.integers(lanes)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    x = np.unique(x, axis=0)
    row, root = S.link_groups(np.zeros(len(x), int), x, radius)
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]).sum(-1) <= radius, 1))
    assert np.array_equal(graph.merge(np.arange(len(x)), row, root), graph.merge(np.arange(len(x)), i, j))


def test_gray_order_puts_neighbours_side_by_side():
    codes = np.arange(64, dtype=np.uint64) ^ np.arange(64, dtype=np.uint64) >> np.uint64(1)
    assert S.gray_rank(codes).tolist() == list(range(64))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(None, 3), (5, 5)]
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            la, lb = label.setdefault(a, {a}), label.setdefault(b, {b})
            if la is not lb:
                la |= lb
                for v in lb:
                    label[v] = la
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: min(s) for v, s in label.items()}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_components(rows):
    prints = [(i, brute_print(t or "")) for i, t in rows]
    nodes = {}
    for i, p in prints:
        if i is not None:
            nodes[p] = min(nodes.get(p, i), i)
    keys = list(nodes)
    root = {p: p for p in keys}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    ids = {}
    for i, p in prints:
        if i is not None:
            ids.setdefault(i, p)
    for a in keys:
        for b in keys:
            if (a ^ b).bit_count() <= 3 or nodes[a] == nodes[b]:
                ra, rb = find(a), find(b)
                if ra != rb:
                    root[max(ra, rb, key=lambda p: nodes[p])] = min(ra, rb, key=lambda p: nodes[p])
    return sorted(((i, f"{p:016x}", nodes[find(p)] if p in nodes else None) for i, p in prints), key=str)


def test_documents(spark, odd, none):
    for df in (odd, spark.createDataFrame([(i, prose(i % 30, 150) + (" extra" if i >= 30 else "")) for i in range(60)], "doc_id long, text string")):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted((tuple(r) for r in S.simhash_components(df).collect()), key=str) == brute_components(rows)
    assert S.simhash_components(none).count() == 0


def test_hot_keys_are_cut_into_cells(spark, monkeypatch):
    """All fingerprints share a band; the result is that of one group."""
    rng = np.random.default_rng(3)
    x = np.unique(rng.integers(0, 2**20, 2600).astype(np.uint64))
    rows = [(i, int(v).to_bytes(8, "big")) for i, v in enumerate(x.tolist())]
    out = {bytes(r.fp): r.component for r in S.near_components(spark.createDataFrame(rows, "doc_id long, fp binary")).collect()}
    i, j = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 3, 1))
    assert [out[b] for _, b in rows] == graph.merge(np.arange(len(x)), i, j).tolist()


def test_near_copies_go_and_others_stay(spark):
    texts = [prose(i, 240) for i in range(40)]
    edited = [" ".join(w if k != 100 else "changed" for k, w in enumerate(t.split())) for t in texts[:20]]
    rows = [(i, t, "s") for i, t in enumerate([*texts, *edited, *texts[:5]])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(40))


def test_odd_rows_stay_whole(odd, none):
    kept = S.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and S.drop_near_duplicates(none).count() == 0
    assert {1, 3, 5, 6, 8, 9} <= {r.doc_id for r in kept.collect()}


def near_prints(rng, pairs, lanes=8):
    """Fingerprints of pairs of shingle sets with a Jaccard similarity of 0.8: 160 of 200 shared."""
    out = []
    for _ in range(pairs):
        h = rng.integers(0, 2**64, 200, dtype=np.uint64)
        for own in (h[:180], h[20:]):
            out.append([S.majority_bits(S._lane(own, lane), np.array([180]))[0] for lane in range(lanes)])
    return np.array(out, dtype=np.uint64)


def brute_pairs(x, radius):
    return np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]).sum(-1) <= radius, 1))


def test_wide_radius_compares_every_pair():
    x = near_prints(np.random.default_rng(5), 150)
    radius = S.radius_for(0.8, 8)
    row, root = S.link_groups(np.zeros(len(x), int), x, radius)
    i, j = brute_pairs(x, radius)
    assert len(i) > 40 and np.array_equal(graph.merge(np.arange(len(x)), row, root), graph.merge(np.arange(len(x)), i, j))


def test_recall_does_not_fall_with_the_row_count(spark, monkeypatch):
    """Near pairs share a cell at the band width of 30 GB (12 million fingerprints) as brute force finds them."""
    x = near_prints(np.random.default_rng(6), 400)
    radius = S.radius_for(0.8, 8)
    rows = [(i, v.astype(">u8").tobytes()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, fp binary")
    count = type(df).count
    monkeypatch.setattr(type(df), "count", lambda self: 12_000_000 if self.columns == ["fp", "rep"] else count(self))
    out = {bytes(r.fp): r.component for r in S.near_components(df, 8, radius, False).collect()}
    i, j = brute_pairs(x, radius)
    found = [out[rows[a][1]] == out[rows[b][1]] for a, b in zip(i, j, strict=True)]
    assert len(found) > 150 and np.mean(found) >= 0.98


def _jaccard(a, b):
    x, y = (set(S.shingle_hashes(t.encode(), 5)) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def _brute_groups(texts, least=0.8):
    """Smallest id reachable over links of at least that similarity, every pair compared."""
    label = {i: i for i in texts}
    links = [(i, j) for i in texts for j in texts if i < j and _jaccard(texts[i], texts[j]) >= least]
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label


def test_near_copies_are_those_of_a_checked_similarity(spark):
    """Copies with 1 to 9 of 240 words changed, around the threshold: only links of 0.8 count, chains do."""
    rng, texts = random.Random(5), {}
    for family in range(12):
        words = prose(100 + family, 240).split()
        for copy in range(6):
            mine = list(words)
            for _ in range(rng.choice([0, 1, 2, 4, 6, 9]) if copy else 0):
                mine[rng.randrange(len(mine))] = f"w{rng.randrange(10**6)}"
            texts[family * 6 + copy] = " ".join(mine)
    want = _brute_groups(texts)
    df = spark.createDataFrame([*texts.items(), (900, ""), (901, " "), (902, None)], "doc_id long, text string")
    kept = {r.doc_id for r in S.drop_near_duplicates(df).collect()}
    gone = set(texts) - kept
    assert {i for i in gone if want[i] == i} == set(), "a document without an earlier near copy went"
    missed = {i for i in texts if want[i] != i} - gone
    assert len(missed) <= 1 and len(gone) > 20 and 900 in kept and not {901, 902} & kept


def test_links_are_checked_by_their_sets(spark):
    texts = {1: prose(1, 300), 2: prose(1, 300) + " tail", 3: prose(2, 300), 4: "", 5: None, 6: "a b"}
    docs = spark.createDataFrame([*texts.items(), (2, prose(1, 300) + " tail"), (None, "x")], "doc_id long, text string")
    links = spark.createDataFrame([(2, 1), (1, 2), (1, 3), (3, 2), (4, 5), (4, 6), (6, 6)], "a long, b long")
    assert {tuple(sorted(r)) for r in S.similar_links(links, docs, 5, 0.8).collect()} == {(1, 2), (4, 5)}
    assert S.similar_links(links.limit(0), docs, 5, 0.8).count() == 0


def test_trees_tie_what_is_linked(monkeypatch):
    """Trees of real links, no more than rows less sets, by closest pairs; small groups, large ones, several blocks."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, (9, 8)).astype(np.uint64)[rng.integers(0, 9, 400)]
    for i in range(len(x)):
        for _ in range(rng.integers(0, 60)):
            x[i, rng.integers(8)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    group = np.repeat([0, 1, 2, 3], [300, 40, 30, 30])
    monkeypatch.setattr(S, "BLOCK", 5000)
    i, j = S.link_trees(group, x, 90)
    differ = np.bitwise_count(x[:, None] ^ x[None]).sum(-1)
    assert (group[i] == group[j]).all() and (differ[i, j] <= 90).all()
    for most in (30, 90):
        a, b = np.nonzero(np.triu((differ <= most) & (group[:, None] == group[None]), 1))
        want = graph.merge(np.arange(len(x)), a, b)
        low = differ[i, j] <= most + (6 if most < 90 else 0)
        got = graph.merge(np.arange(len(x)), i[low], j[low])
        assert all(got[p] == got[q] for p, q in zip(a, b, strict=True))
    assert len(i) == len(x) - len(np.unique(want))


@pytest.mark.parametrize("n", [90, 1300])
def test_no_link_is_left_out_for_closer_ones_that_fail(spark, n):
    """Whatever the check accepts of all close pairs of a cell ties components: single links among many that fail, hot cells too."""
    rng, radius = np.random.default_rng(n), 90
    x = rng.integers(0, 2**63, (n // 30, 8)).astype(np.uint64)[rng.integers(0, n // 30, n)]
    for i in range(n):
        for _ in range(rng.integers(10, 50)):
            x[i, rng.integers(8)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    x[:, 0] &= ~np.uint64(0x1FFF)
    x = np.unique(x, axis=0)[rng.permutation(n)]
    a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None]).sum(-1) <= radius, 1))
    holds = (a * 31 + b * 17) % 23 == 0
    want = graph.merge(np.arange(n), a[holds], b[holds])
    rows = [(i, v.astype(">u8").tobytes()) for i, v in enumerate(x)]
    accept = lambda links: links.where("(least(a, b) * 31 + greatest(a, b) * 17) % 23 = 0")
    out = {bytes(r.fp): r.component for r in S.near_components(spark.createDataFrame(rows, "doc_id long, fp binary"), 8, radius, False, accept).collect()}
    assert [out[fp] for _, fp in rows] == want.tolist() and 0 < holds.sum() < len(a)


def test_a_cell_of_near_copies_takes_little_memory():
    """Nearly all pairs of such a cell are close; what is held for them at a time does not grow with their rows' lanes."""
    rng = np.random.default_rng(5)
    x = np.tile(rng.integers(0, 2**63, 8).astype(np.uint64), (1500, 1))
    for _ in range(12):
        x[np.arange(1500), rng.integers(0, 8, 1500)] ^= np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)
    group, rows = np.zeros(1500, int), np.arange(1500)
    for search in (lambda: len(S.link_trees(group, x, 90)[0]), lambda: sum(len(i) for i, _ in S.open_pairs(group, x, 90, rows))):
        tracemalloc.start()
        found = search()
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert found in (1499, 1500 * 1499 // 2) and most < 64 << 20
