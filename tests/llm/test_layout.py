from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequorum.llm import common, mixing, sharding, topk

from .conftest import prose

VECTORS = "vec_id long, embedding array<float>, label int, id int, v string, c int, r int"


def _vectors(rows):
    return [(i, v, 0, 1, "x", 2, 3) for i, v in rows]


def brute_top(rows, k=5):
    from math import floor, isfinite

    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and isfinite(x) for x in v):
            good.append((i, tuple(floor(256 * x) for x in np.float32(v).astype(float))))
    out = []
    for own, (q, a) in enumerate(good):
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for n, (i, b) in enumerate(good) if n != own)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("cells", [(4096, 4096), (40, 2)])
def test_top_k(spark, cells):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(i, [0.0] * 8) for i in range(300, 340)]
    rows += [(400, None), (450, [1.0, None]), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (None, [1.0] * 8), (600, []), (650, [0.5]), (7, [9.0] * 8), (100, [0.1] * 8)]
    df = spark.createDataFrame(_vectors(rows), VECTORS).repartition(3)
    got = topk.exact_top_k(df, F.col("id") % 50 == 0, cell_rows=cells[0], query_rows=cells[1])
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect()) == brute_top(rows)


def test_top_k_of_little(spark):
    df = spark.createDataFrame(_vectors([(0, [1.0]), (50, [2.0])]), VECTORS)
    assert sorted(tuple(r) for r in topk.exact_top_k(df, F.col("id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert topk.exact_top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert topk.exact_top_k(df, F.col("id") == 3).count() == 0


def test_sparse_and_huge_weights():
    q, c = [np.array([0, 5, 0, 0]), np.array([2**40, 0])], [np.array([0, 0, 7]), np.array([2**40, 3])]
    assert topk.accumulate(q, c).tolist() == [[0, 15], [0, 2**80]]


def _sharded(rows, total, shards=16):
    assert len(rows) == total
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = sharding.shard_documents(docs, bucket_rows=100).collect()
    _sharded(rows, 3000)
    assert Counter(r.doc_id for r in rows) == Counter(range(3000)) and {r.law for r in rows} == {"rows"}
    again = sharding.shard_documents(docs.repartition(7), bucket_rows=100).collect()
    assert sorted(rows) == sorted(again)


def test_equal_rows_do_not_share_a_partition(spark):
    """A third of all rows without id, with one text: no partition gets them all, and sizes are exact."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = sharding.shard_documents(docs.repartition(4), bucket_rows=100).collect()
    _sharded(rows, 3000)
    assert Counter(r.doc_id for r in rows if r.doc_id is not None) == Counter(i for i in range(3000) if i % 3) and sum(r.doc_id is None for r in rows) == 1000


def test_shuffle_is_uniform(spark):
    docs = spark.range(4000).select(F.col("id").alias("x"))
    rows = sharding.uniform_shards(docs, shards=4, bucket_rows=250).collect()
    first = Counter(r.shard for r in rows if r.x < 2000)
    assert all(abs(n - 500) < 90 for n in first.values())
    early = sum(r.slot < 500 for r in rows if r.x < 2000)
    assert abs(early - 1000) < 110


def test_matrix_has_exact_sums():
    counts, room = np.array([5, 0, 17, 9, 1]), sharding.bucket_sizes(32, 3, 2)
    rows = np.array([sharding.matrix_row(counts, room, p, 3) for p in range(5)])
    assert rows.sum(1).tolist() == counts.tolist() and rows.sum(0).tolist() == room.tolist() and (rows >= 0).all()


def test_large_draws_have_the_right_mean():
    rng = np.random.default_rng(1)
    draws = [sharding._hypergeometric(rng, 3 * 10**9, 10**9, 4 * 10**6) for _ in range(50)]
    assert abs(np.mean(draws) - 3 * 10**6) < 600 and sharding._split(rng, np.array([10**9, 10**9, 5]), 2 * 10**9 + 5).tolist() == [10**9, 10**9, 5]


def test_shards_of_odd_rows(odd, none):
    rows = sharding.shard_documents(odd).collect()
    _sharded(rows, odd.count())
    sizes = Counter((r.doc_id, r.size) for r in rows)
    assert sizes == Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in odd.collect()) and {r.text_crc32 for r in rows if r.doc_id in (3, 4)} == {0}
    assert sharding.shard_documents(none).count() == 0


def _sources(spark):
    rows = [(i, prose(i, 20 + i % 7), "big" if i % 10 < 7 else f"s{i % 3}") for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_mixture_meets_its_budgets(spark):
    docs = _sources(spark)
    rows = mixing.mix_sources(docs, flattening=0.8, max_repetition=4.0).collect()
    tokens = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    total = Counter()
    for d, t in tokens.items():
        total[source[d]] += t
    all_tokens = sum(total.values())
    used, weight, passes = Counter(), {}, {}
    for r in rows:
        used[r.source] += r.tokens
        weight[r.source] = r.weight
        passes.setdefault((r.source, r["pass"]), []).append(r.doc_id)
    assert sum(weight.values()) == pytest.approx(1, abs=1e-6)
    for s, w in weight.items():
        assert 0 <= w * all_tokens - used[s] <= 40
    entropy = lambda p: -sum(x * log(x) for x in p if x)
    own = entropy([t / all_tokens for t in total.values()])
    assert entropy(weight.values()) == pytest.approx(own + 0.8 * (log(len(total)) - own), abs=1e-3)
    for (s, p), ids in passes.items():
        assert len(set(ids)) == len(ids) and (len(ids) == sum(v == s for v in source.values()) or (s, p + 1) not in passes)


def test_repetition_limit(spark):
    rows = mixing.mix_sources(_sources(spark), flattening=1.0, max_repetition=1.5).collect()
    assert max(r["pass"] for r in rows) <= 1


def test_cut_is_the_longest_prefix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_BITS", 2)
    docs = _sources(spark)
    rows = mixing.mix_sources(docs, flattening=0.5).collect()
    used, places = Counter(), {}
    for r in rows:
        used[r.source] += r.tokens
        places.setdefault((r.source, r["pass"]), []).append(r.place)
    assert 0 <= rows[0].weight * sum(len(r.text.split()) for r in docs.collect()) - used[rows[0].source] <= 40


def test_mixture_of_odd_rows(odd, none):
    rows = mixing.mix_sources(odd, flattening=0.3).collect()
    assert {r.source for r in rows} >= {"a", None} or len(rows) > 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and mixing.mixed_documents(none).count() == 0 and mixing.mix_sources(none).count() == 0
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in mixing.mix_sources(odd).collect())


def test_lookup_by_salt_gives_the_same(spark):
    big = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "a"), (5, "z")], "x int, k string")
    small = spark.createDataFrame([("a", 10), (None, 20), ("b", 30)], "k string, y int")
    want = sorted(tuple(r) for r in common.lookup(big, small, "k").select("x", "k", "y").fillna("", "k").fillna(-1, "y").collect())
    got = sorted(tuple(r) for r in common.lookup(big, small, "k", limit=0).select("x", "k", "y").fillna("", "k").fillna(-1, "y").collect())
    assert got == want == [(1, "a", 10), (2, "", 20), (3, "b", 30), (4, "a", 10), (5, "z", -1)]
