"""Exact top-k inner products by exhaustive term-at-a-time accumulation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import keep

#: A term whose postings fill more of a block than this is added as a whole row.
DENSE = 0.25
SCORES_PER_BLOCK = 1 << 19


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids in ascending order, row numbers, and one integer vector each."""
    ids, numbers = table.column("id").to_numpy(), table.column("row").to_numpy()
    lists = table.column("v").combine_chunks()
    flat, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    order = np.lexsort((numbers, ids))
    return ids[order], numbers[order], [flat[ends[i] : ends[i + 1]] for i in order]


def _postings(vectors: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each term (position in the vector) the rows with a weight there, and the weights."""
    if not vectors:
        return {}
    lengths = np.array([len(v) for v in vectors])
    weight = np.concatenate(vectors)
    row = np.repeat(np.arange(len(vectors)), lengths)
    term = np.arange(len(weight)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    full = weight != 0
    weight, row, term = weight[full], row[full], term[full]
    order = np.argsort(term, kind="stable")
    weight, row, term = weight[order], row[order], term[order]
    cuts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, int)
    return {int(term[a]): (row[a:b], weight[a:b]) for a, b in zip(cuts, np.r_[cuts[1:], len(term)], strict=True)}


def accumulate(queries: list[np.ndarray], candidates: list[np.ndarray]) -> np.ndarray:
    """Scores of every query against every candidate, one term after another."""
    of_query, of_row = _postings(queries), _postings(candidates)
    most = [max((int(max(w.max(), -w.min())) for _, w in p.values()), default=0) for p in (of_query, of_row)]
    bound = most[0] * most[1] * max(1, len(of_row))
    kind = np.int32 if bound < 2**31 else np.int64 if bound < 2**63 else object
    scores = np.zeros((len(queries), len(candidates)), dtype=kind)
    spare = np.empty_like(scores)
    for term, (q, qw) in of_query.items():
        if term not in of_row:
            continue
        c, cw = of_row[term]
        if len(c) * len(q) >= DENSE * scores.size:
            a, b = np.zeros(len(queries), kind), np.zeros(len(candidates), kind)
            a[q], b[c] = qw, cw
            np.multiply(a[:, None], b[None, :], out=spare)
            scores += spare
        else:
            scores[np.ix_(q, c)] += qw.astype(kind)[:, None] * cw.astype(kind)[None, :]
    return scores


def best_of(ids: np.ndarray, scores: np.ndarray, k: int, own: np.ndarray) -> list[tuple[int, int]]:
    """The k highest (score, id), ties to the smaller id, without the query's own row (where own is true, once at most). ids ascend."""
    take = min(len(ids), k + 1)
    least = np.partition(scores, len(ids) - take)[len(ids) - take]
    near = np.flatnonzero((scores >= least) & ~own)
    order = sorted(near.tolist(), key=lambda i: (-int(scores[i]), int(ids[i])))[:k]
    return [(int(scores[i]), int(ids[i])) for i in order]


def _cell(k: int):
    low, high = -(2**63), 2**63 - 1

    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        qids, qrows, qv = _rows(queries)
        ids, numbers, vectors = _rows(candidates)
        step = max(1, SCORES_PER_BLOCK // max(1, len(ids)))
        for at in range(0, len(qids) if len(ids) else 0, step):
            scores = accumulate(qv[at : at + step], vectors)
            for query, number, row in zip(qids[at : at + step], qrows[at : at + step], scores, strict=True):
                for score, vec in best_of(ids, row, k, numbers == number):
                    for column, value in zip(out, (int(query), int(number), vec, min(max(score, low), high)), strict=True):
                        column.append(value)
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "query_row", "vec_id", "score"), out, strict=True)})

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: float = 256.0, cell_rows: int = 4096, query_rows: int = 4096) -> DataFrame:
    """Each query's k highest integer inner products over all other rows.

    Components x become floor(scale * x). Queries and candidates are dealt by a hash of
    their id into cells of about ``query_rows`` x ``cell_rows``; each cell accumulates whole
    dense score arrays, keeps its k best per query, and the cells' lists are merged.
    ``is_query`` is a condition on ``id_col``.

    Defined cases: rows with a null id or vector, or a null or non-finite component, take no
    part; vectors of different lengths count missing components as zero; each row is a query
    and a candidate of its own, also where it shares its id; fewer than k others give them
    all; an empty table, or no query, gives no rows; sums beyond 64 bits are cut off at the largest long.
    """
    x = F.col("_v")
    valid = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("_v")).where(F.col("id").isNotNull() & x.isNotNull())
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    valid = valid.where(~bad).select("id", F.transform(x, lambda e: F.floor(e.cast("double") * F.lit(float(scale)))).alias("v"))
    # Written once, so that a row has one number as a query and as a candidate.
    valid = keep(valid.withColumn("row", F.monotonically_increasing_id()))
    asked = is_query if isinstance(is_query, Column) else F.expr(is_query)
    size = valid.select(asked.alias("q")).agg(F.count("*").alias("n"), F.count_if("q").alias("m")).first()
    rows, cols = max(1, -(-size["m"] // query_rows)), max(1, -(-size["n"] // cell_rows))
    deal = lambda n, seed: F.pmod(F.xxhash64("id", "row", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = valid.withColumn("c", deal(cols, 1)).withColumn("r", every(rows))
    queries = valid.where(asked).withColumn("r", deal(rows, 2)).withColumn("c", every(cols))
    found = candidates.groupBy("c", "r").cogroup(queries.groupBy("c", "r")).applyInArrow(_cell(k), "query_id long, query_row long, vec_id long, score long")
    by = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
