"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import keep

#: From this many items on, numpy's hypergeometric sampler gives way to the windowed one.
LARGE = 10**9
MAX_PARTITIONS = 65_536


def _hypergeometric(rng, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` items without replacement are good ones."""
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good else 0
    low, high = max(0, draws - bad), min(good, draws)
    total = good + bad
    mean = draws * good / total
    sigma = (mean * (bad / total) * ((total - draws) / (total - 1))) ** 0.5
    low, high = max(low, int(mean - 12 * sigma) - 12), min(high, int(mean + 12 * sigma) + 12)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.r_[0.0, np.cumsum(ratio)]
    weight = np.cumsum(np.exp(weight - weight.max()))
    return low + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def _split(rng, room: np.ndarray, draws: int) -> np.ndarray:
    """A multivariate hypergeometric draw of ``draws`` items from buckets of size ``room``."""
    if room.sum() < LARGE:
        return rng.multivariate_hypergeometric(room, draws, method="marginals")
    out, left = np.zeros_like(room), int(room.sum())
    for i, size in enumerate(room.tolist()):
        out[i] = _hypergeometric(rng, size, left - size, draws)
        left, draws = left - size, draws - int(out[i])
    return out


def matrix_row(counts: np.ndarray, room: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the matrix: how many rows of partition p go to each bucket.

    Partitions are halved again and again; each half draws from its parent's room under a
    generator named by the half, so every task finds its own row without the others'.
    """
    low, high = 0, len(counts)
    while high - low > 1:
        mid = (low + high) // 2
        left = _split(np.random.default_rng([seed, 1, low, high]), room, int(counts[low:mid].sum()))
        low, high, room = (low, mid, left) if p < mid else (mid, high, room - left)
    return room


def bucket_sizes(rows: int, shards: int, per_shard: int) -> np.ndarray:
    """Sizes of shards * per_shard buckets: shard sizes differ by one at most, and so do a shard's buckets."""
    sizes = [rows // shards + (s < rows % shards) for s in range(shards)]
    return np.array([n // per_shard + (b < n % per_shard) for n in sizes for b in range(per_shard)], dtype=np.int64)


def uniform_shards(rows: DataFrame, shards: int = 16, seed: int = 7, bucket_rows: int = 4096, spread: tuple[Column, ...] = ()) -> DataFrame:
    """Add ``shard`` and a gapless ``slot`` from 0 to every row: a uniform random shuffle.

    Every row's partition is a hash of its content, so a lost task is done again alike. Rows
    whose equals are more than a partition should hold are dealt by ``spread`` instead: values
    that tell equal rows apart and that a lost task finds again, such as file and row number.
    Each partition permutes its rows and sends exact counts to buckets; each bucket permutes what
    it got. A shard is a run of buckets of known size, so slots need no further counting.

    Defined cases: nulls are values like any other; equal rows are interchangeable; an empty
    table gives no rows; a bucket holds max(bucket_rows, rows / 65,536) rows, and so does a
    partition on average; without ``spread``, equal rows are all in one partition.
    """
    schema = rows.schema
    names = rows.columns
    total = rows.count()
    parts = max(1, min(MAX_PARTITIONS, -(-total // bucket_rows)))
    per_shard = max(1, -(-total // (shards * max(bucket_rows, -(-total // MAX_PARTITIONS)))))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(parts)).cast("int"))

    def counted() -> np.ndarray:
        counts = np.zeros(parts, dtype=np.int64)
        for r in dealt.groupBy("_part").count().collect():  # parts rows, 65,536 at most
            counts[r["_part"]] = r["count"]
        return counts

    counts = counted()
    most = 2 * max(bucket_rows, -(-total // MAX_PARTITIONS))
    full = np.flatnonzero(counts > most).tolist()
    if full and spread:
        many = dealt.where(F.col("_part").isin(full)).groupBy(*names).count().where(F.col("count") > most)
        many = [r[0] for r in many.select(F.xxhash64(*names)).collect()]  # 32,768 at most
        if many:
            dealt = dealt.withColumn("_part", F.when(F.xxhash64(*names).isin(many), F.pmod(F.xxhash64(F.lit(seed), *spread), F.lit(parts)).cast("int")).otherwise(F.col("_part")))
            counts = counted()

    def permuted(table: pa.Table, *name: int) -> pa.Table:
        table = table.sort_by([(n, "ascending") for n in names])
        return table.take(pa.array(np.random.default_rng([seed, *name]).permutation(table.num_rows)))

    def send(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        p = key[0].as_py()
        row = matrix_row(counts, bucket_sizes(total, shards, per_shard), p, seed)
        table = permuted(table.select(names), 2, p)
        return table.append_column("_bucket", pa.array(np.repeat(np.arange(len(row)), row), pa.int32()))

    def receive(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        sizes = bucket_sizes(total, shards, per_shard)
        first = int(sizes[b - b % per_shard : b].sum())
        table = permuted(table.select(names), 3, b)
        n = table.num_rows
        table = table.append_column("shard", pa.array(np.full(n, b // per_shard), pa.int32()))
        return table.append_column("slot", pa.array(first + np.arange(n), pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    sent = dealt.groupBy("_part").applyInArrow(send, f"{fields}, _bucket int")
    return sent.groupBy("_bucket").applyInArrow(receive, f"{fields}, shard int, slot long")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 7, bucket_rows: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents in shards under the law ``rows``: counts differ by one at most.

    Only id, size (UTF-8 bytes plus 1; null text: 1) and CRC-32 of the text move; they are
    read from the texts once and kept in the shared folder. ``grown_shard`` is null, for a
    uniform shuffle moves rows between all shards when one is added.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    # File names carry a random part; the task's number in them and the row's number in the file do not.
    spread = (F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1), F.col("_metadata.row_index"))
    out = uniform_shards(digest, shards, seed, bucket_rows, spread)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
