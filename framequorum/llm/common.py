"""Shared helpers: cutting lineage in the shared folder, size-checked lookups, Arrow views."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows that a lookup table may have before it is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 100_000
SALTS = 32
#: A key is hot with more than this fraction (one in so many) of all rows.
HOT_SHARE = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a worker process keeps from task to task, by the module it is of.
KEPT: dict[str, dict | list] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one only on a local master that names none."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = getattr(context, "_framequorum_dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="framequorum-")
            atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
            context._framequorum_dir = folder
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which it does once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(*kept: DataFrame) -> None:
    """Delete tables of ``keep`` that only other tables, written since, were made from, and release shuffles."""
    for df in kept:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    release_shuffles(kept[0].sparkSession)


def join_hot(big: DataFrame, small: DataFrame, left: str, right: str, how: str = "inner") -> DataFrame:
    """Join big to small (one row per key) whatever keys are hot in big; ``how`` is inner or left.

    A small table of up to BROADCAST_ROWS rows, which are counted, is broadcast. Otherwise keys
    with over a HOT_SHARE-th of the rows of big, fewer than HOT_SHARE of them, are broadcast and
    all others are joined by shuffle.
    """
    if small.count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), big[left] == small[right], how)
    limit = max(10_000, big.count() // HOT_SHARE)
    hot = big.groupBy(F.col(left).alias("_hot")).count().where((F.col("count") > limit) & F.col("_hot").isNotNull()).select("_hot")
    hot = keep(hot)
    marked = big.join(F.broadcast(hot), big[left] == hot["_hot"], "left")
    few = keep(small.join(F.broadcast(hot), small[right] == hot["_hot"], "left_semi"))
    few = few.select(*[F.col(f"`{c}`") for c in small.columns])
    cold = marked.where("_hot is null").drop("_hot").alias("b").join(small, F.col(f"b.{left}") == small[right], how)
    return cold.unionByName(marked.where("_hot is not null").drop("_hot").join(F.broadcast(few), F.col(left) == few[right], how))


def lookup(big: DataFrame, small: DataFrame, key: str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join big to small, which has one row per key (null keys meet), whatever key is hot in big.

    small is counted: at most ``limit`` rows are broadcast; more are repeated over SALTS
    salts, over which the rows of each key of big are dealt, so no key meets in one task.
    """
    right = small.withColumnRenamed(key, "_lookup_key")
    if small.count() <= limit:
        return big.join(F.broadcast(right), big[key].eqNullSafe(right["_lookup_key"]), how).drop("_lookup_key")
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, t in big.dtypes if not t.startswith("map")]), F.lit(SALTS)).cast("int"))
    right = right.withColumn("_salt_r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = left[key].eqNullSafe(right["_lookup_key"]) & (left["_salt"] == right["_salt_r"])
    return left.join(right, on, how).drop("_lookup_key", "_salt", "_salt_r")


def small_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """Lower the session's Arrow batches to ``rows`` rows: texts can be long, and a batch is held by both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def utf8_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of an Arrow string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=len(column) + 1 + column.offset)[column.offset :]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(batches, column: str, most: int = 4 << 20, rows: int = 2000):
    """Cut record batches into slices of about ``most`` bytes of text (one longer row stands alone)."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        _, offsets = utf8_buffer(batch.column(at))
        begin, n = 0, batch.num_rows
        while begin < n:
            end = int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1
            end = min(max(end, begin + 1), n, begin + rows)
            yield batch.slice(begin, end - begin)
            begin = end
        pa.default_memory_pool().release_unused()


def let_go(but: str = "") -> None:
    """Empty what modules keep in this process, but for one's, and give freed memory back to the system: numpy and Arrow hold it else."""
    for name, kept in KEPT.items():
        if name != but:
            kept.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable, keeps: str = "") -> Callable:
    """``run`` for mapInArrow in a worker that other operators have used before and will use next: before it and after it goes all that is not the module's own."""

    def task(batches):
        let_go(keeps)
        try:
            yield from run(batches)
        finally:
            let_go(keeps)

    return task


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as DataFrame expressions; both empty for a null url or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    safe = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(safe, pattern, 1), UPPER, LOWER), F.regexp_extract(safe, pattern, 2)
