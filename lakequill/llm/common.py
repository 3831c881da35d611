"""What the operators of this subpackage share: shipping code, shared tables, reading."""

from __future__ import annotations

import os
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill import runtime
from lakequill.runtime import discard, drop_path, shared_dir, shared_path, stored  # noqa: F401  the operators' names for them

#: Rows up to which a table of a few numbers is broadcast after it has been counted.
BROADCAST_ROWS = 100_000
#: Bytes of an Arrow batch that a Python worker is sent; a longer text makes a batch of its own.
BATCH_BYTES, _BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of one key that a task of spread_join takes; a key with more is dealt to several.
HOT = 4096


def ship(spark: SparkSession) -> None:
    """Hand the package to the Python workers, and bound the bytes of the batches that the session sends them where it sets nothing."""
    runtime.ship(spark)
    if not spark._jsparkSession.conf().contains(_BATCH_CONF):  # a size of the session's own stays
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def spread_join(many: DataFrame, one: DataFrame, key: str, rows: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """many joined with one, which has a row for each key; keys that many holds more than HOT times are dealt to several tasks.

    rows: (key, rows), how often many holds each key at most, where that is known. The table of hot keys has at
    most a row for every HOT rows of many.
    """
    counted = many.groupBy(key).agg(F.count("*").alias("rows")) if rows is None else rows
    hot = stored(counted.where(F.col("rows") > HOT).select(key, F.ceil(F.col("rows") / HOT).cast("long").alias("_s")), "hot-keys")
    n = hot.count()
    if not n:
        return many.join(one, key, how)
    hot = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
    parts = F.coalesce(F.col("_s"), F.lit(1).cast("long"))
    left = many.join(hot, key, "left").withColumn("_i", F.pmod(F.xxhash64(*many.columns), parts)).drop("_s")
    right = one.join(hot, key, "left").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_s")
    return left.join(right, [key, "_i"], how).drop("_i")


def paired_join(x: DataFrame, y: DataFrame, keys: list[str], rows: DataFrame, condition, spread: str) -> DataFrame:
    """x and y joined on keys and a condition over the aliases x and y, both with many rows of a key: a hot key's pairs are dealt to a square of tasks.

    rows: (keys, rows), how often a key is held at most. A key of s times HOT rows is cut into s parts on either side, by the
    column spread, and each part of one side meets each part of the other in one task.
    """
    same = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]
    hot = stored(rows.where(F.col("rows") > HOT).select(*keys, F.ceil(F.col("rows") / HOT).cast("long").alias("_s")), "hot-pairs")
    n = hot.count()
    if n:
        hot = F.broadcast(hot) if n <= BROADCAST_ROWS else hot
        parts = F.coalesce(F.col("_s"), F.lit(1).cast("long"))
        every = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
        own = F.pmod(F.xxhash64(F.lit(7), spread), parts)
        x = x.join(hot, keys, "left").withColumn("_i", own).withColumn("_j", every).drop("_s")
        y = y.join(hot, keys, "left").withColumn("_j", own).withColumn("_i", every).drop("_s")
        same += [F.col("x._i") == F.col("y._i"), F.col("x._j") == F.col("y._j")]
    for c in same:
        condition = c & condition
    return x.alias("x").join(y.alias("y"), condition)


def size_in_bytes(df: DataFrame) -> int:
    """What the optimizer takes df to measure; nothing is run."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_fs(uri: str):
    """(file system, path) of a shared URI inside a Python worker."""
    from pyarrow import fs

    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def put_file(uri: str, data_parts) -> int:
    """Write a whole file under a name of its own, then move it to its final name: a repeated task attempt replaces it."""
    fs_, path = worker_fs(uri)
    fs_.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.part"
    n = 0
    with fs_.open_output_stream(tmp) as out:
        for b in data_parts:
            out.write(b)
            n += len(b)
    fs_.move(tmp, path)
    return n


def trim_worker() -> None:
    """Give back what earlier tasks left in a reused Python worker: encoding memos, Arrow's free segments, free heap pages."""
    import ctypes

    import pyarrow as pa

    coders = sys.modules.get("lakequill.llm.coder")
    if coders:
        coders.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))
