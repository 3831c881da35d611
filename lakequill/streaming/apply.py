"""File events applied to the chunk table by Structured Streaming.

Events are rows (seq, kind, path, new_path) of an append-only log: create, modify, remove, rename_both (path to
new_path), rename_from, rename_to, rename. Each batch keeps the last operation of each path, deletes and re-chunks
through the same functions as the batch run, and publishes once.
"""

from __future__ import annotations

import os
import signal
import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lakequill.operators.assets import AssetCache, synthetic_texts
from lakequill.operators.metrics import Metrics
from lakequill.operators.segments import SegmentIndex
from lakequill.operators.store import status
from lakequill.sources import files
from lakequill.sources.files import is_tracked
from lakequill.streaming.debounce import PROVIDER, debounced_stream

EVENTS = "seq long, kind string, path string, new_path string"


def operations(events: DataFrame) -> DataFrame:
    """(seq, path, op, sub, and ts where events have one): delete or index for each tracked path that an event names, in the order of (seq, sub); other kinds are ignored."""
    one = F.struct(F.col("path").alias("path"), F.lit("delete").alias("op"), F.lit(0).alias("sub"))
    two = F.struct(F.col("new_path").alias("path"), F.lit("index").alias("op"), F.lit(1).alias("sub"))
    same = F.struct(F.col("path").alias("path"), F.lit("index").alias("op"), F.lit(0).alias("sub"))
    ops = F.when(F.col("kind") == "rename_both", F.array(one, two)).when(F.col("kind").isin("rename_from", "remove"), F.array(one)).when(F.col("kind").isin("rename_to", "rename", "create", "modify"), F.array(same))
    time = [c for c in ("ts",) if c in events.columns]
    return events.select("seq", *time, F.explode(ops).alias("o")).select("seq", "o.path", "o.op", "o.sub", *time).where(is_tracked(F.col("path")))


def last_operations(events: DataFrame) -> DataFrame:
    """(path, op, seq): delete or index, by the last event of each tracked path; other kinds are ignored."""
    last = operations(events).groupBy("path").agg(F.max(F.struct("seq", "sub", "op")).alias("m"))
    return last.select("path", F.col("m.op").alias("op"), F.col("m.seq").alias("seq"))


def reader(spark: SparkSession, root: str, extractor=None, cache: AssetCache | None = None, exclude=()):
    """What apply_batch reads the files below root with: markdown as it is, assets as synthetic text unless an exclude glob names them. Without an extractor asset events change nothing."""
    def read(paths: DataFrame) -> DataFrame:
        md = F.col("file_path").rlike(r"\.md$")
        texts = files.read_texts(spark, root, paths.where(md))
        if extractor is None:
            return texts
        return texts.unionByName(synthetic_texts(spark, root, paths.where(~md & ~files.excluded(F.col("file_path"), exclude)), extractor, cache))

    return read


def apply_batch(events: DataFrame, store, read, chunk_and_embed, metrics: Metrics | None = None, index_root: str | None = None) -> tuple[int, int]:
    """apply_operations() for the last operation of each path that the events name."""
    seen = Observation()
    got = apply_operations(last_operations(events.observe(seen, F.count("*").alias("events"))), store, read, chunk_and_embed, metrics, index_root)
    if metrics is not None:
        metrics.add("file_events_processed_total", seen.get["events"])
    return got


def apply_operations(ops: DataFrame, store, read, chunk_and_embed, metrics: Metrics | None = None, index_root: str | None = None) -> tuple[int, int]:
    """Apply operations (path, op, seq), one for each path; (files indexed, files deleted). read turns (file_path) rows into (file_path, text, error).

    Files are always embedded anew. One that is empty by now is deleted, one that can't be read or extracted stays as it
    was. The full-text index under index_root takes in what changed. All counts are observed in the passes that
    the change takes anyway.
    """
    metrics, began = metrics or Metrics(), time.monotonic()
    read_, made, named = Observation(), Observation(), Observation()
    ops = ops.cache()
    got = read(ops.where("op = 'index'").select(F.col("path").alias("file_path"))).observe(read_, F.count_if(F.col("error").isNotNull()).alias("failed")).cache()
    fresh = chunk_and_embed(got.where("error is null")).cache()
    gone = ops.where("op = 'delete'").select(F.col("path").alias("file_path"), F.lit(True).alias("gone"))
    paths = gone.unionAll(got.where("error is null").select("file_path", F.lit(False).alias("gone")))
    before, version = store.read(), store.version
    seconds = F.avg("request_seconds") if "request_seconds" in fresh.columns else F.lit(None).cast("double")
    store.replace(fresh.observe(made, F.count("*").alias("chunks"), seconds.alias("seconds")), paths.observe(named, F.count_if("gone").alias("gone"), F.count_if(~F.col("gone")).alias("done")))
    n, deleted, chunks = named.get["done"], named.get["gone"], made.get["chunks"]
    if store.version != version:
        if index_root:
            changed = paths.select("file_path").unionAll(fresh.select("file_path")).distinct()
            SegmentIndex(store.spark, index_root).apply(fresh, before.join(changed, "file_path", "left_semi").select("chunk_id"), source=store.version)
        totals = status(store.read()).first()
        metrics.set("chunks_total", totals["total_chunks"])
        metrics.set("files_total", totals["total_files"])
    metrics.add("chunks_indexed_total", chunks)
    metrics.add("embedding_errors_total", read_.get["failed"])
    if made.get["seconds"] is not None:
        metrics.observe("embedding_latency_seconds", made.get["seconds"])
    if chunks:
        metrics.observe("indexing_throughput_chunks_per_second", chunks / max(time.monotonic() - began, 1e-9))
    for df in (ops, got, fresh):
        df.unpersist()
    return n, deleted


def watch(spark, log_dir, store, read, chunk_and_embed, checkpoint: str, interval: str | None = "500 milliseconds", max_files: int = 256, metrics: Metrics | None = None, index_root: str | None = None, quiet_ms: int | None = None):
    """A streaming query over a folder of event files, or over a stream of events, such as folder_events(). Applying a batch again gives the same table, so a restart repeats none of its effects.

    quiet_ms: a path is applied once no event named it for so long, over the borders of batches; None: at the end of each batch.
    """
    events = log_dir if isinstance(log_dir, DataFrame) else spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).json(log_dir)
    if quiet_ms is None:
        run = events.writeStream.foreachBatch(lambda df, _: apply_batch(df, store, read, chunk_and_embed, metrics, index_root))
    else:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)  # the one that keeps timers
        # a batch may hold a path twice, if its quiet time ended between two looks
        last = lambda df: df.groupBy("path").agg(F.max(F.struct("seq", "op")).alias("x")).select("path", "x.op", "x.seq")
        run = debounced_stream(operations(events), quiet_ms).writeStream.foreachBatch(lambda df, _: apply_operations(last(df), store, read, chunk_and_embed, metrics, index_root))
    run = run.option("checkpointLocation", checkpoint)
    return (run.trigger(processingTime=interval) if interval else run.trigger(availableNow=True)).start()


def run_until_signal(query, poll: float = 1.0) -> None:
    """Wait for a streaming query. SIGINT or SIGTERM stops it once its batch is through; a second SIGINT ends the process with 130."""
    asked = []

    def handle(number, _):
        if asked and number == signal.SIGINT:
            os._exit(130)
        asked.append(number)

    before = {x: signal.signal(x, handle) for x in (signal.SIGINT, signal.SIGTERM)}
    try:
        while query.isActive and not asked:
            query.awaitTermination(poll)
        while query.isActive and query.status["isTriggerActive"]:
            time.sleep(min(poll, 0.1))
        query.stop()
    finally:
        for x, h in before.items():
            signal.signal(x, h)
