"""The batch index run: discover, chunk, skip what is unchanged, embed, replace, prune, report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.functions.format import summary
from lakequill.operators.assets import AssetCache, synthetic_texts
from lakequill.operators.chunking import chunk_files, with_hash, with_id
from lakequill.operators.embed import embed_chunks
from lakequill.operators.metrics import Metrics
from lakequill.operators.store import ChunkStore, change_status, model_guard
from lakequill.operators.store import status as totals
from lakequill.sources import files

#: Of rows (file_path, status) of change_status(): what a run embeds, and what counts as a file rather than an asset.
IS_STALE, IS_NOTE = "status in ('new', 'changed')", "file_path like '%.md'"


def run_counters(status: DataFrame) -> DataFrame:
    """One row for change_status() rows: files_indexed, files_skipped, files_missing, as index() counts notes."""
    notes = status.where(IS_NOTE)
    return notes.agg(F.count_if(F.expr(IS_STALE)).alias("files_indexed"), F.count_if(F.col("status") == "unchanged").alias("files_skipped"), F.count_if(F.col("status") == "missing").alias("files_missing"))


def index(spark: SparkSession, root: str, store: ChunkStore, embed, model: str, width: int, force: bool = False, extractor=None, exclude=(), cache: AssetCache | None = None, metrics: Metrics | None = None) -> dict[str, int]:
    """Bring the store up to date with the folder; the six counters. Files are chunked in one job, only changed ones are embedded, and all changes are published at once. Assets whose bytes the cache knows aren't extracted again."""
    if model_guard(store.read(), model, force):
        store.delete_all()
    rows = files.listed(spark, root, strict=extractor is not None)
    found = files.markdown_paths(rows)
    read = files.read_texts(spark, root, found).cache()
    errors = read.where("error is not null").count()
    good = read.where("error is null")
    chunks = with_id(with_hash(chunk_files(good)))
    paths = files.asset_paths(spark, root, rows, exclude=exclude).cache() if extractor is not None else None
    n_assets = paths.count() if paths is not None else 0
    if n_assets:
        assets = synthetic_texts(spark, root, paths, extractor, cache)
        bad = assets.where("error is not null").orderBy("file_path").first()
        if bad:
            raise ValueError(f"{bad['file_path']}: {bad['error']}")
        chunks = chunks.unionByName(with_id(with_hash(chunk_files(assets))))
    chunks = chunks.cache()
    status = change_status(chunks, store.read())
    stale = status.where(IS_STALE).select("file_path").cache()
    emptied = good.select("file_path").join(chunks.select("file_path"), "file_path", "left_anti")
    fresh = embed_chunks(chunks.join(stale, "file_path", "left_semi"), embed, model, width).cache()
    embedded, total, n_files = fresh.count(), chunks.count(), stale.where(IS_NOTE).count()
    if embedded or emptied.join(store.read().select("file_path"), "file_path", "left_semi").limit(1).count():
        store.replace(fresh, stale.unionAll(emptied))
    pruned = store.prune(found)
    if metrics is not None:
        now = totals(store.read()).first()
        metrics.add("chunks_indexed_total", embedded)
        metrics.set("chunks_total", now["total_chunks"])
        metrics.set("files_total", now["total_files"])
    for df in (read, chunks, stale, fresh, *([paths] if paths is not None else [])):
        df.unpersist()
    return summary({"files_indexed": n_files, "assets_indexed": n_assets, "chunks_embedded": embedded, "chunks_skipped": total - embedded, "errors": errors, "orphan_files_removed": pruned})
