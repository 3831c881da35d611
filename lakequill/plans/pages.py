"""The rows behind the web pages: search results, the files of the index, status and settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakequill.functions.text import highlight, preview, round2
from lakequill.operators.search import SearchOptions, search
from lakequill.operators.store import chunks_per_file, status

# Fixed values of the pages.
PAGE_LIMIT = 20
UNKNOWN = "—"
MODES = ("semantic", "fts", "hybrid")


def result_rows(results: DataFrame, query: str) -> DataFrame:
    """(file_path, heading_breadcrumb, chunk_html, similarity_score) of the results that aren't context: a marked preview and a score of two places, in order of `ordinal` where there is one."""
    own = results.where(~F.col("is_context"))
    own = own.orderBy("ordinal") if "ordinal" in results.columns else own
    return own.select("file_path", "heading_breadcrumb", highlight(preview(F.col("body")), query).alias("chunk_html"), round2(F.col("similarity_score")).alias("similarity_score"))


def search_rows(chunks: DataFrame, q: str = "", mode: str | None = None, embed=None, rerank=None, no_rerank: bool = False, want_rerank: bool | None = None, index_root: str | None = None) -> DataFrame:
    """The search page's rows: 20 results, none for an empty query; an unknown mode is hybrid; a reranker that is there runs unless it is refused."""
    mode = mode if mode in MODES else "hybrid"
    if not q:
        return result_rows(chunks.limit(0).withColumn("is_context", F.lit(False)).withColumn("similarity_score", F.lit(0.0)), q)
    use = rerank if not no_rerank and want_rerank is not False else None
    return result_rows(search(chunks, SearchOptions(query=q, limit=PAGE_LIMIT, mode=mode, embed=embed, rerank=use), index_root), q)


def index_rows(chunks: DataFrame) -> DataFrame:
    """(file_path, chunk_count, last_indexed): the files of the index; when each was indexed isn't tracked."""
    return chunks_per_file(chunks).select("file_path", F.col("chunks").alias("chunk_count"), F.lit(UNKNOWN).alias("last_indexed"))


def status_row(chunks: DataFrame, model: str, dimensions: int) -> DataFrame:
    """One row: the totals, and what the embeddings are of."""
    own = status(chunks).drop("last_index_time")
    return own.select("*", F.lit(UNKNOWN).alias("last_index_time"), F.lit(model).alias("embedding_model"), F.lit(dimensions).alias("embedding_dimensions"), F.col("total_chunks").alias("total_embeddings"), F.lit("N/A").alias("token_usage"))


def settings_row(spark: SparkSession, data_dir: str, bind_addr: str, embedding_provider: str, credential_source: str, log_level: str) -> DataFrame:
    """One row of the settings in force; credentials are named by their source alone."""
    return spark.createDataFrame([(data_dir, bind_addr, embedding_provider, credential_source, log_level)], "data_dir string, bind_addr string, embedding_provider string, credential_source string, log_level string")
