"""Output formats of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_json_rows(results: DataFrame) -> DataFrame:
    """One JSON object for each result; scores and context fields that are null are left out."""
    fields = ["body", "file_path", "heading_breadcrumb", "similarity_score", "semantic_score", "fts_score"]
    own = F.struct(*fields, F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end")).alias("line_range"), F.when(F.col("is_context"), True).alias("is_context"), "context_for_index")
    return results.orderBy("ordinal").select(F.to_json(own, {"ignoreNullFields": "true"}).alias("json"))


def pretty_rows(results: DataFrame) -> DataFrame:
    """One text block for each result; the number counts rows that aren't context; a body of over 200 bytes is cut between characters."""
    from lakequill.functions.text import excerpt

    w = Window.partitionBy(F.lit(0)).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shown = F.sum(F.when(~F.col("is_context"), 1).otherwise(0)).over(w)  # results of one search: a bounded list
    prefix = F.when(F.col("is_context"), F.lit("[ctx]")).otherwise(F.format_string("[%d]", shown))
    head = F.format_string("%s %s -- %s  (score: %.2f)", prefix, "file_path", "heading_breadcrumb", "similarity_score")
    return results.select("ordinal", F.concat_ws("\n", head, F.lit("═" * 40), "heading_breadcrumb", excerpt(F.col("body"), 200, "\n[truncated]")).alias("block")).orderBy("ordinal")


def summary(counters: dict[str, int]) -> dict[str, int]:
    """The six counters of an index run; those not given are 0."""
    names = ("files_indexed", "assets_indexed", "chunks_embedded", "chunks_skipped", "errors", "orphan_files_removed")
    return {k: int(counters.get(k, 0)) for k in names}
