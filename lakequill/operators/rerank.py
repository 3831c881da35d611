"""A reranker that asks a language model: the prompt for a search's candidates, and the order that its answer gives."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakequill.functions.text import excerpt, rerank_indices

EXCERPT_BYTES = 800
TASK = (
    "Order the numbered notes below by how well they answer the query, best first.\n"
    'Answer with one JSON object and nothing else: {"indices": [...]}, where indices holds every note\'s number, '
    "counted from 0, exactly once."
)


class RerankError(ValueError):
    """The answer doesn't hold every candidate's number once; the search fails."""


@dataclass
class PromptReranker:
    """ask: from a prompt to the model's answer, called once for a search, on the driver."""

    ask: Callable[[str], str]

    def order(self, query: str, candidates: DataFrame) -> list[int]:
        """Places of the candidates (result_index, file_path, heading_breadcrumb, line_start, line_end, body), best first."""
        shown = [r[0] for r in blocks(candidates).collect()]  # a search's pool: 48 rows at most
        return order_of(candidates.sparkSession, self.ask(prompt(query, shown)), len(shown))


def blocks(candidates: DataFrame) -> DataFrame:
    """(block): each candidate as the prompt shows it, in order of result_index; bodies by their first 800 bytes, rounded down to a character."""
    head = F.format_string("note %d\nfile: %s\nheading: %s\nlines: %d-%d\n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("result_index")) - 1, "file_path", "heading_breadcrumb", "line_start", "line_end")
    return candidates.select("result_index", F.concat(head, excerpt(F.col("body"), EXCERPT_BYTES)).alias("block")).orderBy("result_index").select("block")


def prompt(query: str, shown: list[str]) -> str:
    return "\n\n".join([TASK, f"Query: {query}", *shown])


def order_of(spark: SparkSession, answer: str, n: int) -> list[int]:
    """The indices of an answer: of the whole text where it is such an object, else of what stands from its first { to its last }."""
    got = spark.range(1).select(rerank_indices(F.lit(answer)).alias("x")).first()["x"]
    if got is None or sorted(-1 if i is None else i for i in got) != list(range(n)):
        raise RerankError(f"the reranker's answer isn't an order of {n} candidates")
    return list(got)
