"""Counters, gauges and histograms of runs, in the Prometheus text format, and the same buckets over a DataFrame."""

from __future__ import annotations

import bisect
import threading
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The names and bucket edges that dashboards read.
COUNTERS = ("chunks_indexed_total", "embedding_errors_total", "file_events_processed_total", "search_queries_total")
GAUGES = ("queue_depth", "chunks_total", "files_total", "stale_files_total")
LATENCY = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0)
HISTOGRAMS = {
    "embedding_latency_seconds": (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0),
    "indexing_throughput_chunks_per_second": (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0),
    "search_latency_seconds": LATENCY,
    "http_request_duration_seconds": LATENCY,
}


class Metrics:
    """What one driver has recorded; streaming batches and searches may share it between threads."""

    def __init__(self):
        self._lock = threading.Lock()
        self.values = dict.fromkeys((*COUNTERS, *GAUGES), 0)
        self._seen = {n: ([0] * (len(e) + 1), [0.0]) for n, e in HISTOGRAMS.items()}

    def add(self, counter: str, by: int = 1) -> None:
        if counter not in COUNTERS or by < 0:
            raise ValueError(f"{counter} can't grow by {by}")
        with self._lock:
            self.values[counter] += by

    def set(self, gauge: str, value: float) -> None:
        if gauge not in GAUGES:
            raise ValueError(f"{gauge} isn't a gauge")
        with self._lock:
            self.values[gauge] = value

    def observe(self, histogram: str, value: float) -> None:
        counts, total = self._seen[histogram]
        with self._lock:
            counts[bisect.bisect_left(HISTOGRAMS[histogram], value)] += 1
            total[0] += value

    @contextmanager
    def timed(self, histogram: str):
        """Observe the seconds that the block takes."""
        began = time.monotonic()
        try:
            yield
        finally:
            self.observe(histogram, time.monotonic() - began)

    def render(self) -> str:
        """All metrics in the Prometheus text format."""
        with self._lock:
            out = [f"# TYPE {n} {'counter' if n in COUNTERS else 'gauge'}\n{n} {v:g}" for n, v in self.values.items()]
            for n, (counts, total) in self._seen.items():
                out.append(f"# TYPE {n} histogram")
                edges = [*(f"{e:g}" for e in HISTOGRAMS[n]), "+Inf"]
                out += [f'{n}_bucket{{le="{e}"}} {sum(counts[: i + 1])}' for i, e in enumerate(edges)]
                out.append(f"{n}_sum {total[0]:g}\n{n}_count {sum(counts)}")
        return "\n".join(out) + "\n"


def bucket_counts(values: DataFrame, column: str, histogram: str) -> DataFrame:
    """(le, n): how many values are at most each edge of a histogram, +Inf for all; nulls don't count. One aggregate, whatever the rows."""
    edges = HISTOGRAMS[histogram]
    each = [(f"{e:g}", F.count_if(F.col(column) <= e)) for e in edges] + [("+Inf", F.count(column))]
    one = values.agg(F.array(*(F.struct(F.lit(e).alias("le"), c.alias("n")) for e, c in each)).alias("x"))
    return one.select(F.inline("x"))
