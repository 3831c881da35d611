"""Debouncing: of the operations on a path, those that follow each other within a quiet time count as one, the last."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from lakequill.runtime import ship

OPERATIONS = "path string, op string, seq long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Quiet(StatefulProcessor):
    """A path's last operation, kept until a timer of the path's own goes off; every operation sets the timer anew."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "op string, seq long, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        before = self.held.get() if self.held.exists() else None
        op, seq = (before[0], before[1]) if before else (None, None)
        for pdf in rows:
            at = pdf.sort_values(["seq", "sub"]).iloc[-1]
            if seq is None or at["seq"] >= seq:
                op, seq = str(at["op"]), int(at["seq"])
        if before:
            self.handle.deleteTimer(before[2])
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.handle.registerTimer(due)
        self.held.update((op, seq, due))
        yield pd.DataFrame({"path": [], "op": [], "seq": []}).astype({"path": object, "op": object, "seq": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        op, seq, _ = self.held.get()
        self.held.clear()
        yield pd.DataFrame({"path": [key[0]], "op": [op], "seq": [seq]})

    def close(self) -> None:
        pass


def debounced_stream(operations: DataFrame, quiet_ms: int = 500) -> DataFrame:
    """(path, op, seq) of a stream of operations (seq, path, op, sub): each path's last one, once no other came for quiet_ms of processing time. The state holds a row for each path that waits, and goes with it."""
    ship(operations.sparkSession)
    return operations.groupBy("path").transformWithStateInPandas(_Quiet(quiet_ms), OPERATIONS, "Append", "ProcessingTime")


def debounced(operations: DataFrame, quiet: str = "500 milliseconds", ts: str = "ts") -> DataFrame:
    """(path, op, seq, first_ts, last_ts, n) of a table of operations (seq, path, op, sub and a time): one row for each run of a path's operations without a gap of quiet; op and seq are the last's, by time, then seq, then sub.

    Sessions are merged where rows lie before they are shuffled; operations without a time or a path are left out.
    """
    last = F.max(F.struct(F.col(ts), F.col("seq"), F.col("sub"), F.col("op")))
    runs = operations.where(F.col(ts).isNotNull() & F.col("path").isNotNull()).groupBy("path", F.session_window(ts, quiet).alias("w")).agg(last.alias("x"), F.min(ts).alias("first_ts"), F.count("*").alias("n"))
    return runs.select("path", F.col("x.op").alias("op"), F.col("x.seq").alias("seq"), "first_ts", F.col(f"x.{ts}").alias("last_ts"), "n")
