"""Vector best-fit packing of token pieces.

Every sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths). Bins that
are equal in all residuals are one class with a count, and pieces of one length are one demand, so the plan is made
over at most `tokens` lengths, however many pieces there are. Demands go longest first; each goes to the class
that fits under every constraint and scores best: the largest weighted dot product of residual and demand, or the
smallest weighted norm of what would be left. The plan is a list of (length, first rank, last rank, first bin,
offset); pieces find their line by their rank among those of their length.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakequill.llm.common import ship, stored, text_or_empty

#: Tasks over which the pieces of one length are spread, at least, while they are ranked, and pieces of a task beyond which there are more.
SALTS, RANKED = 64, 1_000_000


@dataclass(frozen=True)
class Capacity:
    """Constraints of a sequence. attention None: as much as `tokens` squared, which never binds before tokens do."""

    tokens: int = 1024
    documents: int = 1024
    attention: int | None = None
    rule: str = "norm"  # or "dot"
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)

    def limits(self) -> tuple[int, int, int]:
        return self.tokens, self.documents, self.attention or self.tokens**2


def plan(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first bin, offset) lines that place counts[length] pieces of each length.

    Pieces of rank r in a line go to bin first bin + r - first rank, at that offset. A length that no empty
    bin can hold raises ValueError.
    """
    limits = capacity.limits()
    scale = np.array([w / c for w, c in zip(capacity.weights, limits)])
    limit = np.array(limits, float)
    # open classes: residual vector -> ranges of bins [first, end) with these residuals
    classes: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    bins, lines = 0, []
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        demand = (length, 1, length * length)
        if any(d > c for d, c in zip(demand, limits)) and left:
            raise ValueError(f"no sequence can hold a piece of {length} tokens")
        d = np.array(demand, float) * scale
        while left:
            open_ = [r for r in classes if r[0] >= demand[0] and r[1] >= 1 and r[2] >= demand[2]]
            if open_:
                res = np.array(open_, float) * scale
                score = res @ d if capacity.rule == "dot" else -(((res - d) ** 2).sum(1))
                best = open_[int(np.lexsort((np.array([-r[0] for r in open_]), score))[-1])]
                ranges = classes[best]
                first, end = ranges.pop()
                n = min(left, end - first)
                if first + n < end:
                    ranges.append((first + n, end))
                if not ranges:
                    del classes[best]
            else:
                best, first = limits, bins
                # as many empty bins as these pieces need at their fullest: the class then takes its next pieces
                fit = max(1, min(limits[0] // max(length, 1), limits[1], limits[2] // max(length * length, 1)))
                n = -(-left // fit)
                bins += n
            lines.append((length, rank, rank + n, first, limits[0] - best[0]))
            rest = (best[0] - demand[0], best[1] - 1, best[2] - demand[2])
            if rest[0] > 0 and rest[1] > 0:
                classes.setdefault(rest, []).append((first, first + n))
            rank += n
            left -= n
    return lines


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first may be shorter."""
    head = n % most or most
    return [(0, min(head, n))] + [(s, most) for s in range(head, n, most)]


def _pieces(path: str, most: int, end_id: int, with_ids: bool):
    def run(batches):
        import pyarrow as pa

        from lakequill.llm.coder import coder

        encode, end = coder(path).encode, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for i, text in enumerate(batch.column("_lq_text").to_pylist()):
                ids = encode(text) + end
                for k, (s, n) in enumerate(cut(len(ids) // 4, most)):
                    part = ids[4 * s : 4 * (s + n)]
                    for to, v in zip(rows, (i, k, s, n, zlib.crc32(part), part if with_ids else None)):
                        to.append(v)
            arrays = [batch.column("_lq_id").take(pa.array(rows[0], pa.int64())), *(pa.array(r, t) for r, t in zip(rows[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), end_id: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (little-endian unsigned 32-bit; null unless with_ids).

    A document is its whole text's ids, then end_id; longer ones than capacity.tokens are cut, the first piece may be
    shorter. Null and empty texts are the end id alone. Repeated rows are packed each; null ids stay. Ties between
    pieces of one length go by doc_id, piece and crc. An empty table gives an empty result. Further columns are ignored.
    The driver holds counts by length (capacity.tokens at most, times SALTS, and one for every RANKED pieces) and the plan, never pieces.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("_lq_id"), text_or_empty(text).alias("_lq_text"))
    pieces = read.mapInArrow(_pieces(tokenizer, capacity.tokens, end_id, with_ids), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    pieces = stored(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    hot = {r["length"]: r["count"] // RANKED for r in pieces.groupBy("length").count().where(F.col("count") >= SALTS * RANKED).collect()}
    salts = F.coalesce(F.create_map(*(F.lit(x) for kv in hot.items() for x in kv))[F.col("length")], F.lit(SALTS)) if hot else F.lit(SALTS)
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("_row"), salts).cast("int"))
    totals = sorted((r["length"], r["_salt"], r["count"]) for r in pieces.groupBy("length", "_salt").count().collect())
    counts: dict[int, int] = {}
    before = []
    for n, salt, c in totals:
        before.append((n, salt, counts.get(n, 0)))
        counts[n] = counts.get(n, 0) + c
    lines = plan(counts, capacity)
    by_length: dict[int, list] = {}
    for n, *line in lines:
        by_length.setdefault(n, []).append(line)
    ranked = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32", "_row")) - 1)
    starts = spark.sparkContext.broadcast({(n, s): b for n, s, b in before})
    shipped = spark.sparkContext.broadcast({n: ([x[0] for x in xs], xs) for n, xs in by_length.items()})

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            bins, offsets = [], []
            for n, salt, r in zip(batch.column("length").to_pylist(), batch.column("_salt").to_pylist(), batch.column("_rank").to_pylist()):
                r += starts.value[n, salt]
                firsts, xs = shipped.value[n]
                a, _, b, off = xs[bisect.bisect_right(firsts, r) - 1]
                bins.append(b + r - a)
                offsets.append(off)
            keep = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(bins, pa.int64()), pa.array(offsets, pa.int64()), batch.column("ids")], names=[*keep.schema.names, "sequence_id", "offset", "ids"])

    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")
