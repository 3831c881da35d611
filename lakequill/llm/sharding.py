"""Sharding along a Hilbert curve, in DataFrame functions only.

Several metadata columns are quantised into cells that hold about equally many rows, the cells' coordinates become an
index on a Hilbert curve, rows are ordered by it, and the order is cut into runs. Rows that are alike in all of the
columns lie together, so the files of a shard have narrow ranges in every one of them and a reader can skip most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm.common import discard, shared_path, stored
from lakequill.operators.ordered import numbered

SHARDS, BITS = 8, 4


def hilbert_index(axes: list, bits: int = BITS):
    """The place on a Hilbert curve of a cell whose coordinates, columns from 0 to 2**bits - 1, are given.

    Two steps: the coordinates are reflected and exchanged from the highest bit down so that they follow the curve's
    turns, then their bits are interleaved and decoded as a Gray code.
    """
    n, whole = len(axes), [1 << k for k in range(bits - 1, -1, -1)]
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(q).alias("q")) for q in whole for i in range(n)))

    def turn(x, step):
        """One axis at one bit q: reflect the first coordinate's lower bits where the axis has the bit, else exchange them."""
        low, own, first = step["q"] - 1, F.get(x, step["i"]), F.get(x, F.lit(0))
        swap, has = first.bitwiseXOR(own).bitwiseAND(low), own.bitwiseAND(step["q"]) != 0
        head = first.bitwiseXOR(F.when(has, low).otherwise(swap))
        return F.transform(x, lambda v, j: F.when(j == 0, head).when((j == step["i"]) & ~has, v.bitwiseXOR(swap)).otherwise(v))

    turned = F.aggregate(steps, F.array(*(a.cast("int") for a in axes)), turn)

    def bit(s, step):
        """Append a bit: the parity of all interleaved bits up to it."""
        p = s["p"].bitwiseXOR(F.when(F.get(s["x"], step["i"]).bitwiseAND(step["q"]) != 0, 1).otherwise(0))
        return F.struct(s["x"].alias("x"), p.alias("p"), (s["h"] * 2 + p).alias("h"))

    start = F.struct(turned.alias("x"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("h"))
    return F.aggregate(steps, start, bit, lambda s: s["h"])


def cells(df: DataFrame, dim: str, bits: int = BITS) -> list[tuple]:
    """(lowest value, cell) of the cells of a column, by value; a cell's number says which 2**bits-th of the rows begins with it.

    All values are counted, each once for its rows; values aren't split, so a frequent one takes the numbers that follow.
    At most 2**bits rows reach the driver.
    """
    counted = df.groupBy(F.col(dim).alias("v")).agg(F.count("*").alias("n"))
    placed = stored(numbered(counted, ["v"], sums={"before": "n"}), "values")
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total"))
    of_cell = placed.crossJoin(F.broadcast(total)).groupBy(F.expr(f"int(before * {1 << bits} div total)").alias("cell")).agg(F.min(F.struct(F.col("v").isNotNull().alias("some"), "v")).alias("low"))
    found = sorted((r["cell"], r["low"]["v"]) for r in of_cell.collect())
    discard(placed)
    return [(low, cell) for cell, low in found]


def cell_of(value, bounds: list[tuple], kind):
    """The cell of a value column by the bounds that cells() gave; null values have the cell 0."""
    out = F.lit(0)
    for low, number in bounds:
        out = out if low is None else F.when(value >= F.lit(low).cast(kind), number).otherwise(out)
    return F.when(value.isNull(), 0).otherwise(out)


def curve_order(docs: DataFrame, dims: list[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """docs with the Hilbert index of each row's cell in dims. Any column that has an order can be one; nulls come first."""
    axes = [cell_of(F.col(d), cells(docs, d, bits), docs.schema[d].dataType) for d in dims]
    return docs.withColumn(name, hilbert_index(axes, bits))


def shards(docs: DataFrame, dims: list[str], ties: list[str], n: int = SHARDS, law: str = "rows", size: str | None = None, bits: int = BITS) -> DataFrame:
    """docs with curve, shard (0 to n - 1) and slot (place in the shard from 0, gapless): runs of the curve's order.

    dims: the columns to quantise; ties: columns that order the rows of a cell, after which equal rows come in any
    order. law rows: shards hold equal numbers of rows, or one more. law bytes: they hold equal sums of size, not null and
    above 0, but for the size of the rows at the cuts. All of docs' columns stay, except that curve, shard and slot are
    replaced. Nulls in dims have the first cell; an empty table stays empty.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law {law}")
    own = [f"_lq_tie{i}" for i in range(len(ties))]
    rows = curve_order(docs, dims, bits, "_lq_curve").select("_lq_curve", *(F.col(t).alias(o) for t, o in zip(ties, own)), F.lit(1).cast("long").alias("_lq_one") if law == "rows" else F.col(size).alias("_lq_one"), F.struct(*docs.columns).alias("_lq_row"))
    placed = stored(numbered(rows, ["_lq_curve", *own], sums={"_lq_before": "_lq_one"}), "placed")
    total = placed.agg(F.sum("_lq_one").alias("_lq_all"))
    # whole numbers: of rows the place decides, of bytes the middle of the row's
    shard = F.expr(f"_lq_before * {n} div _lq_all") if law == "rows" else F.expr(f"(2 * _lq_before + _lq_one) * {n} div (2 * _lq_all)")
    cut = placed.crossJoin(F.broadcast(total)).withColumn("_lq_shard", shard.cast("int"))
    first = cut.groupBy("_lq_shard").agg(F.min("at").alias("_lq_first"))  # n rows
    kept = [F.col(f"_lq_row.`{c}`").alias(c) for c in docs.columns if c not in ("curve", "shard", "slot")]
    return cut.join(F.broadcast(first), "_lq_shard").select(*kept, F.col("_lq_curve").alias("curve"), F.col("_lq_shard").alias("shard"), (F.col("at") - F.col("_lq_first")).alias("slot"))


def write_shards(sharded: DataFrame, dims: list[str], root: str | None = None, rows_per_file: int = 100_000) -> DataFrame:
    """Write the rows of shards() as Parquet below root, a folder for each shard, in the curve's order; the manifest.

    The manifest has a row for each file: uri, shard, n_rows, and low_d and high_d for each d of dims, nulls left out.
    A file holds rows_per_file rows at most.
    """
    spark = sharded.sparkSession
    root = root or shared_path(spark, "shards")
    run = F.floor(F.col("slot") / rows_per_file).cast("long")
    dealt = sharded.withColumn("_lq_run", run).repartitionByRange("shard", "_lq_run", "slot").sortWithinPartitions("shard", "_lq_run", "slot")
    dealt.drop("_lq_run").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(root)
    ranges = [f(d).alias(f"{k}_{d}") for d in dims for k, f in (("low", F.min), ("high", F.max))]
    back = spark.read.parquet(root).select(*dims, "shard", F.col("_metadata.file_path").alias("uri"))
    return stored(back.groupBy("uri", "shard").agg(F.count("*").alias("n_rows"), *ranges), "shard-manifest")


def pruned(manifest: DataFrame, **ranges) -> DataFrame:
    """The manifest's files that can hold rows with low <= d <= high for every d=(low, high)."""
    for d, (low, high) in ranges.items():
        manifest = manifest.where((F.col(f"low_{d}") <= F.lit(high)) & (F.col(f"high_{d}") >= F.lit(low)))
    return manifest
