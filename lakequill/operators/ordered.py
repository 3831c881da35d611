"""Places, running sums and last values in an order, without putting a group or the table into one task.

Rows are range-partitioned by group and order and written to the shared folder, so a group of any size lies in as many
partitions as it needs. What a partition holds of a group is summed up in one row; the running total of these rows is
what each partition's own running sums start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakequill.runtime import stored

PART, TIE, AT = "_lq_part", "_lq_tie", "at"


def ranged(df: DataFrame, within: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df with _lq_part and _lq_tie, stored: partitions are ranges of (within, order); equal rows are told apart by _lq_tie."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn(TIE, F.monotonically_increasing_id())
    return stored(tied.repartitionByRange(n, *within, *order, TIE).withColumn(PART, F.spark_partition_id()), "ranged")


def numbered(df: DataFrame, order: list[str], within: list[str] = (), sums: dict[str, str] | None = None, parts: int | None = None) -> DataFrame:
    """df with `at`, each row's place from 0 in its group by the order's columns, ascending, nulls first, equal rows in any order.

    within: columns of the group, not null; none: the table is one group. sums: name to column; each name becomes the
    sum of the column, which is a number and not null, over the rows before. An empty table stays empty.
    """
    within, sums = list(within), sums or {}
    rows = ranged(df, within, order, parts)
    total = rows.groupBy(PART, *within).agg(F.count("*").alias("_n"), *(F.sum(c).alias(f"_s{i}") for i, c in enumerate(sums.values())))
    before = Window.partitionBy(*within or [F.lit(0)]).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition that has the group
    none = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = total.select(PART, *within, none("_n").alias("_n0"), *(none(f"_s{i}").alias(f"_b{i}") for i in range(len(sums))))
    own = Window.partitionBy(PART, *within).orderBy(*order, TIE)
    run = own.rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, [PART, *within]).withColumn(AT, F.col("_n0") + F.row_number().over(own) - 1)
    for i, (name, c) in enumerate(sums.items()):
        out = out.withColumn(name, F.col(f"_b{i}") + F.coalesce(F.sum(c).over(run), F.lit(0)))
    return out.select(*df.columns, AT, *sums)


def last_before(df: DataFrame, order: list[str], within: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """df with name: the last value, not null, at or before each row of its group; null where there is none."""
    rows = ranged(df, list(within), order, parts)
    end = F.max_by(value, F.struct(*order, TIE)).alias("_v")
    ends = rows.where(F.col(value).isNotNull()).groupBy(PART, *within).agg(end)
    before = Window.partitionBy(*within).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    held = rows.select(PART, *within).distinct().join(ends, [PART, *within], "left").select(PART, *within, F.last("_v", True).over(before).alias("_v0"))
    own = Window.partitionBy(PART, *within).orderBy(*order, TIE).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(held, [PART, *within]).withColumn(name, F.coalesce(F.last(value, True).over(own), F.col("_v0")))
    return out.select(*df.columns, name)
