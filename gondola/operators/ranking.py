"""Places in an order over all rows, without a window that has them all in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gondola.sources.folders import stored

#: The rows of a partition are numbered in the low bits of the id that Spark gives them.
LOW_BITS = 33
#: Shares of a group whose first rows are found apart.
SHARES = 32


def with_place(df: DataFrame, order: list[Column], name: str = "puesto", within: list[str] | None = None) -> DataFrame:
    """df with its place (long, from 1) in the order, or in the order within groups of some columns; the order should be total.

    Rows are sorted over range partitions; a partition's places begin where the counts of those before it end, and
    a group's where the rows of groups before it end. One row a partition and one row a group are
    added up, the rows themselves stay where they are.
    """
    keys = [*(F.col(c) for c in within or []), *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranged = stored(ranged.withColumn("_m", F.monotonically_increasing_id()), "ranged").withColumn("_p", F.shiftright("_m", LOW_BITS))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", before).drop("_n")  # a row a partition
    out = ranged.join(F.broadcast(starts), "_p").withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << LOW_BITS) - 1)) + 1)
    if within:
        first = out.groupBy(*within).agg(F.min(name).alias("_first"))
        same = F.lit(True)
        for c in within:
            same = same & F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
        out = out.alias("x").join(first.alias("y"), same).select("x.*", "y._first").withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")
    return out.drop("_m", "_p", "_before")


def first_rows(df: DataFrame, within: list[str], order: list[Column], most: int, row: str, name: str = "puesto") -> DataFrame:
    """The first most rows of each group with their place; shares of a group (by a hash of row) are cut down apart first, so no task ranks a whole group."""
    share = df.withColumn("_share", F.pmod(F.xxhash64(row), F.lit(SHARES)))
    few = share.withColumn("_n", F.row_number().over(W.partitionBy(*within, "_share").orderBy(*order))).where(F.col("_n") <= most).drop("_n", "_share")
    return few.withColumn(name, F.row_number().over(W.partitionBy(*within).orderBy(*order)).cast("long")).where(F.col(name) <= most)
