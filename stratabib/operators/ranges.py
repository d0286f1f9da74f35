"""Numbers over a whole table's order, found by ranges: no task holds more than a block of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratabib.runtime import stage


def row_numbers(df: DataFrame, order: list[str | Column], name: str, block: int = 100_000) -> DataFrame:
    """Adds ``name``: the place of each row from 1 in the given order, which must tell all rows apart.

    Rows are ranged into blocks and counted per block; blocks are offset by the counts before them (one row a block), and only
    within a block are rows numbered.
    """
    n = max(1, -(-df.count() // block))
    kept = stage(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranges").df
    before = F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    offset = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(before, F.lit(0)).alias("_off"))
    place = F.row_number().over(W.partitionBy("_p").orderBy(*order)) + F.col("_off")
    return kept.join(F.broadcast(offset), "_p").withColumn(name, place).drop("_p", "_off")


def in_own_order(df: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: rows numbered from 1 as the table gives them, by partition and then within."""
    kept = stage(df.withColumn("_at", F.monotonically_increasing_id()), "own-order").df
    part = F.shiftright("_at", 33)
    before = F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    offset = kept.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).select("_p", F.coalesce(before, F.lit(0)).alias("_off"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("_p", part).join(F.broadcast(offset), "_p").withColumn(name, inside + F.col("_off") + 1).drop("_p", "_off", "_at")
