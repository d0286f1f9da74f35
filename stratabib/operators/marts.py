"""Tables for figures and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: str, order: list, n: int, name: str = "place") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col(name) <= n)


def overview(df: DataFrame, group: str, rank_by: str, terms: str, n_terms: int) -> DataFrame:
    """Groups by rank with their first distinct terms; ``terms`` is an array in order."""
    return df.select(group, rank_by, F.array_join(F.slice(F.array_distinct(F.filter(terms, lambda t: t != "")), 1, n_terms), " | ").alias("keywords"), F.row_number().over(W.orderBy(F.desc(rank_by), group)).alias("place"))


def field_catalog(tables: dict[str, DataFrame], meanings: dict[tuple[str, str], str]) -> DataFrame:
    """Every table's fields with type and meaning."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, c, kind, meanings.get((t, c), "")) for t, df in tables.items() for i, (c, kind) in enumerate(df.dtypes, 1)]
    return spark.createDataFrame(rows, "table_name string, position int, field string, type string, meaning string")


def markdown(df: DataFrame, limit: int = 50) -> str:
    """A small table as text; a report shows at most ``limit`` rows."""
    rows = df.limit(limit).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
