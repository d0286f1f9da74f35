"""Queries of the general preparation operators: packed fields and mixed timestamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratabib.operators.packed_values import split_fields
from stratabib.operators.timestamps import normalise_timestamps
from stratabib.runtime import table

MERGED = "merge_three_db"


def p2_found(spark, sf_dir):
    return split_fields(table(spark, sf_dir, MERGED))


def _dates(spark, sf_dir):
    return normalise_timestamps(table(spark, sf_dir, MERGED), table(spark, sf_dir, "source_feed"))


def p3_found(spark, sf_dir):
    return _dates(spark, sf_dir).filter("publish_norm <> raw").select("rec_id", "publish_norm")


def p3_formats(spark, sf_dir):
    """How each source writes its dates."""
    return _dates(spark, sf_dir).groupBy("source_db", "format").agg(F.count(F.lit(1)).alias("n"))


def queries():
    return {"p2_found": p2_found, "p3_found": p3_found, "p3_formats": p3_formats}


def oracle_sql():
    return {}
