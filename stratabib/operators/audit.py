"""Quality audit: residual duplicates and DOI conflicts, classified and applied."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratabib.functions import text as T
from stratabib.operators.ranges import row_numbers

MERGE, MANUAL, KEEP = "建议合并", "需人工判断", "建议保留"
#: Title words of corrections, honours and front matter (fixed values).
MARKERS = ["retraction", "erratum", "correction", "corrigendum", "award", "awards", "eulogy", "obituary", "editorial", "preface", "introduction", "confronting racism"]


def loose_key(title: Column, year: Column, author_key: Column, shortest: int = 8) -> Column:
    """title|year|author for rows that have no key of their own; '' if one is missing."""
    return F.when((F.length(title) >= shortest) & (year != "") & (author_key != ""), F.concat_ws("|", title, year, author_key)).otherwise("")


def candidate_groups(df: DataFrame, key: str, order: list[str], prefix: str, distinct: str | None = None) -> DataFrame:
    """Rows of keys with several rows (several values of ``distinct``, if given), with group id and number in the group.

    Numbers follow ``order`` over groups; ids such as R001 are given to the few groups under review, after an aggregation.
    """
    count = F.count_distinct(F.nullif(F.col(distinct), F.lit(""))) if distinct else F.count(F.lit(1))
    groups = df.filter(F.col(key) != "").groupBy(key).agg(count.alias("_n"), *(F.min(c).alias(f"_o{i}") for i, c in enumerate(order))).filter("_n > 1")
    placed = row_numbers(groups, [*(f"_o{i}" for i in range(len(order))), key], "_place")
    numbered = placed.select(key, F.format_string(f"{prefix}%03d", F.col("_place")).alias("group_id"))
    rows = df.join(numbered, key)
    return rows.withColumns({"row_no": F.row_number().over(W.partitionBy("group_id").orderBy(*order, *[c for c in ("row_id", "rec_id") if c in df.columns])), "group_rows": F.count(F.lit(1)).over(W.partitionBy("group_id"))})


def overview(rows: DataFrame, title: str, journal: str, source: str, institution: str | None = None) -> DataFrame:
    """Per group: size, sources, journals after normalisation, variants."""
    j = T.ascii_key(journal)
    out = [
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct(source).alias("n_sources"), F.count_distinct(F.when(j != "", j)).alias("n_journals"), F.min(title).alias("title"),
        F.array_join(F.array_sort(F.collect_set(source)), "|").alias("source_combo"),
    ]
    if institution:
        inst = T.ascii_key(institution)
        out.append(F.count_distinct(F.when(inst != "", inst)).alias("n_institutions"))
    return rows.groupBy("group_id").agg(*out)


def residual_action(o: DataFrame) -> DataFrame:
    """Decision for groups of rows alike in title, year and first author."""
    many, same = F.col("n_sources") > 1, F.col("n_journals") == 1
    return o.withColumns({
        "action": F.when(many & same, MERGE).when(~many & same & (F.col("n_institutions") <= 1), MERGE).when(~many & same, MANUAL).when(~many, KEEP).otherwise(MANUAL),
        "confidence": F.when(same & (many | (F.col("n_institutions") <= 1)), "高").otherwise("中"),
    })


def conflict_action(o: DataFrame) -> DataFrame:
    """Decision for groups with one metadata key and several DOIs."""
    t = F.lower("title")
    marks = F.filter(F.array(*(F.lit(m) for m in MARKERS)), lambda m: F.contains(t, m))
    marks = F.when(F.contains(t, F.lit("(vol ")) | F.contains(t, F.lit(" vol ")), F.concat(marks, F.array(F.lit("vol-reference")))).otherwise(marks)
    o = o.withColumn("markers", F.array_join(marks, "、"))
    return o.withColumn("action", F.when(F.col("n_journals") != 1, KEEP).when(F.col("markers") != "", KEEP).otherwise(MANUAL))


def annotate(rows: DataFrame, overviews: DataFrame, classify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every row with the decision a classifier makes for its group."""
    decided = classify(overviews)
    return rows.join(decided.select("group_id", *[c for c in ("action", "confidence", "markers") if c in decided.columns]), "group_id")


def apply_merges(df: DataFrame, approved: DataFrame, fused: DataFrame, key: str) -> DataFrame:
    """The table with each approved group replaced by its fused row."""
    return df.join(approved.select(key).distinct(), key, "left_anti").unionByName(fused)
