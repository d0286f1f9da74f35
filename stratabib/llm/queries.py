"""Registered queries of this subpackage. Each reads its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratabib.llm.components import group_rows
from stratabib.llm.leakage import find_leaks
from stratabib.llm.linkage import link_records
from stratabib.llm.mixing import mix_sources, texts_with_sources
from stratabib.llm.mojibake import find_garbled
from stratabib.llm.survivors import survivors, surviving_records
from stratabib.llm.truncation import find_truncated
from stratabib.llm.variants import link_organisations
from stratabib.runtime import stage, table

MERGED, KEYED, RULES = "merge_three_db", "merge_three_db_dual_key_dedup_year_range", "institution_wikidata_lookup_rules__20260424_132702"


def p1_found(spark, sf_dir):
    return link_records(table(spark, sf_dir, MERGED)).select("rec_id_a", "rec_id_b")


def p1_confidence(spark, sf_dir):
    """Every match with its confidence."""
    return link_records(table(spark, sf_dir, MERGED))


def p4_found(spark, sf_dir):
    return group_rows(table(spark, sf_dir, KEYED)).select("row_id", "group_id")


def _survivors(spark, sf_dir):
    rows = table(spark, sf_dir, KEYED)
    return survivors(rows, stage(group_rows(rows), "groups").df, table(spark, sf_dir, "source_feed"))


def p5_found(spark, sf_dir):
    return _survivors(spark, sf_dir).select("group_id", "field_name", "row_id")


def p5_record(spark, sf_dir):
    """One surviving record per group, with the layer each field came from."""
    return surviving_records(table(spark, sf_dir, KEYED), _survivors(spark, sf_dir))


def p6_found(spark, sf_dir):
    return link_organisations(table(spark, sf_dir, MERGED), table(spark, sf_dir, RULES))


def p7_found(spark, sf_dir):
    return find_garbled(table(spark, sf_dir, MERGED)).select("rec_id", "field_name")


def p7_restored(spark, sf_dir):
    return find_garbled(table(spark, sf_dir, MERGED)).select("rec_id", "field_name", "garbled", "restored")


def _leaks(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark, sf_dir):
    return _leaks(spark, sf_dir).filter("edits = 0").select("doc_id", "item_id")


def p8_near(spark, sf_dir):
    """Passages that were retyped: carried with a few edits, never letter by letter."""
    return _leaks(spark, sf_dir).filter("edits > 0").select("doc_id", "item_id", "edits", F.round("item_share", 6).alias("share"))


def p8_items(spark, sf_dir):
    """Which items leaked, into how many documents, and how much of them."""
    leaks = _leaks(spark, sf_dir)
    return leaks.groupBy("item_id").agg(F.count_if(F.expr("edits = 0")).alias("n_docs"), F.count_if(F.expr("edits = 0 and item_share >= 1.0")).alias("n_whole"), F.count_if(F.expr("edits > 0")).alias("n_near"), F.round(F.max("item_share"), 6).alias("largest_share"))


def _mix(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_found(spark, sf_dir):
    return _mix(spark, sf_dir).shares().filter("falls_short").select("source")


def p9_shares(spark, sf_dir):
    return _mix(spark, sf_dir).shares()


def p9_documents(spark, sf_dir):
    return _mix(spark, sf_dir).documents()


def _shared_mix(spark, sf_dir):
    docs = texts_with_sources(table(spark, sf_dir, "documents"))
    return mix_sources(docs, table(spark, sf_dir, "mix_targets"), members=F.col("members"))


def p9_shared_shares(spark, sf_dir):
    """The mix when each text is used for all sources it stands in: overlapping sources share their tokens by the flow."""
    return _shared_mix(spark, sf_dir).shares()


def p9_shared_reached(spark, sf_dir):
    """Tokens that the chosen documents really give each source, beside what the flow meant them to."""
    mix = _shared_mix(spark, sf_dir)
    given = mix.documents().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("given_tokens"))
    return mix.shares().select("source", "mix_tokens").join(given, "source", "left").select("source", "mix_tokens", F.coalesce("given_tokens", F.lit(0)).alias("given_tokens"))


def _ends(spark, sf_dir):
    return find_truncated(table(spark, sf_dir, "documents"))


def p10_found(spark, sf_dir):
    return _ends(spark, sf_dir).filter("truncated").select("doc_id")


def p10_rates(spark, sf_dir):
    """How often each source truncates."""
    rates = _ends(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("truncated").alias("n_truncated"))
    return rates.withColumn("rate", F.round(F.col("n_truncated") / F.col("n_docs"), 6))


def queries():
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


_P4 = f"""
WITH RECURSIVE r AS (
  SELECT row_id, CASE WHEN trim(standard_doi_key) IN ('', 'nan') THEN NULL ELSE trim(standard_doi_key) END AS k1,
         CASE WHEN trim(meta_dedup_key) IN ('', 'nan') THEN NULL ELSE trim(meta_dedup_key) END AS k2
  FROM {KEYED}),
e AS (
  SELECT row_id AS a, min(row_id) OVER (PARTITION BY k1) AS b FROM r WHERE k1 IS NOT NULL
  UNION SELECT row_id, min(row_id) OVER (PARTITION BY k2) FROM r WHERE k2 IS NOT NULL),
s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
w AS (SELECT a AS node, a AS reach FROM s UNION SELECT w.node, s.b FROM w JOIN s ON w.reach = s.a)
SELECT node AS row_id, min(reach) AS group_id FROM w GROUP BY node
"""


def oracle_sql():
    return {"p4_found": _P4}
