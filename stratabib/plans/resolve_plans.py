"""Queries over entity resolution and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratabib.functions import text as T
from stratabib.operators import audit as A
from stratabib.operators import resolve as R
from stratabib.operators.corpus import unstable_keys
from stratabib.plans import sql as S
from stratabib.runtime import table

MERGED, KEYED = "merge_three_db", "merge_three_db_dual_key_dedup_year_range"
FIELDS = ["title_en", "title_cn", "author", "year", "journal_en", "doi", "abstract_en", "cited_count"]
K1, K2 = S.text("standard_doi_key"), S.text("meta_dedup_key")


def _keyed(spark, d):
    return table(spark, d, KEYED)


def entity_components(spark, d):
    """Component of every keyed row over both keys."""
    return R.components(_keyed(spark, d), "row_id", ["standard_doi_key", "meta_dedup_key"])


SQL_COMPONENTS = f"""
WITH RECURSIVE r AS (SELECT row_id, nullif({K1}, '') AS k1, nullif({K2}, '') AS k2 FROM {KEYED}),
e AS (SELECT row_id AS a, min(row_id) OVER (PARTITION BY k1) AS b FROM r WHERE k1 IS NOT NULL UNION SELECT row_id, min(row_id) OVER (PARTITION BY k2) FROM r WHERE k2 IS NOT NULL),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
w AS (SELECT row_id AS node, row_id AS reach FROM r UNION SELECT w.node, s.b FROM w JOIN s ON w.reach = s.a)
SELECT node AS row_id, min(reach) AS component FROM w GROUP BY node"""


def merged_in_order(spark, d):
    """Groups under the sequential merge rule, in order of source and row."""
    rows = _keyed(spark, d).withColumn("rank", F.when(F.col("source_db") == "CNKI", 0).when(F.col("source_db") == "WOS", 1).otherwise(2))
    return R.merge_in_order(rows, "row_id", "standard_doi_key", "meta_dedup_key", ["rank"])


def merged_by_three_keys(spark, d):
    """The same with each source's own identifiers as a third key, DOIs of several works left out."""
    rows = _keyed(spark, d).withColumns({"rank": F.when(F.col("source_db") == "CNKI", 0).when(F.col("source_db") == "WOS", 1).otherwise(2), "own": T.source_id_key("source_db", "doi", T.text_or_empty("standard_doi_key")), "_k": T.text_or_empty("standard_doi_key"), "_t": T.key_text("title_en")})
    unstable = unstable_keys(rows, "source_db", "_k", "_t").select(F.col("_k").alias("doi")).distinct()
    return R.merge_in_order(rows, "row_id", "standard_doi_key", "meta_dedup_key", ["rank"], own="own", unstable=unstable)


def merge_basis_counts(spark, d):
    """Groups by what matched them, and their sizes."""
    groups = merged_in_order(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.max("match_mask").alias("mask"))
    return groups.groupBy(T.decode_mask(F.col("mask"), {2: "standard_doi", 4: "meta_key"}).alias("basis")).agg(F.count(F.lit(1)).alias("n_groups"), F.sum("size").alias("n_rows"), F.max("size").alias("largest"))


def fused_records(spark, d):
    """One record per DOI, fields by source priority."""
    rows = _keyed(spark, d).withColumn("k", T.text_or_empty("standard_doi_key")).filter("k <> ''")
    return R.fuse(rows, "k", FIELDS)


def _pick(field):
    order = R.FIELD_PRIORITIES.get(field, R.SOURCE_ORDER)
    if field in R.PRIMARY_FIELDS:
        return "CASE " + " ".join(f"WHEN max(source_db) FILTER (source_db = '{s}') IS NOT NULL THEN max({field}) FILTER (source_db = '{s}')" for s in R.SOURCE_ORDER) + " END"
    return "coalesce(" + ", ".join(f"nullif(max({field}) FILTER (source_db = '{s}'), '')" for s in order) + ", '')"


SQL_FUSED = f"""
WITH t AS (SELECT {K1} AS k, source_db, row_id, {", ".join(f"{S.text(f)} AS {f}" for f in FIELDS)} FROM {KEYED}),
q AS (SELECT *, {" + ".join(f"CAST({f} <> '' AS INTEGER)" for f in FIELDS)} AS filled, {" + ".join(f"length({f})" for f in FIELDS)} AS weight, count(*) OVER (PARTITION BY k) AS size FROM t WHERE k <> ''),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY k, source_db ORDER BY filled DESC, weight DESC, doi DESC, row_id) = 1)
SELECT k, max(size) AS group_size,
  CASE {" ".join(f"WHEN count(*) FILTER (source_db = '{s}') > 0 THEN '{s}'" for s in R.SOURCE_ORDER)} END AS source_db_primary,
  array_to_string(list_filter([{", ".join(f"CASE WHEN count(*) FILTER (source_db = '{s}') > 0 THEN '{s}' END" for s in R.SOURCE_ORDER)}], lambda x: x IS NOT NULL), '|') AS source_db_group,
  {", ".join(f"{_pick(f)} AS {f}" for f in FIELDS)}
FROM b GROUP BY k"""


def _residual(df):
    """Merged rows without a usable DOI, with their loose key."""
    rows = df.filter(T.doi_strict("doi") == "").select("rec_id", "source_db", T.text_or_empty("title_en").alias("title"), T.text_or_empty("journal_en").alias("journal"), T.text_or_empty("institution_norm").alias("institution"), T.text_or_empty("author").alias("author"), T.year_text("year").alias("y"))
    author = F.when(F.col("author").rlike("[A-Za-z]"), T.first_author_key("author")).otherwise("")
    return rows.withColumn("loose_key", A.loose_key(T.ascii_key("title"), F.col("y"), author))


def residual_groups(spark, d):
    """Rows under review as residual duplicates, numbered."""
    rows = A.candidate_groups(_residual(table(spark, d, MERGED)), "loose_key", ["y", "title", "author"], "R")
    return rows.select("group_id", "row_no", "group_rows", "rec_id", "source_db", "loose_key")


_RESIDUAL = f"""
a AS (SELECT rec_id, source_db, {S.text("title_en")} AS title, {S.text("journal_en")} AS journal, {S.text("institution_norm")} AS institution, {S.text("author")} AS author, {S.year_text("year")} AS y,
   {S.ascii_key("title_en")} AS tk, CASE WHEN regexp_matches(author, '[A-Za-z]') THEN {S.author_key("author")} ELSE '' END AS ak FROM {MERGED} WHERE {S.doi("doi")} = ''),
l AS (SELECT *, CASE WHEN length(tk) >= 8 AND y <> '' AND ak <> '' THEN tk || '|' || y || '|' || ak ELSE '' END AS loose_key FROM a),
g AS (SELECT loose_key, printf('R%03d', row_number() OVER (ORDER BY min(y), min(title), min(author), loose_key)) AS group_id FROM l WHERE loose_key <> '' GROUP BY loose_key HAVING count(*) > 1),
r AS (SELECT g.group_id, row_number() OVER (PARTITION BY g.group_id ORDER BY y, title, author, rec_id) AS row_no, count(*) OVER (PARTITION BY g.group_id) AS group_rows, l.* FROM l JOIN g USING (loose_key))"""
SQL_RESIDUAL = f"WITH {_RESIDUAL} SELECT group_id, row_no, group_rows, rec_id, source_db, loose_key FROM r"


def residual_decisions(spark, d):
    """Decision per residual group."""
    rows = A.candidate_groups(_residual(table(spark, d, MERGED)), "loose_key", ["y", "title", "author"], "R")
    return A.residual_action(A.overview(rows, "title", "journal", "source_db", "institution")).select("group_id", "n_rows", "n_sources", "n_journals", "n_institutions", "source_combo", "action", "confidence")


SQL_DECISIONS = f"""WITH {_RESIDUAL},
o AS (SELECT group_id, count(*) AS n_rows, count(DISTINCT source_db) AS n_sources, count(DISTINCT nullif({S.ascii_key("journal")}, '')) AS n_journals, count(DISTINCT nullif({S.ascii_key("institution")}, '')) AS n_institutions,
  array_to_string(list_sort(list(DISTINCT source_db)), '|') AS source_combo FROM r GROUP BY group_id)
SELECT *, CASE WHEN n_sources > 1 AND n_journals = 1 THEN '{A.MERGE}' WHEN n_sources = 1 AND n_journals = 1 AND n_institutions <= 1 THEN '{A.MERGE}' WHEN n_sources = 1 AND n_journals = 1 THEN '{A.MANUAL}' WHEN n_sources = 1 THEN '{A.KEEP}' ELSE '{A.MANUAL}' END AS action,
  CASE WHEN n_journals = 1 AND (n_sources > 1 OR n_institutions <= 1) THEN '高' ELSE '中' END AS confidence FROM o"""


def residual_annotated(spark, d):
    """Every row under review with its group's decision."""
    rows = A.candidate_groups(_residual(table(spark, d, MERGED)), "loose_key", ["y", "title", "author"], "R")
    return A.annotate(rows, A.overview(rows, "title", "journal", "source_db", "institution"), A.residual_action).select("group_id", "rec_id", "action", "confidence")


SQL_ANNOTATED = f"WITH d AS ({SQL_DECISIONS}), x AS (WITH {_RESIDUAL} SELECT group_id, rec_id FROM r) SELECT x.group_id, x.rec_id, d.action, d.confidence FROM x JOIN d USING (group_id)"


def conflict_groups(spark, d):
    """Rows with one metadata key and several DOIs, with the group's decision."""
    rows = _keyed(spark, d).select("row_id", "source_db", T.text_or_empty("meta_dedup_key").alias("k"), T.text_or_empty("standard_doi_key").alias("doi"), T.text_or_empty("title_en").alias("title"), T.text_or_empty("journal_en").alias("journal"))
    found = A.candidate_groups(rows, "k", ["k"], "C", distinct="doi")
    return A.annotate(found, A.overview(found, "title", "journal", "source_db"), A.conflict_action).select("group_id", "row_no", "row_id", "doi", "markers", "action")


SQL_CONFLICT = f"""
WITH t AS (SELECT row_id, source_db, {K2} AS k, {K1} AS doi, {S.text("title_en")} AS title, {S.text("journal_en")} AS journal FROM {KEYED}),
g AS (SELECT k, printf('C%03d', row_number() OVER (ORDER BY k)) AS group_id FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT nullif(doi, '')) > 1),
r AS (SELECT g.group_id, row_number() OVER (PARTITION BY g.group_id ORDER BY t.k, row_id) AS row_no, t.* FROM t JOIN g USING (k)),
o AS (SELECT group_id, count(DISTINCT nullif({S.ascii_key("journal")}, '')) AS nj, lower(min(title)) AS tl FROM r GROUP BY group_id),
m AS (SELECT *, array_to_string(list_concat(list_filter([{", ".join(f"'{m}'" for m in A.MARKERS)}], lambda x: contains(tl, x)), CASE WHEN contains(tl, '(vol ') OR contains(tl, ' vol ') THEN ['vol-reference'] ELSE [] END), '、') AS markers FROM o)
SELECT r.group_id, row_no, row_id, doi, markers, CASE WHEN nj <> 1 THEN '{A.KEEP}' WHEN markers <> '' THEN '{A.KEEP}' ELSE '{A.MANUAL}' END AS action FROM r JOIN m USING (group_id)"""


def audit_applied(spark, d):
    """Keyed rows after merging every metadata group into its richest row, gaps filled."""
    fields = ["title_en", "title_cn", "journal_en", "doi", "source_db"]
    rows = _keyed(spark, d).select("row_id", T.text_or_empty("meta_dedup_key").alias("k"), *(T.text_or_empty(f).alias(f) for f in fields)).filter("k <> ''")
    approved = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    fused = R.fuse_reviewed(rows.join(approved, "k", "left_semi"), "k", fields, ["source_db"], "row_id")
    return A.apply_merges(rows.withColumn("n_merged", F.lit(1).cast("bigint")), approved, fused, "k")


_AF = ["title_en", "title_cn", "journal_en", "doi", "source_db"]
SQL_APPLIED = f"""
WITH t AS (SELECT row_id, {K2} AS k, {", ".join(f"{S.text(f)} AS {f}" for f in _AF)} FROM {KEYED}),
q AS (SELECT *, {" + ".join(f"CAST({f} <> '' AS INTEGER)" for f in _AF)} AS filled, {" + ".join(f"length({f})" for f in _AF)} AS weight FROM t WHERE k <> '')
SELECT k, min(row_id) AS row_id, count(*) AS n_merged,
  {", ".join(f"coalesce(first({f} ORDER BY filled DESC, weight DESC, row_id) FILTER ({f} <> ''), '') AS {f}" for f in _AF[:-1])}, array_to_string(list_sort(list(DISTINCT source_db)), ' | ') AS source_db
FROM q GROUP BY k"""

_ALL = {
    "entity_components": (entity_components, SQL_COMPONENTS), "merged_in_order": (merged_in_order, ""), "merge_basis_counts": (merge_basis_counts, ""), "fused_records": (fused_records, SQL_FUSED),
    "merged_by_three_keys": (merged_by_three_keys, ""), "residual_groups": (residual_groups, SQL_RESIDUAL), "residual_decisions": (residual_decisions, SQL_DECISIONS), "residual_annotated": (residual_annotated, SQL_ANNOTATED), "conflict_groups": (conflict_groups, SQL_CONFLICT),
    "audit_applied": (audit_applied, SQL_APPLIED),
}


def queries():
    return {k: v[0] for k, v in _ALL.items()}


def oracle_sql():
    return {k: v[1] for k, v in _ALL.items() if v[1]}
