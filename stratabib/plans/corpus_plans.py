"""Queries over corpus integration."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratabib.functions import text as T
from stratabib.operators import corpus as C
from stratabib.plans import sql as S
from stratabib.runtime import table

MERGED, KEYED = "merge_three_db", "merge_three_db_dual_key_dedup_year_range"
START, END = 2012, 2024
REQUIRED = ["title_cn_en", "publish_date", "institution", "journal_en"]
DIMENSIONS = {"title": ["title_en", "title_cn", "title_cn_en"], "year": ["year"], "journal": ["journal_en", "journal_cn"], "institution": ["institution", "institution_extracted", "institution_norm"]}


def _merged(spark, d):
    return table(spark, d, MERGED)


def key_norm_scalars(spark, d):
    """Normal forms of identifiers, years, dates and authors of every record."""
    df = _merged(spark, d)
    strict = T.doi_strict("doi")
    return df.select(
        "rec_id", T.text_or_empty("doi").alias("doi_text"), strict.alias("doi_strict"), T.doi_loose("doi").alias("doi_loose"), T.candidate_doi("doi", "registered_doi").alias("doi_key"),
        T.source_id_key("source_db", "doi", strict).alias("source_key"), T.year_int("year").alias("year_int"), T.publish_month("publish_date").alias("publish_month"),
        T.ascii_key("title_en").alias("title_key"), F.when(F.col("author").rlike("[A-Za-z]"), T.first_author_key("author")).otherwise("").alias("author_key"),
    )


SQL_SCALARS = rf"""
SELECT rec_id, {S.text("doi")} AS doi_text, {S.doi("doi")} AS doi_strict, {S.doi("doi", r"10\.\S+")} AS doi_loose,
  coalesce(nullif({S.doi("doi")}, ''), {S.doi("registered_doi")}) AS doi_key,
  CASE WHEN {S.doi("doi")} = '' AND {S.text("doi")} <> '' THEN source_db || ':' || lower({S.text("doi")}) ELSE '' END AS source_key,
  {S.year_int("year")} AS year_int, {S.publish_month("publish_date")} AS publish_month, {S.ascii_key("title_en")} AS title_key,
  CASE WHEN regexp_matches(author, '[A-Za-z]') THEN {S.author_key("author")} ELSE '' END AS author_key
FROM {MERGED}"""


def lenient_numbers(spark, d):
    """Lenient numbers, rounding and fixed-point text."""
    f = T.to_float("cited_count")
    return table(spark, d, KEYED).select("row_id", T.to_int("cited_count").alias("as_int"), f.alias("as_float"), F.round(f / 7, 4).alias("rounded"), F.format_string("T%02d", T.to_int("year") % 12).alias("padded"))


SQL_NUMBERS = f"""
SELECT row_id, CAST(trunc({S.number("cited_count")}) AS BIGINT) AS as_int, {S.number("cited_count")} AS as_float, round({S.number("cited_count")} / 7, 4) AS rounded,
  'T' || lpad(CAST(CAST(trunc({S.number("year")}) AS BIGINT) % 12 AS VARCHAR), 2, '0') AS padded
FROM {KEYED}"""


def joined_titles(spark, d):
    """First filled title, titles joined without repeats, quality of the record."""
    n, size = T.quality(["title_en", "title_cn", "author", "institution", "journal_en", "doi", "abstract_en"])
    return _merged(spark, d).select("rec_id", T.first_nonempty("title_en", "title_cn").alias("title"), T.join_parts("title_en", "title_cn").alias("both"), n.alias("filled"), size.alias("weight"))


_Q = ["title_en", "title_cn", "author", "institution", "journal_en", "doi", "abstract_en"]
SQL_TITLES = f"""
SELECT rec_id, {S.first("title_en", "title_cn")} AS title,
  CASE WHEN {S.text("title_en")} <> '' AND {S.text("title_cn")} <> '' AND {S.text("title_en")} <> {S.text("title_cn")} THEN {S.text("title_en")} || ' | ' || {S.text("title_cn")}
       ELSE {S.first("title_en", "title_cn")} END AS both,
  {" + ".join(f"CAST({S.text(c)} <> '' AS INTEGER)" for c in _Q)} AS filled,
  CAST({" + ".join(f"length({S.text(c)})" for c in _Q)} AS INTEGER) AS weight
FROM {MERGED}"""


def _raw(df, source):
    """Rows of one source under that source's own field names."""
    rows = df.filter(F.col("source_db") == source).withColumn("row_seq", F.col("rec_id"))
    if source == "CNKI":
        return rows.select("row_seq", F.col("title_cn").alias("title"), "title_en", "title_cn_en", F.col("author_cn").alias("author"), "institution", "institution_extracted", "institution_norm", "journal_cn", "journal_en", "doi", "registered_doi", "year", "publish_date", "abstract_en", "abstract_cn", "keywords_en", "keywords_cn", "cited_count")
    if source == "WOS":
        return rows.select("row_seq", F.col("title_en").alias("ti"), F.col("author").alias("au"), F.col("institution").alias("c1"), F.col("journal_en").alias("so"), F.col("doi").alias("di"), F.col("year").alias("py"), F.col("publish_date").alias("pd"), F.col("abstract_en").alias("ab"), F.col("keywords_en").alias("de"), F.col("cited_count").alias("tc"))
    return rows.select("row_seq", F.col("title_en").alias("ti"), F.col("title_cn").alias("z1"), F.col("author").alias("au"), F.col("author_cn").alias("z2"), F.col("institution").alias("c1"), F.col("journal_en").alias("so"), F.col("journal_cn").alias("z3"), F.col("doi").alias("di"), F.col("year").alias("py"), F.col("abstract_en").alias("ab"), F.col("abstract_cn").alias("z4"), F.col("keywords_en").alias("de"), F.col("keywords_cn").alias("z5"), F.col("cited_count").alias("z9"))


def corpus_integrated(spark, d):
    """Three sources mapped from their own field names to the core schema."""
    df = _merged(spark, d)
    return C.integrate({s: _raw(df, s) for s in C.SOURCE_ORDER}).withColumnRenamed("row_seq", "rec_id").select("rec_id", "source_db", "title_en", "title_cn", "title_cn_en", "author", "author_cn", "institution", "journal_en", "doi", "year", "publish_date", "keywords_en", "cited_count")


def _t(c):
    return f"{S.text(c)} AS {c}"


SQL_INTEGRATED = f"""
SELECT rec_id, 'CNKI' AS source_db, {_t("title_en")}, {_t("title_cn")}, {_t("title_cn_en")}, '' AS author, {_t("author_cn")}, {_t("institution")}, {_t("journal_en")}, {_t("doi")},
  {S.year_text("year")} AS year, {S.publish_month("publish_date")} AS publish_date, {_t("keywords_en")}, {_t("cited_count")} FROM {MERGED} WHERE source_db = 'CNKI'
UNION ALL
SELECT rec_id, 'WOS', {S.text("title_en")}, '', '', {S.text("author")}, '', {S.text("institution")}, {S.text("journal_en")}, {S.text("doi")},
  {S.year_text("year")}, {S.publish_month(f"trim({S.text('publish_date')} || ' ' || {S.text('year')})")}, {S.text("keywords_en")}, {S.text("cited_count")} FROM {MERGED} WHERE source_db = 'WOS'
UNION ALL
SELECT rec_id, 'CSCD', {S.text("title_en")}, {S.text("title_cn")},
  CASE WHEN {S.text("title_en")} <> '' AND {S.text("title_cn")} <> '' AND {S.text("title_en")} <> {S.text("title_cn")} THEN {S.text("title_en")} || ' | ' || {S.text("title_cn")} ELSE {S.first("title_en", "title_cn")} END,
  {S.text("author")}, {S.text("author_cn")}, {S.text("institution")}, {S.text("journal_en")}, {S.text("doi")},
  {S.year_text("year")}, {S.publish_month("year")}, {S.text("keywords_en")}, {S.text("cited_count")} FROM {MERGED} WHERE source_db = 'CSCD'"""


def corpus_required(spark, d):
    return C.require_fields(_merged(spark, d), REQUIRED).select("rec_id", "source_db")


SQL_REQUIRED = f"SELECT rec_id, source_db FROM {MERGED} WHERE " + " AND ".join(f"{S.text(c)} <> ''" for c in REQUIRED)


def corpus_admission(spark, d):
    """Rows kept and, per reason, dropped, by source."""
    rows = _merged(spark, d).select("source_db", C.admission_reasons(DIMENSIONS).alias("reasons"))
    named = rows.select("source_db", F.explode(F.when(F.size("reasons") == 0, F.array(F.lit("kept"))).otherwise(F.col("reasons"))).alias("reason"))
    return named.groupBy("source_db", "reason").agg(F.count(F.lit(1)).alias("n"))


SQL_ADMISSION = (
    f"WITH r AS (SELECT source_db, "
    + ", ".join(f"{S.first(*fields)} = '' AS m_{name}" for name, fields in DIMENSIONS.items())
    + f" FROM {MERGED}), e AS (SELECT source_db, 'kept' AS reason FROM r WHERE NOT ("
    + " OR ".join(f"m_{n}" for n in DIMENSIONS)
    + ") "
    + " ".join(f"UNION ALL SELECT source_db, 'missing_{n}' FROM r WHERE m_{n}" for n in DIMENSIONS)
    + ") SELECT source_db, reason, count(*) AS n FROM e GROUP BY ALL"
)


def corpus_year_status(spark, d):
    status = C.year_status(T.year_int("year"), START, END)
    return _merged(spark, d).groupBy("source_db", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


SQL_YEARS = f"""
SELECT source_db, CASE WHEN {S.year_int("year")} IS NULL THEN 'missing_year' WHEN {S.year_int("year")} BETWEEN {START} AND {END} THEN 'kept' ELSE 'out_of_range' END AS status, count(*) AS n
FROM {MERGED} GROUP BY ALL"""


def _keys(df):
    title = T.title_for_key("title_en", "title_cn_en", "title_cn")
    return df.withColumns({"y": T.year_int("year"), "doi_key": T.candidate_doi("doi", "registered_doi"), "signature": T.ascii_key(title)})


def corpus_unstable_doi(spark, d):
    """DOI keys that one source gives to several titles within the years kept."""
    rows = _keys(_merged(spark, d)).filter(F.col("y").between(START, END))
    return C.unstable_keys(rows, "source_db", "doi_key", "signature")


_KEYS = f"""SELECT rec_id, source_db, {S.year_int("year")} AS y, coalesce(nullif({S.doi("doi")}, ''), {S.doi("registered_doi")}) AS doi_key,
  {S.text("title_en")} AS te, {S.text("title_cn_en")} AS tb, {S.text("title_cn")} AS tc,
  list_filter(list_transform(string_split({S.text("title_cn_en")}, '|'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM {MERGED}"""
_TITLE = """coalesce(nullif(te, ''), CASE WHEN len(list_filter(parts, lambda x: regexp_matches(x, '[a-zA-Z]'))) > 0
   THEN list_reduce(list_filter(parts, lambda x: regexp_matches(x, '[a-zA-Z]')), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END)
   WHEN len(parts) > 0 THEN list_reduce(parts, lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END) END, nullif(tc, ''), '')"""
SQL_UNSTABLE = f"""
WITH k AS ({_KEYS}), s AS (SELECT source_db, doi_key, regexp_replace(lower({_TITLE}), '[^a-z0-9]+', '', 'g') AS signature FROM k WHERE y BETWEEN {START} AND {END})
SELECT source_db, doi_key, count(DISTINCT signature) AS n_titles FROM s WHERE doi_key <> '' AND signature <> '' GROUP BY ALL HAVING count(DISTINCT signature) > 1"""


def corpus_ingest_stats(spark, d):
    rows = _keys(_merged(spark, d))
    unstable = C.unstable_keys(rows.filter(F.col("y").between(START, END)), "source_db", "doi_key", "signature").select("source_db", "doi_key", F.lit(True).alias("unstable"))
    rows = rows.join(unstable, ["source_db", "doi_key"], "left")
    kept = F.col("y").between(START, END)
    return C.ingest_stats(rows, "source_db", {"year_kept_rows": kept, "rows_with_candidate_doi": kept & (F.col("doi_key") != ""), "rows_with_unstable_doi": kept & F.coalesce("unstable", F.lit(False)), "rows_with_title": kept & (F.col("signature") != "")})


SQL_INGEST = f"""
WITH k AS ({_KEYS}), s AS (SELECT source_db, y, doi_key, regexp_replace(lower({_TITLE}), '[^a-z0-9]+', '', 'g') AS signature FROM k),
u AS (SELECT source_db, doi_key FROM s WHERE y BETWEEN {START} AND {END} AND doi_key <> '' AND signature <> '' GROUP BY ALL HAVING count(DISTINCT signature) > 1)
SELECT s.source_db, count(*) AS original_rows, count(*) FILTER (y BETWEEN {START} AND {END}) AS year_kept_rows, count(*) FILTER (y BETWEEN {START} AND {END} AND s.doi_key <> '') AS rows_with_candidate_doi,
  count(*) FILTER (y BETWEEN {START} AND {END} AND u.doi_key IS NOT NULL) AS rows_with_unstable_doi, count(*) FILTER (y BETWEEN {START} AND {END} AND signature <> '') AS rows_with_title
FROM s LEFT JOIN u ON s.source_db = u.source_db AND s.doi_key = u.doi_key GROUP BY s.source_db"""


def corpus_first_wins(spark, d):
    """First row of each (DOI, title, date)."""
    rows = _merged(spark, d).select("rec_id", "source_db", T.text_or_empty("doi").alias("k_doi"), T.text_or_empty("title_en").alias("k_title"), T.text_or_empty("publish_date").alias("k_date"))
    return C.first_wins(rows, ["k_doi", "k_title", "k_date"], [F.col("rec_id")]).select("rec_id", "source_db", "k_doi", "k_title", "k_date")


SQL_FIRST = f"""
SELECT rec_id, source_db, k_doi, k_title, k_date FROM (SELECT rec_id, source_db, {S.text("doi")} AS k_doi, {S.text("title_en")} AS k_title, {S.text("publish_date")} AS k_date FROM {MERGED})
QUALIFY row_number() OVER (PARTITION BY k_doi, k_title, k_date ORDER BY rec_id) = 1"""


def corpus_priority_dedup(spark, d):
    """One row per DOI, the source with the higher priority first."""
    rows = C.require_doi(_merged(spark, d)).withColumns({"doi_key": F.lower(F.trim("doi")), "rank": F.when(F.col("source_db") == "CNKI", 0).when(F.col("source_db") == "WOS", 1).otherwise(2)})
    return C.first_wins(rows.select("doi_key", "rec_id", "source_db", "rank"), ["doi_key"], [F.col("rank"), F.col("rec_id")]).select("doi_key", "rec_id", "source_db")


SQL_PRIORITY = f"""
SELECT doi_key, rec_id, source_db FROM (SELECT lower(trim(doi)) AS doi_key, rec_id, source_db, CASE source_db WHEN 'CNKI' THEN 0 WHEN 'WOS' THEN 1 ELSE 2 END AS r FROM {MERGED}
  WHERE doi IS NOT NULL AND lower(trim(doi)) NOT IN ('', 'nan', 'none', 'null')) QUALIFY row_number() OVER (PARTITION BY doi_key ORDER BY r, rec_id) = 1"""

LABELS = {"rec_id": "记录编号", "source_db": "来源库", "year": "年份", "journal_en": "期刊"}
SOURCES_ZH = {"CNKI": "知网", "WOS": "科学引文", "CSCD": "中国科学引文"}


def localized_table(spark, d):
    """Headers and codes in Chinese."""
    rows = _merged(spark, d).select("rec_id", C.recode(F.col("source_db"), SOURCES_ZH).alias("source_db"), T.year_text("year").alias("year"), T.text_or_empty("journal_en").alias("journal_en"))
    return C.rename_columns(C.with_missing_columns(rows, ["note"]), LABELS)


SQL_LOCAL = f"""SELECT rec_id AS "记录编号", CASE source_db WHEN 'CNKI' THEN '知网' WHEN 'WOS' THEN '科学引文' WHEN 'CSCD' THEN '中国科学引文' ELSE source_db END AS "来源库", {S.year_text("year")} AS "年份", {S.text("journal_en")} AS "期刊" FROM {MERGED}"""

BITS = {2: "standard_doi", 4: "meta_key"}
BASIS_ZH = {"standard_doi": "标准DOI", "meta_key": "元数据", "single": "单条"}


def match_basis(spark, d):
    """Which keys each keyed record has, as mask, text and localised list."""
    has = lambda c, bit: F.when(T.text_or_empty(c) != "", bit).otherwise(0)
    mask = (has("standard_doi_key", 2) + has("meta_dedup_key", 4)).alias("mask")
    rows = table(spark, d, KEYED).select("row_id", mask).withColumn("basis", T.decode_mask(F.col("mask"), BITS))
    return rows.withColumn("basis_zh", C.recode_list(F.col("basis"), BASIS_ZH))


SQL_BASIS = f"""
WITH m AS (SELECT row_id, CASE WHEN {S.text("standard_doi_key")} <> '' THEN 2 ELSE 0 END + CASE WHEN {S.text("meta_dedup_key")} <> '' THEN 4 ELSE 0 END AS mask FROM {KEYED})
SELECT row_id, mask, CASE mask WHEN 0 THEN 'single' WHEN 2 THEN 'standard_doi' WHEN 4 THEN 'meta_key' ELSE 'standard_doi|meta_key' END AS basis,
  CASE mask WHEN 0 THEN '单条' WHEN 2 THEN '标准DOI' WHEN 4 THEN '元数据' ELSE '标准DOI|元数据' END AS basis_zh FROM m"""


def document_signature(spark, d):
    """Natural-key join of records to an assignment that is last-wins per key."""
    rows = _merged(spark, d).select("rec_id", C.signature("title_en", "year", "journal_en").alias("signature"), F.col("source_db").alias("assigned"))
    last = rows.groupBy("signature").agg(F.max_by("assigned", "rec_id").alias("assigned"), F.count(F.lit(1)).alias("n"))
    return rows.select("rec_id", "signature").join(last, "signature")


SQL_SIGNATURE = rf"""
WITH s AS (SELECT rec_id, source_db, array_to_string([lower(trim(regexp_replace({S.text("title_en")}, '\s+', ' ', 'g'))), lower(trim(regexp_replace({S.text("year")}, '\s+', ' ', 'g'))), lower(trim(regexp_replace({S.text("journal_en")}, '\s+', ' ', 'g')))], '||') AS signature FROM {MERGED})
SELECT rec_id, signature, last_value(source_db) OVER w AS assigned, count(*) OVER w AS n FROM s WINDOW w AS (PARTITION BY signature ORDER BY rec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""

_ALL = {
    "key_norm_scalars": (key_norm_scalars, SQL_SCALARS), "lenient_numbers": (lenient_numbers, SQL_NUMBERS), "joined_titles": (joined_titles, SQL_TITLES), "corpus_integrated": (corpus_integrated, SQL_INTEGRATED),
    "corpus_required": (corpus_required, SQL_REQUIRED), "corpus_admission": (corpus_admission, SQL_ADMISSION), "corpus_year_status": (corpus_year_status, SQL_YEARS), "corpus_unstable_doi": (corpus_unstable_doi, SQL_UNSTABLE),
    "corpus_ingest_stats": (corpus_ingest_stats, SQL_INGEST), "corpus_first_wins": (corpus_first_wins, SQL_FIRST), "corpus_priority_dedup": (corpus_priority_dedup, SQL_PRIORITY), "localized_table": (localized_table, SQL_LOCAL),
    "match_basis": (match_basis, SQL_BASIS), "document_signature": (document_signature, SQL_SIGNATURE),
}


def queries():
    return {k: v[0] for k, v in _ALL.items()}


def oracle_sql():
    return {k: v[1] for k, v in _ALL.items() if v[1]}
