"""Corpus integration: source mapping, admission, filters, counters and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratabib.functions import text as T

CORE = [
    "title_en", "title_cn", "title_cn_en", "author", "author_cn", "institution", "institution_extracted", "institution_norm",
    "journal_en", "journal_cn", "doi", "registered_doi", "year", "publish_date", "abstract_en", "abstract_cn", "keywords_en", "keywords_cn", "cited_count",
]
SOURCE_ORDER = ("CNKI", "WOS", "CSCD")


def column_or_empty(df: DataFrame, name: str) -> Column:
    """The column as clean text, or '' where the table lacks it."""
    return T.text_or_empty(F.col(f"`{name}`")) if name in df.columns else F.lit("")


def _mapped(df: DataFrame, source: str, columns: dict[str, Column]) -> DataFrame:
    keep = [c for c in ("row_seq",) if c in df.columns]
    return df.select(*keep, *(columns.get(c, F.lit("")).alias(c) for c in CORE), F.lit(source).alias("source_db"))


def map_cnki(df: DataFrame) -> DataFrame:
    """CNKI rows in the core schema; its author column is Chinese."""
    g = lambda c: column_or_empty(df, c)
    same = {c: g(c) for c in CORE}
    return _mapped(df, "CNKI", same | {"title_cn": g("title"), "author": F.lit(""), "author_cn": g("author"), "year": T.year_text(g("year")), "publish_date": T.publish_month(g("publish_date"))})


def map_wos(df: DataFrame) -> DataFrame:
    """WOS rows (two-letter field tags) in the core schema."""
    g = lambda c: column_or_empty(df, c)
    dated = F.trim(F.concat(g("pd"), F.lit(" "), g("py")))
    return _mapped(df, "WOS", {
        "title_en": g("ti"), "author": T.first_nonempty(g("af"), g("au")), "institution": g("c1"), "journal_en": g("so"), "doi": g("di"),
        "year": T.year_text(g("py")), "publish_date": T.publish_month(dated), "abstract_en": g("ab"), "keywords_en": g("de"), "cited_count": g("tc"),
    })


def map_cscd(df: DataFrame) -> DataFrame:
    """CSCD rows (two-letter tags, z-tags for Chinese) in the core schema."""
    g = lambda c: column_or_empty(df, c)
    return _mapped(df, "CSCD", {
        "title_en": g("ti"), "title_cn": g("z1"), "title_cn_en": T.join_parts(g("ti"), g("z1")), "author": g("au"), "author_cn": g("z2"),
        "institution": T.first_nonempty(g("c1"), g("z6")), "journal_en": g("so"), "journal_cn": g("z3"), "doi": g("di"), "year": T.year_text(g("py")),
        "publish_date": T.publish_month(g("py")), "abstract_en": g("ab"), "abstract_cn": g("z4"), "keywords_en": g("de"), "keywords_cn": g("z5"), "cited_count": g("z9"),
    })


MAPPERS = {"CNKI": map_cnki, "WOS": map_wos, "CSCD": map_cscd}


def integrate(tables: dict[str, DataFrame]) -> DataFrame:
    """All sources in the core schema."""
    out = None
    for source, df in tables.items():
        mapped = MAPPERS[source](df)
        out = mapped if out is None else out.unionByName(mapped)
    return out


def admission_reasons(dimensions: dict[str, list[str]]) -> Column:
    """Names of the dimensions none of whose fields is filled, in order."""
    missing = [F.when(T.first_nonempty(*fields) == "", F.lit(f"missing_{name}")) for name, fields in dimensions.items()]
    return F.array_compact(F.array(*missing))


def require_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    keep = F.lit(True)
    for f in fields:
        keep = keep & (T.text_or_empty(f) != "")
    return df.filter(keep)


def year_status(year: Column, start: int | None, end: int | None) -> Column:
    """kept, missing_year or out_of_range; either bound may be open."""
    inside = F.lit(True)
    if start is not None:
        inside = inside & (year >= start)
    if end is not None:
        inside = inside & (year <= end)
    return F.when(year.isNull(), "missing_year").when(inside, "kept").otherwise("out_of_range")


def require_doi(df: DataFrame, column: str = "doi") -> DataFrame:
    key = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    return df.filter(~key.isin("", "nan", "none", "null"))


def unstable_keys(df: DataFrame, source: str, key: str, signature: str) -> DataFrame:
    """Keys that one source gives to several titles: ``(source, key, n_titles)``. Empty keys and titles don't count."""
    rows = df.filter((F.col(key) != "") & (F.col(signature) != ""))
    return rows.groupBy(source, key).agg(F.count_distinct(signature).alias("n_titles")).filter("n_titles > 1")


def ingest_stats(df: DataFrame, source: str, counters: dict[str, Column]) -> DataFrame:
    """One row per source with the number of rows that meet each condition."""
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("original_rows"), *(F.count_if(c).alias(name) for name, c in counters.items()))


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order.

    Rows are combined before the shuffle (min over the order), so a key with many rows costs one row a task.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return ranked.select(*keys, *(F.col(f"_row.`{c}`").alias(c) for c in rest))


def with_missing_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit("") for c in names if c not in df.columns})


def rename_columns(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Only the mapped columns, under their new names, in the mapping's order."""
    return df.select(*(F.col(f"`{a}`").alias(b) for a, b in names.items()))


def recode(c: Column, codes: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), c)


def recode_list(c: Column, codes: dict[str, str], sep: str = "|", out: str = "|") -> Column:
    """Each code of a delimited list by its label; unknown codes stay."""
    table = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return F.array_join(F.transform(F.split(c, f"\\{sep}"), lambda x: F.coalesce(F.try_element_at(table, x), x)), out)


def signature(*columns: str) -> Column:
    """A document's natural key: fields compacted, lower case, joined by '||'."""
    return F.concat_ws("||", *(F.lower(T.compact(T.text_or_empty(c))) for c in columns))
